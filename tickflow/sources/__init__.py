"""tickflow.sources."""
