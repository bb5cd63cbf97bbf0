"""tickflow.streaming."""
