"""tickflow.functions."""
