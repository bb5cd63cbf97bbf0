"""tickflow.operators."""
