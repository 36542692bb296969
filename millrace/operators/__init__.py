"""Data-plane operators: merge-on-read, rewrite, validation."""
