"""Planning: which files are rewritten, in which groups, and why."""
