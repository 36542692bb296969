"""Sizing arithmetic and partition transforms, as Python functions and as columns."""
