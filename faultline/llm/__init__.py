"""Operators for large corpora of training texts. Nothing else in the package imports this one."""
