"""Operators for large text corpora: one module each, their queries in ``queries``."""
