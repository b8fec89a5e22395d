"""Paged delivery of rows from a pinned snapshot."""
