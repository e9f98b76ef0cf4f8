"""Foliant: document-workspace queries and corpus preparation, written as Spark plans."""
