"""Scriptorium: document-structuring analytics on Spark."""
