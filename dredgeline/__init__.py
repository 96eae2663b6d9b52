"""Sensitive-data scanning and findings analytics on Spark."""
