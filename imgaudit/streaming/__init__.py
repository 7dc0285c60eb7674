"""Structured Streaming operators over verdict requests, pages and issues."""
