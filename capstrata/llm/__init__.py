"""Operators for preparing training data from filings; nothing outside imports this."""
