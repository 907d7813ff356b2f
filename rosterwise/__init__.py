"""Recruiting analytics on PySpark: jobs x candidates x transcripts, all set-based."""
