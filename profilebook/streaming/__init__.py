"""Structured Streaming forms of the status write-back (T1) and completeness counts."""
