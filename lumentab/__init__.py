"""lumentab: document-corpus and answer-evaluation analytics on Spark."""

__version__ = "0.1.0"
