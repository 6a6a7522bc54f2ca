"""Vettra: document-fraud detection and underwriting analytics on PySpark."""
