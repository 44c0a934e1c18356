"""Text-corpus and request-log analytics on PySpark DataFrames."""
