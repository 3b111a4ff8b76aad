"""signalmill: document-signal analytics expressed as PySpark DataFrame operations."""
