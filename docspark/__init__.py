"""docspark: document-corpus analytics as PySpark DataFrame transformations."""
