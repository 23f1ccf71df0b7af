"""folioflow: document-memory analytics as Spark DataFrame plans."""
