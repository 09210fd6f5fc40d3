"""factloom: retrieval-and-validate analytics expressed as PySpark DataFrame jobs."""
