"""Document retrieval, cleaning and evaluation as PySpark DataFrame operators."""
