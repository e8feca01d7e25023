"""Portfolio evidence analytics on PySpark."""
