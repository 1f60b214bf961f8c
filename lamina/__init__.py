"""lamina: snapshot-catalog analytics and content processing on PySpark."""
