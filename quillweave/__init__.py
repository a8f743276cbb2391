"""quillweave: a PySpark-native web-search analytics engine."""
