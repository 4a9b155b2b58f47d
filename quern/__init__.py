"""quern: a PySpark-native engine for similarity search, re-ranking and curation analytics."""
