"""marlstone: a PySpark-native engine for source-code repositories and text corpora as tables."""
