"""quern: a PySpark-native engine for graph retrieval and corpus analytics."""
