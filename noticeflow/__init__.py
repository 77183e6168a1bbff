"""Spark-native ingestion, indexing and search of procurement notices and similar short documents."""
