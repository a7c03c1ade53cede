"""Lodestone: retrieval, validation and corpus-building operators for PySpark."""
