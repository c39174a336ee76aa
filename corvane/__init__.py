"""Corvane: a PySpark engine for knowledge retrieval and corpus analytics."""
