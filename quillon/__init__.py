"""Bibliographic search, enrichment and corpus analytics on PySpark."""
