"""Ingest, catalogs and writers."""
