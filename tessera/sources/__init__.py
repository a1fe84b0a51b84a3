"""Catalogs, readers, tables and sinks."""
