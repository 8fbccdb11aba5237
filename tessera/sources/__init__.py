"""Readers and writers of tables."""
from tessera.sources.formats import read_files, write_files
from tessera.sources.tables import TABLES, table

__all__ = ["TABLES", "read_files", "table", "write_files"]
