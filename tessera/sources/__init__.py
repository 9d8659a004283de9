"""Readers of the star schema and of files, and tables that jobs write for themselves."""

from tessera.sources.tables import TABLES, table
from tessera.sources.written import fresh_path, shared_folder, written_table

__all__ = ["TABLES", "fresh_path", "shared_folder", "table", "written_table"]
