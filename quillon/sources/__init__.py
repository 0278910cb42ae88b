from quillon.sources.tables import load, table_path

__all__ = ["load", "table_path"]
