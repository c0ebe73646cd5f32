"""Access-audit and inventory analytics as Spark DataFrame functions."""

from accesslake.sources.tables import Tables

__all__ = ["Tables"]
