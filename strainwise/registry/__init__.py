"""Named queries over the sales tables, and the SQL that checks them."""

from .oracle import oracle_sql
from .catalog import queries

__all__ = ["queries", "oracle_sql"]
