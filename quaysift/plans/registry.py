"""Every query of the library by name, and the SQL that gives the same rows."""

from . import q_admission, q_bytes, q_content, q_inspect, q_log, q_stream  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
