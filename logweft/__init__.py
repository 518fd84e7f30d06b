"""logweft: log analytics as PySpark DataFrame operators."""

from .session import get_spark, materialize
from .schema import LINE_SCHEMA, LOG_SCHEMA, PARSED_TYPE

__all__ = ["get_spark", "materialize", "LINE_SCHEMA", "LOG_SCHEMA", "PARSED_TYPE"]
