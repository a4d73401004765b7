"""All queries by name, and their SQL."""

from . import file_queries, more_queries  # noqa: F401
from .queries import QUERIES, SQL  # noqa: F401
