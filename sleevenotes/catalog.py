"""All registered catalog queries."""

from . import library_queries, more_queries, naming_queries, scanner_queries, small_queries  # noqa: F401  they register their queries
from .queries import QUERIES, SQL, c09_routing  # noqa: F401
