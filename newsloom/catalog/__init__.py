"""All registered queries."""

from newsloom.catalog import (  # noqa: F401
    cluster_queries,
    issue_queries,
    page_queries,
    table_queries,
    text_queries,
)
from newsloom.catalog.base import ENTRIES  # noqa: F401
