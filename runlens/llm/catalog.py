"""All queries of the subpackage."""

from . import queries_decontaminate, queries_filters, queries_language, queries_lines, queries_similarity, queries_tokens, queries_vectors  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
