"""Semantic index and search over text files, on Spark."""

from .operators.embedding import FunctionEmbedder, HashedWords, RequestBudget
from .plans import (
    CellIndex,
    FileRules,
    IndexSettings,
    SearchIndex,
    answers,
    search,
    search_batch,
    search_with_snippets,
)
from .session import local_session, ship_package

__all__ = [
    "CellIndex", "FileRules", "FunctionEmbedder", "HashedWords", "IndexSettings", "RequestBudget", "SearchIndex",
    "answers",
    "local_session", "search", "search_batch", "search_with_snippets", "ship_package",
]
