"""Composite jobs: the index and the searches over it."""

from .cells import CellIndex
from .index import FileRules, IndexSettings, SearchIndex, line_settings, token_settings
from .search import answers, search, search_batch, search_with_snippets

__all__ = [
    "CellIndex", "FileRules", "IndexSettings", "SearchIndex", "answers", "line_settings", "search",
    "search_batch", "search_with_snippets", "token_settings",
]
