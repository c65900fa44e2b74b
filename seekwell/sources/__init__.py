"""Where snapshots and requests come from."""

from .files import (
    from_binary,
    from_table,
    indexable_names,
    list_directory,
    pattern_lines,
    scan_directory,
    scan_visible,
)
from .requests import checked, rejected, single_request, valid

__all__ = [
    "checked", "from_binary", "from_table", "indexable_names", "list_directory",
    "pattern_lines", "rejected", "scan_directory", "scan_visible", "single_request", "valid",
]
