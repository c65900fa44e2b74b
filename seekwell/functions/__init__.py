"""Column expressions. Import the modules: `text`, `paths`, `ids`, `vectors`."""

from . import ids, paths, text, vectors

__all__ = ["ids", "paths", "text", "vectors"]
