"""Structured Streaming jobs."""

from .jobs import file_changes, requests, start_answers, start_refresh

__all__ = ["file_changes", "requests", "start_answers", "start_refresh"]
