"""Streaming use of fitted, row-local state (see ``apply``)."""

from .apply import check_stream_safe, prep_stream, score_stream

__all__ = ["check_stream_safe", "prep_stream", "score_stream"]
