"""Row-local pipelines over streaming DataFrames."""

from tablewright.streaming.stateless import clean_stream, flag_stream

__all__ = ["clean_stream", "flag_stream"]
