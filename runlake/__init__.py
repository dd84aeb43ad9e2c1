"""runlake: overlapping report runs combined into duplicate-free, queryable datasets on Spark."""

from .session import build_session, configure, work_dir

__all__ = ["build_session", "configure", "work_dir"]
