"""spanloom: call-trace analytics as Spark jobs."""

from .plans.analysis import Analysis, analyze, explain, func_detail, load, profile, story_children, write_report
from .session import build_session, configure

__all__ = ["Analysis", "analyze", "configure", "explain", "func_detail", "load", "profile", "build_session", "story_children", "write_report"]
