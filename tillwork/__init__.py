"""Card-payments analytics as Spark DataFrame jobs."""

from tillwork.session import build_session, prepare

__all__ = ["build_session", "prepare"]
