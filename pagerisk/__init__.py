"""PySpark-native analytics for labelled web-page risk data."""

from pagerisk.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
