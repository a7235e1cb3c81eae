"""Preference-data preparation and run evaluation as Spark DataFrame jobs."""

from prefloom.session import configure, shared_dir

__all__ = ["configure", "shared_dir"]
