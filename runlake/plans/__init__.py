"""Datasets at rest and the SQL views over them."""

from .dataset import Dataset, list_datasets
from .views import DatasetFrames, ReportRun, register_views, sql

__all__ = ["Dataset", "DatasetFrames", "ReportRun", "list_datasets", "register_views", "sql"]
