"""Registered queries over the driver tables, each with the SQL that must give the same rows."""

from . import (  # noqa: F401
    cleaning,
    features_models,
    gold_tables,
    joins_aggregates,
    quality_checks,
    serving_queries,
    source_formats,
    stored_tables,
    streams,
    text_geo,
    windows_ranks,
)
from .base import ORACLES, QUERIES  # noqa: F401
