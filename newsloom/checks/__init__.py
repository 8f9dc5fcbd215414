"""All registered queries; importing a module registers its queries."""

from newsloom.checks.base import ORACLES, QUERIES
from newsloom.checks import (  # noqa: F401
    scalar_checks,
    content_checks,
    evaluation_checks,
    metric_checks,
    recommender_checks,
    session_checks,
    stream_checks,
    table_checks,
)

__all__ = ["ORACLES", "QUERIES"]
