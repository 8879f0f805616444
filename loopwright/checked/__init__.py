"""The queries that are checked against SQL, by operator id."""

from loopwright.checked import (  # noqa: F401
    aggregates,
    feedback_flow,
    inference,
    joins,
    ordering,
    predictor_flow,
    projections,
    registry_flow,
    scans,
    search_flow,
    streams,
    texts,
)
