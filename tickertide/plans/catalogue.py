"""All registered queries."""

from tickertide.plans import (  # noqa: F401
    bar_queries,
    feature_queries,
    fit_queries,
    metric_queries,
    news_queries,
    stream_queries,
    text_queries,
)
from tickertide.plans.registry import CHECKS, QUERIES

FLAGSHIP = "persistence_per_ticker__i1_i7"


def queries():
    return dict(QUERIES)


def checks():
    return dict(CHECKS)
