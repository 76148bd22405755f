"""The registered query catalogue (importing the modules registers them)."""

from tidemark.plans import (q_aspects, q_features, q_filings, q_models, q_novelty, q_operators,  # noqa: F401
                            q_prices, q_sentiment, q_sources)
from tidemark.plans.q_streaming import STREAM_QUERIES
from tidemark.plans.registry import ORACLES, QUERIES, query

for _name, (_fn, _sql) in STREAM_QUERIES.items():
    if _name not in QUERIES:
        query(_name, _sql)(_fn)

__all__ = ["QUERIES", "ORACLES"]
