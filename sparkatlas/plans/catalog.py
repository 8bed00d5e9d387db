"""All registered queries of the engine."""

from sparkatlas.plans import graphs, health, logs, lookups, retrieval, streams, texts
from sparkatlas.plans.registry import ORACLES, QUERIES

FLAGSHIP = "hybrid_query"
MODULES = (graphs, health, logs, lookups, retrieval, streams, texts)

__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
