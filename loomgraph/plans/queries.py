"""All registered queries outside the training-data subpackage."""

from loomgraph.plans import doc_queries, graph_queries, more_queries, record_queries  # noqa: F401
from loomgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
