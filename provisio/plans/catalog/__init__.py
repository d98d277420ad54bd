"""All registered queries, one module per operator family."""

from provisio.plans.registry import ORACLES, QUERIES

from . import corpus, effect, hierarchy, ranking, retrieval, reviews, segments, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
