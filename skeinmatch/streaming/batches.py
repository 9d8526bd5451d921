"""A bounded frontier: start vertices go through the match a batch at a time, so that partial matches in flight stay few."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from ..functions.hashing import mixed
from ..operators.graph import LabeledGraph
from ..operators.match import _plan, count, start_candidates
from ..plans.query import QueryGraph


def batch_counts(graph: LabeledGraph, query: QueryGraph, batches: int, strategy: str = "join") -> Iterator[int]:
    """Embeddings of each of `batches` parts of the start vertices, dealt by hash; their sum is the count of the query."""
    first = _plan(graph, query, "degree")[0][0]
    starts = start_candidates(graph, query, first)
    for k in range(batches):
        part = starts.where(mixed("id", 3) % batches == k)
        yield count(graph, query, strategy, start=part).first()["n"]
