"""Set-returning functions for SQL: nearest claims of a query vector over a table argument."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _described(rows: AnalyzeArgument, embedding: str) -> AnalyzeResult:
    """The columns of the table argument but the vector, and the similarity."""
    if not rows.isTable:
        raise ValueError("the first argument is a table: TABLE(...) [PARTITION BY ...]")
    if embedding not in rows.dataType.fieldNames():
        raise ValueError(f"the table has no column {embedding}")
    kept = [f for f in rows.dataType.fields if f.name != embedding]
    return AnalyzeResult(StructType([*kept, StructField("similarity", DoubleType())]))


class _Nearest:
    """Of each partition of the table argument the rows most similar to the query; it holds so many rows and no more."""

    def __init__(self) -> None:
        self.best: list[tuple] = []
        self.seen = 0
        self.query: list[float] | None = None

    def offer(self, row, embedding: str, query: list[float], threshold: float | None, count: int) -> None:
        if self.query is None:
            norm = math.sqrt(sum(x * x for x in query))
            self.query = [x / norm for x in query] if norm else []
        self.count = count
        v = row[embedding]
        if not v or not self.query or len(v) != len(self.query) or any(x is None or x != x for x in v):
            return
        norm = math.sqrt(sum(x * x for x in v))
        if not norm or math.isinf(norm):
            return
        similarity = round(sum(x * y for x, y in zip(self.query, v)) / norm, 9)
        if threshold is not None and not similarity > threshold:
            return
        self.seen += 1
        # rows come in the order of the argument, so of equal ones the first stays
        item = (similarity, -self.seen, tuple(row[f] for f in row.__fields__ if f != embedding))
        if len(self.best) < count:
            heapq.heappush(self.best, item)
        elif count and item > self.best[0]:
            heapq.heapreplace(self.best, item)

    def terminate(self):
        for similarity, _, row in sorted(self.best, reverse=True):
            yield (*row, similarity)


class MatchClaims(_Nearest):
    """``match_claims(TABLE(t) PARTITION BY (..) ORDER BY (claim_id), query_embedding, match_threshold, match_count, exclude_claim_id)``

    The ``match_count`` rows of each partition of ``t`` (claim_id, embedding and any others) that are more than ``match_threshold``
    similar to the query (cosine), most similar first, without the claim ``exclude_claim_id`` (null: none is left out).
    Rows whose vector is null, zero, of another length or not finite are none. The family goes into PARTITION BY, or into WHERE.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, query_embedding: AnalyzeArgument, match_threshold: AnalyzeArgument, match_count: AnalyzeArgument, exclude_claim_id: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _described(rows, "embedding")

    def eval(self, rows, query_embedding, match_threshold, match_count, exclude_claim_id=None):
        if exclude_claim_id is None or rows["claim_id"] != exclude_claim_id:
            self.offer(rows, "embedding", query_embedding, match_threshold, match_count)


class SearchClaims(_Nearest):
    """``search_claims(TABLE(t) PARTITION BY (..), query_embedding, match_count)``: as ``match_claims``, without threshold and
    exclusion; a document filter goes into WHERE."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, query_embedding: AnalyzeArgument, match_count: AnalyzeArgument) -> AnalyzeResult:
        return _described(rows, "embedding")

    def eval(self, rows, query_embedding, match_count):
        self.offer(rows, "embedding", query_embedding, None, match_count)


def register(spark: SparkSession) -> None:
    """Make ``match_claims`` and ``search_claims`` known to SQL."""
    spark.udtf.register("match_claims", udtf(MatchClaims))
    spark.udtf.register("search_claims", udtf(SearchClaims))
