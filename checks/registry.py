"""The registered queries: one or more per operator, most with the SQL that must agree."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import fixture, table, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Lazy access to tables and fixtures: ``x.f_links``, ``x.part``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        make = fixture if name.startswith("f_") else table
        return make(self.spark, self.sf_dir, name)

    def scratch(self) -> str:
        """A new folder for a round trip through files."""
        from stitchrank.operators.scale import shared_dir

        return f"{shared_dir(self.spark)}/check-{uuid.uuid4().hex}"


# Similarities are already rounded to nine decimals and fused scores to a binary grid of about
# that width; rounding them to fewer would round twice, and engines disagree on the halves that
# makes. Other doubles are compared to six decimals.
DIGITS = {"score": 9, "category_score": 9}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles cut to the decimals both engines agree on."""
    doubles = {c for c, t in df.dtypes if t == "double"}
    return df.select(
        *[(F.round(c, DIGITS.get(c, 6)) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def r6(expression: str, name: str) -> str:
    """SQL side of :func:`rounded`."""
    return f"round({expression}, {DIGITS.get(name, 6)}) + 0.0::double as {name}"


def grid(expression: str) -> str:
    """SQL side of ``stable``."""
    return f"(round_even(({expression}) * 1073741824.0::double, 0) / 1073741824.0::double)"


def vector_rows(df: DataFrame, *keys: str, v: str = "v") -> DataFrame:
    """A vector as (keys, pos, x) rows."""
    return df.select(*keys, F.posexplode(v).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def register(name: str, sql: str | None = None, *ctes: str):
    """Decorator for ``query(inputs) -> DataFrame``; ``sql`` may use fixtures and ``ctes``."""

    def wrap(query: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(query(Inputs(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, *ctes)
        return query

    return wrap


def load() -> None:
    """Import every module that registers queries, once."""
    from checks import queries_catalog, queries_rank, queries_retrieve, queries_text, queries_vectors  # noqa: F401
