"""S9, S10 under change: a versioned index, and candidate lists that are kept up to date without a new search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stitchrank.operators.retrieve import topk
from stitchrank.operators.scale import checkpointed

BEST = ("score", "product_id")


class MaintainedLists:
    """Lists of the ``k`` nearest products per query in a folder, equal at every version to a search from nothing.

    ``index/version=n`` holds the products that version n adds, replaces or (``v`` null) deletes, ``queries/version=n``
    the queries it adds or replaces, ``lists/version=n`` the whole list of every query whose list it changes; the newest row or list of
    an id counts. ``log/version=n`` is written last and makes a version one: what a failed attempt left is
    overwritten by the next. Ids are strings and not null; scores tie by ``product_id``.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    # Tables

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

    def _read(self, name: str, schema: str) -> DataFrame:
        """The committed rows of a table, with their version."""
        whole = T._parse_datatype_string(f"{schema}, version int")
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows.where(F.col("version") <= self.version())

    def log(self) -> DataFrame:
        """One row per version: k, products changed, lists searched again, pairs scored, and pairs of a search from nothing."""
        schema = "k int, changed bigint, lists bigint, searched bigint, scored bigint, all_pairs bigint, version int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/log")

    def version(self) -> int:
        return self.log().agg(F.max("version")).first()[0]

    def k(self) -> int:
        return self.log().agg(F.max("k")).first()[0]

    def _latest(self, name: str, key: str) -> DataFrame:
        rows = self._read(name, f"{key} string, v array<double>")
        newest = rows.groupBy(key).agg(F.max_by("v", "version").alias("v"))
        return newest.where(F.col("v").isNotNull())

    def index(self) -> DataFrame:
        """product_id, v of the products that exist."""
        return self._latest("index", "product_id")

    def queries(self) -> DataFrame:
        return self._latest("queries", "query_id")

    def lists(self) -> DataFrame:
        """query_id, product_id, score and rank of the newest lists."""
        rows = self._read("lists", "query_id string, product_id string, score double, rank int")
        newest = rows.groupBy("query_id").agg(F.max("version").alias("version"))
        # An emptied list is one row without a product.
        return rows.join(newest, ["query_id", "version"]).where(F.col("product_id").isNotNull()).drop("version")

    # Versions

    @staticmethod
    def _rows(df: DataFrame, key: str) -> DataFrame:
        rows = checkpointed(df.select(F.col(key).cast("string").alias(key), F.col("v").cast("array<double>").alias("v")))
        size = rows.agg(F.count("*"), F.countDistinct(key)).first()
        if size[0] != size[1]:
            raise ValueError(f"{key} is null or not unique")
        return rows

    def _commit(self, version: int, k: int, changed: int, lists: int, searched: int, scored: int, pairs: int) -> None:
        row = [(k, changed, lists, searched, scored, pairs)]
        self._write(self.spark.createDataFrame(row, "k int, changed bigint, lists bigint, searched bigint, scored bigint, all_pairs bigint").coalesce(1), "log", version)

    @classmethod
    def create(cls, spark: SparkSession, path: str, queries: DataFrame, index: DataFrame, k: int) -> MaintainedLists:
        """Version 0: ``queries`` (query_id, v) searched over ``index`` (product_id, v)."""
        new = cls(spark, path)
        asked, products = new._rows(queries, "query_id"), new._rows(index, "product_id")
        new._write(products, "index", 0)
        new._write(asked, "queries", 0)
        new._write(new._whole(asked, topk(asked, products, k)), "lists", 0)
        n, m = asked.where("v is not null").count(), products.where("v is not null").count()
        new._commit(0, k, m, n, n, n * m, n * m)
        return new

    @staticmethod
    def _whole(asked: DataFrame, hits: DataFrame) -> DataFrame:
        """Lists of all ``asked``, with a row without product for an empty one."""
        return asked.select("query_id").join(hits.select("query_id", "product_id", "score", "rank"), "query_id", "left")

    def apply(self, changes: DataFrame | None = None, queries: DataFrame | None = None) -> dict[str, int]:
        """The next version: products added, replaced or (``v`` null) deleted, and queries added or replaced.

        A list that held a changed product has lost an entry and is searched again, as are new queries; but not a list
        shorter than ``k``, which held all products there were. All others meet the new vectors only. Returns the
        row of the log.
        """
        spark, k, version = self.spark, self.k(), self.version() + 1
        none = spark.createDataFrame([], "product_id string, query_id string, v array<double>")
        changes = self._rows(none if changes is None else changes, "product_id")
        fresh = self._rows(none if queries is None else queries, "query_id")
        lists = self.lists()
        self._write(changes, "index", version)
        self._write(fresh, "queries", version)
        asked = self.queries().join(fresh.select("query_id"), "query_id", "left_anti").unionByName(fresh.where("v is not null"))
        products = self.index().join(changes.select("product_id"), "product_id", "left_anti").unionByName(changes.where("v is not null"))
        added = changes.where("v is not null")
        lost = lists.join(changes.select("product_id"), "product_id", "left_semi").select("query_id").distinct()
        full = lists.where(F.col("rank") == k).select("query_id")
        again = checkpointed(
            lost.join(full, "query_id", "left_semi").unionByName(fresh.select("query_id")).distinct()
        )
        searched = asked.join(again, "query_id", "left_semi")
        others = asked.join(again, "query_id", "left_anti")
        kept = lists.join(again, "query_id", "left_anti").join(changes.select("product_id"), "product_id", "left_anti")
        met = topk(others, added, k)
        merged = kept.select("query_id", "product_id", "score").unionByName(met.select("query_id", "product_id", "score"))
        best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("product_id"))
        ranked = merged.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        # Only lists that lost an entry or took one in are written.
        gained = ranked.join(added.select("product_id"), "product_id", "left_semi").select("query_id")
        touched = lost.unionByName(gained).distinct().join(again, "query_id", "left_anti")
        out = self._whole(touched, ranked).unionByName(self._whole(again, topk(searched, products, k)))
        self._write(out, "lists", version)
        n, n_again, n_others, m, n_added = (df.count() for df in (asked, searched, others, products, added))
        written = spark.read.parquet(f"{self.path}/lists/version={version}").select("query_id").distinct().count()
        scored = n_again * m + n_others * n_added
        self._commit(version, k, changes.count(), written, n_again, scored, n * m)
        return {"changed": changes.count(), "lists": written, "searched": n_again, "scored": scored, "all_pairs": n * m}

    def compact(self, path: str) -> MaintainedLists:
        """The newest version as version 0 of a new folder, without tombstones and old rows."""
        new = MaintainedLists(self.spark, path)
        asked, products = self.queries(), self.index()
        new._write(products, "index", 0)
        new._write(asked, "queries", 0)
        new._write(self._whole(asked, self.lists()), "lists", 0)
        n, m = asked.count(), products.count()
        new._commit(0, self.k(), m, n, 0, 0, n * m)
        return new
