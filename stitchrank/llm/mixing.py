"""Operator 1: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchrank.llm.common import WORD, bounded, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
# Sources are joined by broadcast up to this many, by a shuffle beyond.
MOST_SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number in [0, 1) from the seed and the id; a row without id draws by its text."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("binary")), F.lit(""))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, size).

    The cap of ``limit`` times the source and the resharing of the excess have a closed form: with
    sources in order of capacity per weight, the capped ones are a prefix of that order, and all
    others get weight times one level. Sizes are summed on the map side first, so a hot source is no
    hot task; the windows see one row per source, a table the size of the list of weights.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    level = (F.col("_total") * F.lit(share) - F.col("_before")) / F.col("_rest")
    return (
        sources.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * limit)
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("_before", F.sum("_cap").over(by_ratio) - F.col("_cap"))
        .withColumn("_rest", F.sum("_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        # Of the sources whose capacity is not below their part, the first sets the level; it is the highest.
        .withColumn("_level", F.max(F.when(F.col("_ratio") >= level, level)).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("_ratio") <= F.coalesce("_level", F.lit(float("inf"))), F.col("_cap").cast("double")).otherwise(F.col("_weight") * F.col("_level")))
        .select("source", "source_size", "target")
    )


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = 7) -> DataFrame:
    """(row, size, source_size, target, copies): the columns of every row of ``docs`` and how often the mix takes it.

    A row is taken floor(rate) times and once more with the probability of the fraction, by a draw
    seeded with its id. Null or empty texts have size 0 and are taken at their source's rate like any
    other; a source of size 0 has rate 0. Null sources form one source, the last in order. Equal rows
    draw alike. An empty table gives an empty plan. Further columns of ``docs`` may have any names.
    """
    sizes = docs.select("source", n_words().alias("size"))
    targets = bounded(written(source_targets(sizes, weights, share, limit)), MOST_SOURCES)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words().alias("size"), draw(seed).alias("draw"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = F.when(F.col("draw") < rate - F.floor(rate), 1).otherwise(0)
    return (
        rows.join(targets, rows["row.source"].eqNullSafe(targets["source"]), "left")
        .select("row", "size", "source_size", "target", (F.floor(rate) + extra).cast("int").alias("copies"))
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as :func:`mix_plan` takes it."""
    plan = mix_plan(docs, **settings).where("copies > 0")
    return plan.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def op1_mixing(spark, sf_dir):
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
with sized as (
  select *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
         source_size * 2 as cap from sources),
ordered as (
  select *, cap::double / weight as ratio, sum(source_size) over () as total from weighted),
sums as (
  select *, (sum(cap) over w - cap)::bigint as before,
         sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as rest
  from ordered window w as (order by ratio, source nulls last rows between unbounded preceding and current row)),
levels as (select *, (total::double * 1.5::double - before::double) / rest::double as level from sums),
free as (select max(level) as level from levels where ratio >= level),
targets as (
  select s.source, s.source_size,
         case when s.ratio <= coalesce((select level from free), 'infinity'::double) then s.cap::double
              else s.weight * (select level from free) end as target
  from levels s),
plan as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
         ('0x' || substr(md5('7|' || coalesce(d.doc_id::varchar, md5(d.text), '')), 1, 8))::bigint / 4294967296.0::double as draw
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken
from plan
"""
