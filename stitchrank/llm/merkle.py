"""Operator 13: a Merkle manifest of a dataset, its proofs and their verification, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchrank.llm.common import partitions, table, written

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPER = 5


def field(c: Column) -> Column:
    """A value as hashed: ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def joined(digests: list[Column]) -> Column:
    """Hex digests in slot order; empty slots are null and add nothing."""
    return F.concat_ws("", *digests)


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (source, doc_id, digest, claimed) with ``tree`` (place of the source among the sources), ``place`` in the
    source and ``leaves_in`` (rows of the source).

    Rows are range-sorted by source, id and digests (nulls first), with the place in the scan as the last key, so that
    a hot source or id is cut like any other. Rows of one partition and source are consecutive, so one narrow aggregate
    per (partition, source) gives every shift; no window sees a row of the data.
    """
    keys = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest").asc(), F.col("claimed").asc(), F.col("_tie").asc()]
    tied = leaves.withColumn("_tie", F.monotonically_increasing_id())
    lined = tied.repartitionByRange(partitions(leaves.sparkSession), *keys).sortWithinPartitions(*keys).drop("_tie")
    lined = written(lined.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = lined.groupBy("_part", "source").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # One row per partition and source: at most partitions + sources rows, by source in every window but the last.
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        runs.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("leaves_in", F.sum("_n").over(Window.partitionBy("source")))
    )
    # The first row of a source is at its smallest place in the global order, so places order the sources.
    heads = written(runs.groupBy("source").agg(F.min("_first").alias("_head")))
    ranked = ranks(heads, "_head")
    runs = runs.select(F.col("_part").alias("_run"), F.col("source").alias("_of"), "_first", "_shift", "leaves_in")
    runs = runs.join(ranked, F.col("_of").eqNullSafe(F.col("_source"))).drop("_source")
    return (
        lined.join(runs, (F.col("_part") == F.col("_run")) & F.col("source").eqNullSafe(F.col("_of")))
        .select(*leaves.columns, "tree", (F.col("_at") - F.col("_first") + F.col("_shift")).alias("place"), "leaves_in")
    )


def ranks(heads: DataFrame, by: str) -> DataFrame:
    """(_source, tree): 0-based rank of every source by ``by``, which is a place ``partition << 33 | row``.

    Ranked inside the partition of its first leaf and shifted by the sources of the partitions before.
    """
    part = F.shiftright(by, 33)
    local = heads.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1)
    sizes = heads.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the sort.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return local.join(F.broadcast(offsets), "_part").select(F.col("source").alias("_source"), (F.col("_offset") + F.col("_rank")).cast("long").alias("tree"))


def slots(children: DataFrame, values: list[str], fanout: int) -> DataFrame:
    """(tree, node, leaves_in, s0, ..., s<fanout-1>): the children of each parent spread into columns, by place.

    Children lie in range order, so the aggregate on the map side already brings nearly all of a parent together.
    """
    slot = F.col("place") % fanout
    value = F.struct(*values)
    return children.groupBy("tree", F.floor(F.col("place") / fanout).alias("node"), "leaves_in").agg(
        *[F.max(F.when(slot == i, value)).alias(f"s{i}") for i in range(fanout)]
    )


def grow(leaves: DataFrame, values: list[str], fanout: int) -> list[DataFrame]:
    """The written levels of all trees, lowest first: slot columns and the parent's digest.

    A tree of one leaf has a parent too, whose digest is the leaf's own; ``leaves_in`` tells it. A tree takes part
    in level k while level k - 1 has several of its nodes. ``values`` begins with ``digest``.
    """
    columns = [F.col(f"s{i}.digest") for i in range(fanout)]
    digest = F.when(F.col("leaves_in") == 1, F.col("s0.digest")).otherwise(F.sha2(joined(columns), 256))
    levels = [written(slots(leaves, values, fanout).withColumn("digest", digest))]
    largest = levels[0].agg(F.max("leaves_in")).first()[0] or 0
    width = fanout
    while width < largest:
        several = levels[-1].where(F.col("leaves_in") > width).withColumnRenamed("node", "place")
        levels.append(written(slots(several, ["digest"], fanout).withColumn("digest", digest)))
        width *= fanout
    return levels


def step(i: int, fanout: int) -> Column:
    """The siblings of slot ``i``: all slot columns but its own, those before and those after it.

    A lone leaf has no step; a run of one node has an empty one.
    """
    columns = [F.col(f"s{j}.digest") for j in range(fanout)]
    both = F.struct(joined([F.lit(""), *columns[:i]]).alias("ahead"), joined([F.lit(""), *columns[i + 1 :]]).alias("behind"))
    return F.when(F.col("leaves_in") > 1, F.array(both)).otherwise(F.array().cast("array<struct<ahead:string,behind:string>>"))


def tops(levels: list[DataFrame], k: int, fanout: int) -> DataFrame:
    """The root rows of the trees that end at level ``k``."""
    width = fanout ** (k + 1)
    return levels[k].where((F.col("leaves_in") <= width) & ((F.col("leaves_in") > width // fanout) | F.lit(k == 0)))


def subroots(levels: list[DataFrame], fanout: int) -> DataFrame:
    """(tree, subroot) of every tree."""
    out = None
    for k in range(len(levels)):
        part = tops(levels, k, fanout).select("tree", F.col("digest").alias("subroot"))
        out = part if out is None else out.unionByName(part)
    return out


def proofs(levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """The leaf values of all trees with ``path``: the steps from the leaf to the end of ``above``.

    ``above`` (tree, path, ...) holds what follows a tree's own root; its further columns stay. Paths go down one
    level at a time: a parent's row holds all children, so only the parents' paths are shuffled, never the leaves.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        here = tops(levels, k, fanout).select("tree", "node").join(above, "tree")
        paths = here if paths is None else paths.unionByName(here)
        rows = levels[k].join(paths, ["tree", "node"])
        children = F.array(*[
            F.when(F.col(f"s{i}").isNotNull(), F.struct(F.lit(i).alias("slot"), F.col(f"s{i}").alias("value"), F.concat(step(i, fanout), "path").alias("path")))
            for i in range(fanout)
        ])
        each = rows.select("tree", "node", *extra, F.explode(F.filter(children, lambda c: c.isNotNull())).alias("child"))
        if k == 0:
            return each.select("tree", *extra, "child.value.*", "child.path")
        paths = each.select("tree", (F.col("node") * fanout + F.col("child.slot")).alias("node"), F.col("child.path").alias("path"), *extra)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda acc, x: F.sha2(F.concat(x["ahead"], acc, x["behind"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from leaf to root, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["ahead"], x["behind"]))), 256)


def manifest(docs: DataFrame, fanout: int = FANOUT, suspect: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, claimed and root_claimed of every row of ``docs``.

    ``docs`` has the columns of documents; a column ``claimed_text``, where it has one, is the text that is checked
    against the manifest. ``claimed`` is the digest of the row with that text, ``root_claimed`` the root it leads to. Every
    null is a value of its own (``-``); null ids and sources come first. Rows equal in id are ordered by digest,
    equal rows are leaves of their own. An empty table gives no rows. Further columns of ``docs`` may have any names.
    """
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = leaf_digest(*head, F.col("text"))
    claimed = leaf_digest(*head, F.col("claimed_text")) if "claimed_text" in docs.columns else leaf
    leaves = docs.select("source", "doc_id", leaf.alias("digest"), claimed.alias("claimed"))
    levels = grow(numbered(leaves), ["digest", "doc_id", "claimed"], fanout)
    roots = written(subroots(levels, fanout))
    # The sources' tree: one tree of subroots by the rank of their source.
    total = roots.count()
    top = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(total).cast("long").alias("leaves_in"), F.col("subroot").alias("digest"))
    sources = grow(top.withColumn("member", F.col("place")), ["digest", "member"], fanout)
    none = F.array().cast("array<struct<ahead:string,behind:string>>")
    start = subroots(sources, fanout).select("tree", F.col("subroot").alias("root"), none.alias("path"))
    above = proofs(sources, start, fanout).select(F.col("member").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    found = proofs(levels, written(above), fanout)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "claimed", fold(F.col("claimed"), F.col("path")).alias("root_claimed"))


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    tampered = docs.withColumn("claimed_text", F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))
    return manifest(tampered).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        F.col("root_claimed").alias("folded_root"), (F.col("root_claimed") == F.col("root")).alias("verified"),
    )


# Levels are built by recursion until one node is left; a proof gathers the siblings of each level. CRC-32 by its rule.
OP13_SQL = r"""
with recursive crc_table as (
  select list(v order by n) as t from (
    select n, list_reduce(list_concat([n::bigint], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                          lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
    from range(256) r(n))),
fields as (
  select *, hex(encode(doc_id::varchar)) as h,
         coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') || coalesce(strlen(source)::varchar || ':' || source, '-')
         || coalesce(strlen(lang)::varchar || ':' || lang, '-') || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') as head
  from documents),
leaves as (
  select doc_id, source, sha256(head || coalesce(strlen(text)::varchar || ':' || text, '-')) as leaf,
         case when xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint)),
                                   lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::bigint % 5 = 0
              then sha256(head || coalesce(strlen(text)::varchar || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as tampered
  from fields, crc_table),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, tampered) - 1 as place from leaves),
nodes(level, source, place, digest, several) as (
  select 0, source, place, leaf, count(*) over (partition by source) > 1 from placed
  union all
  (select level + 1, source, place // 16, sha256(string_agg(digest, '' order by place)),
          count(*) over (partition by source) > 1
   from nodes where several group by level, source, place // 16)),
subroots as (
  select source, digest as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n
  from nodes where not several),
upper_nodes(level, place, digest, several) as (
  select 0, place, subroot, n > 1 from subroots
  union all
  (select level + 1, place // 16, sha256(string_agg(digest, '' order by place)), count(*) over () > 1
   from upper_nodes where several group by level, place // 16)),
root as (select digest as root from upper_nodes where not several),
steps as (
  select a.level, a.source, a.place,
         coalesce(string_agg(b.digest, '' order by b.place) filter (where b.place < a.place), '') as ahead,
         coalesce(string_agg(b.digest, '' order by b.place) filter (where b.place > a.place), '') as behind
  from nodes a join nodes b on a.level = b.level and a.source is not distinct from b.source and a.place // 16 = b.place // 16
  where a.several group by a.level, a.source, a.place),
upper_steps as (
  select a.level, a.place,
         coalesce(string_agg(b.digest, '' order by b.place) filter (where b.place < a.place), '') as ahead,
         coalesce(string_agg(b.digest, '' order by b.place) filter (where b.place > a.place), '') as behind
  from upper_nodes a join upper_nodes b on a.level = b.level and a.place // 16 = b.place // 16
  where a.several group by a.level, a.place),
lower_paths as (
  select p.source, p.place, list({'a': s.ahead, 'b': s.behind} order by s.level) as path
  from placed p join steps s on p.source is not distinct from s.source and s.place = p.place // (16 ** s.level)::bigint
  group by p.source, p.place),
upper_paths as (
  select u.source, list({'a': s.ahead, 'b': s.behind} order by s.level) as path
  from subroots u join upper_steps s on s.place = u.place // (16 ** s.level)::bigint group by u.source),
paths as (
  select p.doc_id, p.leaf, p.tampered, u.subroot, list_concat(coalesce(l.path, []), coalesce(x.path, [])) as path
  from placed p join subroots u on p.source is not distinct from u.source
  left join lower_paths l on p.source is not distinct from l.source and p.place = l.place
  left join upper_paths x on p.source is not distinct from x.source),
folded as (
  select *, sha256(array_to_string(list_transform(path, lambda x: x.a || x.b), '')) as proof_sha256,
         list_reduce(list_concat([{'a': coalesce(tampered, leaf), 'b': ''}], path), lambda y, x: {'a': sha256(x.a || y.a || x.b), 'b': ''}).a as folded_root
  from paths)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded, root
"""
