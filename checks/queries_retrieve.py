"""Nearest products, their fusions and lookups: R*, S9 and the retrieval plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries_vectors import mean_of
from checks.registry import grid, r6, register
from stitchrank.operators import cells, contrastive, embeddings, evaluate, retrieve
from stitchrank.operators.scale import checkpointed
from stitchrank.plans import recommend
from stitchrank.sources import tables
from stitchrank.sources.maintained import MaintainedLists
from stitchrank.streaming.feed import start_feed
from stitchrank.streaming.lookup import lookup_stream

SCORE = "round(list_inner_product(q.v::double[], i.v::double[]), 9)"
NO_DATE = dict(weight=0.05, decay_hours=7200.0, date=0.04, month=0.03, quarter=0.02, penalty=-0.01)


def hits(k: int, name: str = "hits", queries: str = "f_crops", index: str = "f_index", key: str = "crop_id", on: str = "true", more: str = "") -> str:
    """CTE of the k nearest index rows per query, with score and rank."""
    return f"""{name} as (select q.* exclude (v), i.* exclude (v), {SCORE} as score{more},
        row_number() over (partition by q.{key} order by {SCORE} desc, i.product_id) as rank
      from {queries} q join {index} i on {on} qualify rank <= {k})"""


def fused(name: str, score: str, source: str = "hits") -> str:
    """CTE of one row per (bundle, product)."""
    return f"""{name} as (select bundle_id, product_id, {grid(score)} as score, any_value(section) as section, any_value(gender) as gender,
        any_value(category) as category, any_value(bundle_ts) as bundle_ts, any_value(product_ts) as product_ts from {source} group by 1, 2)"""


SECTION_OK = "(coalesce(section, 0) = 0 or gender in (0, section))"
ALONE = "bundle_id, category, case when category = '' then product_id end"


def capped(name: str, source: str, n: int = 2) -> str:
    """CTE after section filter and category cap."""
    return f"""{name} as (select * from {source} where {SECTION_OK}
        qualify row_number() over (partition by {ALONE} order by score desc, product_id) <= {n})"""


def best(source: str, n: int) -> str:
    return f"""select bundle_id, product_id, {r6('score', 'score')}, row_number() over (partition by bundle_id order by s desc, product_id) as rank
        from (select *, score as s from {source}) qualify rank <= {n}"""


def adjustment(b: str = "bundle_ts", p: str = "product_ts") -> str:
    """SQL of the time adjustment with the parameters NO_DATE."""
    bw, pw = f"make_timestamp({b} * 1000)", f"make_timestamp({p} * 1000)"
    t = NO_DATE
    return f"""case when {b} is null or {p} is null then 0.0::double else
        {t['weight']}::double * (2 * exp(-(abs({b} - {p}) / 1000.0::double / 3600) / {t['decay_hours']}::double) - 1) + case
          when {bw}::date = {pw}::date then {t['date']}::double when strftime({bw}, '%Y-%m') = strftime({pw}, '%Y-%m') then {t['month']}::double
          when year({bw}) = year({pw}) and quarter({bw}) = quarter({pw}) then {t['quarter']}::double else {t['penalty']}::double end end"""


CROPS = ["bundle_id", "crop_id", "v", "conf", "section", "bundle_ts"]
INDEX = ["product_id", "v", "category", "gender", "product_ts"]


def crops_index(x):
    return x.f_crops.select(*CROPS), x.f_index.select(*INDEX)


@register("R1_topk", f"select crop_id, product_id, {r6('score', 'score')}, rank from hits", hits(15))
def _(x):
    return retrieve.topk(x.f_crops.select("crop_id", "v"), x.f_index.select("product_id", "v"), 15)


# every other query has no id, and all others share one: still one list per row
KEYLESS = hits(5, queries="(select crop_id, case when crop_id % 2 = 0 then null else 1 end as shared, v from f_crops)")


def keyless(x):
    return x.f_crops.select("crop_id", F.expr("case when crop_id % 2 = 0 then null else 1 end as shared"), "v")


@register("R1_topk_repeated_keys", f"select crop_id, shared, product_id, {r6('score', 'score')}, rank from hits", KEYLESS)
def _(x):
    return retrieve.topk(keyless(x), x.f_index.select("product_id", "v"), 5)


@register("R1_topk_repeated_keys_blocks", f"select crop_id, shared, product_id, {r6('score', 'score')}, rank from hits", KEYLESS)
def _(x):
    return retrieve.topk(keyless(x), x.f_index.select("product_id", "v"), 5, broadcast_bytes=0, index_block=200, query_block=150)


@register("R1_topk_blocks", f"select crop_id, product_id, {r6('score', 'score')}, rank from hits", hits(15))
def _(x):
    # the plan for an index beyond the broadcast bound
    return retrieve.topk(
        x.f_crops.select("crop_id", "v"), x.f_index.select("product_id", "v"), 15, broadcast_bytes=0, index_block=200, query_block=150
    )


@register("R1_topk_cells", f"select crop_id, product_id, {r6('score', 'score')}, rank from hits", hits(15))
def _(x):
    # the plan that leaves out cells beyond reach; the index is built once and searched from its files
    index = cells.build_cells(x.f_index.select("product_id", "v"), cell_rows=20)
    return retrieve.topk(x.f_crops.select("crop_id", "v"), index, 15)


@register(
    "R1_topk_cells_sections",
    f"select crop_id, product_id, {r6('score', 'score')}, rank from hits",
    hits(15, queries="(select crop_id, v, section from f_crops)", index="(select product_id, v, gender from f_index)", on="q.section = i.gender"),
)
def _(x):
    index = cells.build_cells(x.f_index.select("product_id", "v", F.col("gender").alias("section")), by="section", cell_rows=20)
    return retrieve.topk(x.f_crops.select("crop_id", "v", "section"), index, 15, by="section").drop("section")


# vectors in clusters: pulled towards one vector of their label
CLUSTERED = """clustered as (select vec_id, list_transform(range(1, len(e) + 1), lambda i: c[i] + 0.25::double * e[i]) as v
    from (select vec_id, label, embedding::double[] as e from embeddings) join (select label, arg_min(embedding, vec_id)::double[] as c from embeddings group by 1) using (label))"""


def clustered(x):
    centers = x.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return x.embeddings.join(centers, "label").select("vec_id", F.zip_with("c", "embedding", lambda c, e: c.cast("double") + 0.25 * e.cast("double")).alias("v"))


@register(
    "R1_topk_cells_clustered",
    f"select crop_id, product_id, {r6('score', 'score')}, rank from hits",
    CLUSTERED,
    hits(15, queries="(select vec_id as crop_id, v from clustered)", index="(select vec_id as product_id, v from clustered)"),
)
def _(x):
    rows = checkpointed(clustered(x))
    index = cells.build_cells(rows.withColumnRenamed("vec_id", "product_id"), cell_rows=20)
    return retrieve.topk(rows.withColumnRenamed("vec_id", "crop_id"), index, 15)


@register(
    "R2_retrieve_max",
    f"""{best('capped', 15)} union all select bundle_id, product_id, null, position from f_images cross join (
          select cast(l_partkey as varchar) as product_id, row_number() over (order by count(*) desc, cast(l_partkey as varchar)) as position
          from lineitem group by l_partkey qualify position <= 15) where bundle_id not in (select bundle_id from f_crops)""",
    hits(5),
    fused("all_hits", "max(score)"),
    "good as (select * from all_hits where score >= 0.2)",
    capped("capped", "good"),
)
def _(x):
    crops, index = crops_index(x)
    return recommend.boxed(crops, index, x.f_images, x.f_links, threshold=0.2)


WEIGHTED = "sum(score * greatest(conf, 0.1::double))"


@register(
    "R3_retrieve_sum",
    best("capped", 15),
    hits(50),
    fused("all_hits", WEIGHTED),
    "good as (select * from all_hits where score >= 0.3)",
    capped("capped", "good"),
)
def _(x):
    return retrieve.retrieve_sum(*crops_index(x), threshold=0.3)


@register(
    "R3_retrieve_sum_time",
    best("moved", 15),
    hits(50),
    fused("all_hits", WEIGHTED),
    capped("capped", "all_hits"),
    f"moved as (select * replace ({grid('score + ' + adjustment())} as score) from capped)",
)
def _(x):
    return retrieve.retrieve_sum(*crops_index(x), ts=NO_DATE)


# class filter, category and article boost: the section-wise search
SEARCHED = (
    """topcat as (select q.crop_id, i.category as top_category from f_crops q cross join f_categories i
         qualify row_number() over (partition by q.crop_id order by """ + SCORE + """ desc, i.category) = 1)""",
    """searching as (select c.*, t.top_category, case when section in (1, 2, 3) then section else 1 end as search,
         cls in (select cls from f_taxonomy) as filtered from f_crops c join topcat t using (crop_id))""",
    "shelf as (select i.*, s.section as shelf, t.cls as category_cls from f_index i join (select distinct * from f_sections) s using (product_id) left join f_taxonomy t using (category))",
    hits(60, queries="searching", index="shelf", on="q.search = i.shelf"),
    """passed as (select * from hits where rank <= case when filtered then 60 else 20 end and (not filtered or category = '' or category_cls = cls)
         qualify row_number() over (partition by crop_id order by rank) <= 20)""",
    """boosted as (select * replace (score * greatest(conf, 0.1::double) * case when top_category <> '' and category = top_category then 1.4::double else 1.0::double end
         * case when bundle_article = article then 1000.0::double else 1.0::double end as score) from passed)""",
    fused("all_hits", "greatest(0.0::double, max(score))", "boosted"),
    f"""placed as (select *, row_number() over (partition by {ALONE} order by score desc, product_id) > 2 as late from all_hits where {SECTION_OK})""",
    """pooled as (select bundle_id, product_id, score, row_number() over (partition by bundle_id order by late, score desc, product_id) as rank
         from placed qualify rank <= 60)""",
)


@register("R4_retrieve_boosted", f"select bundle_id, product_id, {r6('score', 'score')}, rank from pooled", *SEARCHED)
def _(x):
    return retrieve.retrieve_boosted(x.f_crops, x.f_index, x.f_sections, x.f_categories, x.f_taxonomy)


@register(
    "R5_retrieve_top1",
    best("good", 6),
    hits(1, queries="(select * from f_crops where conf <> 0.6)"),
    "weighed as (select *, score * greatest(conf, 0.1::double) as w from hits where score * greatest(conf, 0.1::double) >= 0.35)",
    fused("all_hits", "arg_min(w, crop_id)", "weighed"),
    f"good as (select * from all_hits where {SECTION_OK})",
)
def _(x):
    return retrieve.retrieve_top1(*crops_index(x), threshold=0.35)


@register(
    "R6_section_index",
    "select s.section, i.product_id, i.gender from f_index i join (select distinct * from f_sections) s using (product_id)",
)
def _(x):
    return retrieve.section_index(x.f_index, x.f_sections).select("section", "product_id", "gender")


@register(
    "R6_section_topk",
    f"select crop_id, product_id, {r6('score', 'score')}, rank from hits",
    "searching as (select crop_id, v, case when section in (1, 2, 3) then section else 1 end as search from f_crops)",
    "shelf as (select product_id, v, section as shelf from f_index join (select distinct * from f_sections) using (product_id))",
    hits(10, queries="searching", index="shelf", on="q.search = i.shelf"),
)
def _(x):
    crops = x.f_crops.select("crop_id", "v", retrieve.search_section(F.col("section")).alias("search"))
    shelf = retrieve.section_index(x.f_index.select("product_id", "v"), x.f_sections).withColumnRenamed("section", "search")
    return retrieve.topk(crops, shelf, 10, by="search").drop("search")


@register(
    "R7_classify_crops",
    f"select crop_id, product_id as top_category, {r6('score', 'category_score')}, rank from hits",
    "named as (select category as product_id, v from f_categories)",
    hits(3, index="named"),
)
def _(x):
    return retrieve.classify_crops(x.f_crops.select("crop_id", "v"), x.f_categories)


@register(
    "R8_overfetch_filter",
    """select crop_id, product_id, row_number() over (partition by crop_id order by rank) as rank from hits
       where rank <= case when cls <> '' then 15 else 5 end and (cls = '' or category = '' or category in (select category from f_taxonomy t where t.cls = hits.cls))
       qualify row_number() over (partition by crop_id order by rank) <= 5""",
    hits(15),
)
def _(x):
    classes = x.f_taxonomy.select("category", F.col("cls").alias("category_cls"))
    index = x.f_index.select("product_id", "v", "category").join(classes, "category", "left")
    found = retrieve.topk(x.f_crops.select("crop_id", "v", "cls"), index, 15)
    allowed = (F.col("category") == "") | F.coalesce(F.col("category_cls") == F.col("cls"), F.lit(False))
    return retrieve.overfetch_filter(found, allowed, F.col("cls") != "", 5).select("crop_id", "product_id", "rank")


LOOKUP = f"""select crop_id, product_id, {r6('score', 'score')}, rank, coalesce(p.description, '') as description, format('{{:.4f}}', score) as score_text
    from hits left join f_products p using (product_id)"""


@register("R9_lookup_products", LOOKUP, hits(8))
def _(x):
    return retrieve.lookup_products(x.f_crops.select("crop_id", "v"), x.f_index, x.f_products)


@register("R10_lookup_stream", f"select crop_id, product_id, {r6('score', 'score')}, rank from hits", hits(8))
def _(x):
    stream = (
        x.spark.readStream.schema(x.embeddings.schema).parquet(f"{x.sf_dir}/embeddings.parquet*")  # a file or a folder of files
        .select(F.col("vec_id").alias("crop_id"), F.col("embedding").alias("v"))
    )
    folder = x.scratch()
    query = (
        lookup_stream(stream, x.f_index)
        .writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return x.spark.read.parquet(f"{folder}/out")


UNIT_MEANS = (
    mean_of("raw_means", "f_crops", "bundle_id"),
    "means as (select bundle_id, list_transform(v, lambda e: e / greatest(sqrt(list_inner_product(v, v)), 1e-8)) as v from raw_means)",
)


def bundle_queries(x):
    return embeddings.mean_regions(x.f_crops).select("bundle_id", "v")


@register(
    "R11_hard_negatives",
    f"""select bundle_id, product_id, {r6('score', 'score')}, row_number() over (partition by bundle_id order by rank) as rank from (
          select h.* from near h anti join f_truth t using (bundle_id, product_id)) qualify row_number() over (partition by bundle_id order by rank) <= 4""",
    *UNIT_MEANS,
    hits(16, name="near", queries="means", key="bundle_id"),
)
def _(x):
    found = retrieve.hard_negatives(bundle_queries(x), x.f_index, x.f_truth)
    return found.select("bundle_id", "product_id", "score", "rank")


@register(
    "S9_cached_topk",
    f"select bundle_id, product_id, {r6('score', 'score')}, rank from near",
    *UNIT_MEANS,
    hits(20, name="near", queries="means", key="bundle_id"),
)
def _(x):
    folder, queries, index = x.scratch(), bundle_queries(x), x.f_index.select("product_id", "v")
    tables.cached_topk(x.spark, folder, queries, index, 20)
    return tables.cached_topk(x.spark, folder, queries, index, 20)  # read back


# ------------------------------------------------------------------------------- plans


def metrics(ranked: str, truth: str, ks, join: str = "left join") -> tuple[str, ...]:
    """CTEs ``hit``, ``per`` and ``means`` for hit rate and recall at ``ks``."""
    counts = ", ".join(f"count(*) filter (rank <= {k}) as h{k}" for k in ks)
    return (
        f"hit as (select bundle_id, min(rank) as first_hit, {counts} from {ranked} join {truth} using (bundle_id, product_id) group by 1)",
        f"listed as (select distinct bundle_id from {ranked})",
        f"""per as (select t.bundle_id, t.n, first_hit, {', '.join(f'coalesce(h{k}, 0) as h{k}' for k in ks)}
              from (select bundle_id, count(*) as n from {truth} group by 1) t left join hit using (bundle_id)
              {'' if join == 'left join' else 'semi join listed using (bundle_id)'})""",
    )


def metric_rows(ks, count: str = "num_bundles_evaluated") -> str:
    parts = [f"select '{count}' as metric, 0 as k, count(*)::double as value from per"]
    for k in ks:
        parts.append(f"select 'hit', {k}, round(avg((h{k} > 0)::int::double), 6) + 0.0::double from per")
        parts.append(f"select 'recall', {k}, round(avg(h{k} / n::double), 6) + 0.0::double from per")
    return " union all ".join(parts)


@register(
    "plan_per_crop_metrics",
    metric_rows((5, 10, 15)),
    hits(50),
    fused("all_hits", WEIGHTED),
    capped("capped", "all_hits"),
    "listing as (select bundle_id, product_id, row_number() over (partition by bundle_id order by score desc, product_id) as rank from capped qualify rank <= 15)",
    *metrics("listing", "f_truth", (5, 10, 15)),
)
def _(x):
    return evaluate.hit_recall(recommend.per_crop(*crops_index(x)), x.f_truth)


@register(
    "plan_sectioned",
    """select bundle_id, product_id, cast(row_number() over (partition by bundle_id order by padded, pos) as int) as rank, padded from (
         select bundle_id, product_id, rank as pos, false as padded from short
         union all select b.bundle_id, f.product_id, f.pos, true from (select distinct bundle_id from f_images union select bundle_id from f_crops) b
           cross join popular f anti join short s on s.bundle_id = b.bundle_id and s.product_id = f.product_id)
       qualify row_number() over (partition by bundle_id order by padded, pos) <= 15""",
    *SEARCHED,
    "hubbed as (select bundle_id, product_id, "
    + grid("""score - 0.1::double * greatest(0, count(*) over (partition by product_id)
          / (select count(distinct bundle_id) from pooled)::double - 0.015::double)""")
    + " as score from pooled)",
    """short as (select bundle_id, product_id, row_number() over (partition by bundle_id order by score desc, product_id) as rank from hubbed qualify rank <= 15)""",
    """popular as (select cast(l_partkey as varchar) as product_id, row_number() over (order by count(*) desc, cast(l_partkey as varchar)) as pos
          from lineitem group by l_partkey qualify pos <= 30)""",
)
def _(x):
    from stitchrank.operators.catalog import most_popular, union_ids

    bundles = union_ids(x.f_images.select("bundle_id"), x.f_crops.select("bundle_id")).withColumnRenamed("id", "bundle_id")
    return recommend.sectioned(
        x.f_crops, x.f_index, x.f_sections, x.f_categories, x.f_taxonomy, bundles, most_popular(x.f_links, 30), hub={}
    )


@register(
    "R11_batch_losses",
    """select batch, n::int as pairs, round(avg(row_loss), 6) + 0.0::double as loss, round(avg(col_loss), 6) + 0.0::double as loss_products,
              round(coalesce(sum(gap) / nullif(sum(gaps), 0), 0), 6) + 0.0::double as hard_loss, count(*) filter (gaps > 0)::int as hard_rows
       from (select r.batch, n, r.row_loss, c.col_loss, h.gap, h.gaps from by_row r join by_col c on r.batch = c.batch and r.r = c.c
             join hard h on r.batch = h.batch and r.r = h.r) group by batch, n""",
    *UNIT_MEANS,
    "numbered as (select *, row_number() over (order by sha256('42||' || bundle_id || '||' || product_id)) - 1 as place from f_truth)",
    "dealt as (select n.*, place // 64 as batch, place % 64 as r, m.v as q, i.v::double[] as p from numbered n join means m using (bundle_id) join f_index i using (product_id))",
    """cells as (select a.batch, a.r, b.r as c, count(*) over (partition by a.batch, a.r) as n, list_inner_product(a.q, b.p) as sim, t.bundle_id is not null as hit
         from dealt a join dealt b using (batch) left join f_truth t on t.bundle_id = a.bundle_id and t.product_id = b.product_id)""",
    """by_row as (select batch, r, any_value(n) as n, ln(sum(exp(sim / 0.07::double))) - avg(sim / 0.07::double) filter (hit) as row_loss,
                      avg(sim) filter (hit) as own from cells group by 1, 2)""",
    "by_col as (select batch, c, ln(sum(exp(sim / 0.07::double))) - avg(sim / 0.07::double) filter (hit) as col_loss from cells group by 1, 2)",
    """hard as (select r.batch, r.r, sum(greatest(0, x.sim - r.own + 0.2::double)) as gap, count(x.sim) as gaps from by_row r left join (
         select *, row_number() over (partition by batch, r order by sim desc) as place from cells where not hit) x
         on r.batch = x.batch and r.r = x.r and x.place <= 16 group by 1, 2)""",
)
def _(x):
    # every true pair with the mean vector of its bundle, in batches of 64
    return contrastive.batch_losses(x.f_truth, bundle_queries(x), x.f_index, x.f_truth, batch_size=64)


# a feed from the events: every tenth asks, one kind of event deletes, all others replace a product's vector
KIND = "case when event_id % 10 = 0 then 'query' when event_type = 'click' then 'delete' else 'upsert' end"
NAME = "cast(case when event_id % 10 = 0 then event_id else user_id end as string)"


@register(
    "R10_feed",
    f"""select * from (with asked as (select * from feed where kind = 'query' and epoch_ms(ts) <= (select epoch_ms(max(ts)) - 600000 from feed)),
        seen as (select a.id as query_id, a.v as q, c.id as product_id, c.kind, c.v,
                        row_number() over (partition by a.id, c.id order by c.ts desc, c.version desc) as age
                 from asked a join feed c on c.kind <> 'query' and c.ts <= a.ts),
        scored as (select query_id, product_id, round(list_inner_product(q, v), 9) as score from seen where age = 1 and kind = 'upsert')
        select query_id, product_id, {r6('score', 'score')}, row_number() over (partition by query_id order by score desc, product_id) as rank
        from scored qualify rank <= 8)""",
    f"""feed as (select ts, kind, id, version, e.embedding::double[] as v from (
          select ts, {KIND} as kind, {NAME} as id, event_id as version, (event_id * 7 + user_id) % (select count(*) from embeddings) as vec_id from events) join embeddings e using (vec_id))""",
)
def _(x):
    vectors = x.embeddings.select("vec_id", F.col("embedding").alias("v"))
    n = vectors.count()
    # the whole table as a stream of files
    stream = x.spark.readStream.schema(x.events.schema).parquet(f"{x.sf_dir}/events.parquet*")
    rows = stream.select(
        "ts", F.expr(KIND).alias("kind"), F.expr(NAME).alias("id"), F.col("event_id").alias("version"),
        ((F.col("event_id") * 7 + F.col("user_id")) % n).alias("vec_id"),
    ).join(vectors, "vec_id")
    out, checkpoint = x.scratch(), x.scratch()
    start_feed(rows, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), checkpoint, buckets=8).awaitTermination()
    return x.spark.read.option("basePath", out).parquet(f"{out}/batch=*").select("query_id", "product_id", "score", "rank")


# a version later: products gone, replaced by their reverse, and new
CHANGED = """changed as (select product_id, case when product_id::int % 7 = 0 then null when product_id::int % 11 = 0 then list_reverse(v) else v end as v from f_index
    union all select 'n' || product_id, list_reverse(v) from f_index where product_id::int % 13 = 0)"""


@register(
    "S9_maintained_lists",
    f"select crop_id, product_id, {r6('score', 'score')}, rank from hits",
    CHANGED,
    hits(15, queries="(select crop_id, v from f_crops)", index="(select * from changed where v is not null)"),
)
def _(x):
    index, number = x.f_index.select("product_id", "v"), F.col("product_id").cast("int")
    lists = MaintainedLists.create(x.spark, x.scratch(), x.f_crops.select(F.col("crop_id").alias("query_id"), "v"), index, 15)
    lists.apply(index.where(number % 7 == 0).select("product_id", F.lit(None).cast("array<double>").alias("v")))
    moved = index.where((number % 11 == 0) & (number % 7 != 0)).select("product_id", F.reverse("v").alias("v"))
    lists.apply(moved.unionByName(index.where(number % 13 == 0).select(F.concat(F.lit("n"), "product_id").alias("product_id"), F.reverse("v").alias("v"))))
    return lists.lists().select(F.col("query_id").cast("long").alias("crop_id"), "product_id", "score", "rank")
