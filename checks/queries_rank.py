"""Rerankers, ensembles, evaluation and listwise learning: F*, H*, M*, N5-N8."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries_retrieve import (
    ALONE,
    NO_DATE,
    SECTION_OK,
    UNIT_MEANS,
    WEIGHTED,
    adjustment,
    best,
    bundle_queries,
    crops_index,
    fused,
    hits,
    metric_rows,
    metrics,
)
from checks.queries_text import ARTICLE
from checks.queries_vectors import features, mean_of
from checks.registry import grid, r6, register
from stitchrank.operators import catalog, ensemble, evaluate, listwise, mlp, rank, retrieve, splits
from stitchrank.operators.scale import checkpointed
from stitchrank.plans import prepare, recommend
from stitchrank.sources import sinks, tables

# ------------------------------------------------------------------- filters and reranks

RANKED = (
    hits(20),
    fused("fused", WEIGHTED),
    "ranked as (select bundle_id, product_id, score, row_number() over (partition by bundle_id order by score desc, product_id) as rank from fused qualify rank <= 60)",
)
SCORED = f"select bundle_id, product_id, {r6('score', 'score')}"
ORDERED = "row_number() over (partition by bundle_id order by {0} desc, product_id)"


def ranked(x, n: int = 60):
    return retrieve.retrieve_sum(*crops_index(x), per_crop=20, final_k=n, gender_filter=False, max_per_category=0)


def stored(x):
    """The list written once, for operators that read it several times."""
    return checkpointed(ranked(x))


def described(x):
    return x.f_index.select("product_id", F.col("category").alias("description"))


@register("F1_score_threshold", f"{SCORED} from ranked where score >= 0.5", *RANKED)
def _(x):
    return rank.score_threshold(ranked(x), 0.5).drop("rank")


@register(
    "F2_section_filter",
    f"""{SCORED} from ranked join (select distinct bundle_id, section from f_crops) using (bundle_id) join (select product_id, gender from f_index) using (product_id)
        where {SECTION_OK}""",
    *RANKED,
)
def _(x):
    kept = rank.section_filter(ranked(x), x.f_crops.select("bundle_id", "section").distinct(), x.f_index)
    return kept.select("bundle_id", "product_id", "score")


WITH_CATEGORY = "cat as (select r.*, i.category from ranked r join f_index i using (product_id))"


@register(
    "F3_category_cap",
    f"{SCORED} from cat qualify row_number() over (partition by {ALONE} order by cat.score desc, product_id) <= 2",
    *RANKED,
    WITH_CATEGORY,
)
def _(x):
    return rank.category_cap(ranked(x), 2, described(x)).select("bundle_id", "product_id", "score")


@register(
    "F4_category_cap_backfill",
    f"""{SCORED}, row_number() over (partition by bundle_id order by late, s desc, product_id) as rank from (
          select * exclude (rank), score as s, row_number() over (partition by {ALONE} order by score desc, product_id) > 2 as late from cat) qualify rank <= 40""",
    *RANKED,
    WITH_CATEGORY,
)
def _(x):
    return rank.category_cap_backfill(ranked(x), 2, 40, described(x)).select("bundle_id", "product_id", "score", "rank")


@register(
    "F5_ts_rerank",
    best("moved", 60),
    *RANKED,
    f"""moved as (select bundle_id, product_id, {grid('score + ' + adjustment())} as score from ranked
          join (select distinct bundle_id, bundle_ts from f_crops) using (bundle_id) join (select product_id, product_ts from f_index) using (product_id))""",
)
def _(x):
    moved = rank.ts_rerank(ranked(x), x.f_crops.select("bundle_id", "bundle_ts").distinct(), x.f_index, **NO_DATE)
    return rank.top_n(moved, 60).select("bundle_id", "product_id", "score", "rank")


@register(
    "F6_hubness",
    best("moved", 15),
    *RANKED,
    "moved as (select bundle_id, product_id, "
    + grid("""score - 0.5::double * greatest(0, count(*) over (partition by product_id)
          / (select count(distinct bundle_id) from ranked)::double - 0.1::double)""")
    + " as score from ranked)",
)
def _(x):
    return rank.top_n(rank.hubness(stored(x), 0.1, 0.5), 15)


OTHER = "list_transform(list_reverse({0}), lambda e: e / greatest(sqrt(list_inner_product({0}, {0})), 1e-8))"


@register(
    "F7_late_interaction",
    best("mixed", 15),
    *RANKED,
    f"second as (select bundle_id, crop_id, {OTHER.format('v')} as v from (select bundle_id, crop_id, v::double[] as v from f_crops where section <> 2))",
    f"third as (select product_id, {OTHER.format('v')} as v from (select product_id, v::double[] as v from f_index where category <> ''))",
    """heavy as (select r.bundle_id, r.product_id, max(list_inner_product(c.v, p.v)) as h from ranked r join third p using (product_id)
         join second c using (bundle_id) group by 1, 2)""",
    f"""mixed as (select bundle_id, product_id, {grid('coalesce(0.6::double * score + 0.4::double * h, score)')} as score
         from ranked left join heavy using (bundle_id, product_id))""",
)
def _(x):
    # another encoder for every vector
    part = F.reverse("v").alias("v")
    crops2 = x.f_crops.filter("section <> 2").select("bundle_id", "crop_id", part)
    index2 = x.f_index.filter("category <> ''").select("product_id", part)
    return rank.top_n(rank.late_interaction(stored(x), crops2, index2), 15)


Z = """z as (select *, case when stddev_pop(score) over (partition by bundle_id) > 1e-6
    then (score - avg(score) over (partition by bundle_id)) / stddev_pop(score) over (partition by bundle_id) else 0.0::double end as z from ranked)"""
DIM = 64
WEIGHTS = [((i * 7) % 11 - 5) / 64 for i in range(2 * DIM + 1)]
WEIGHT_LIST = "[" + ", ".join(f"{w}::double" for w in WEIGHTS) + "]"


def linear_model():
    return listwise.make_model([([[w] for w in WEIGHTS], [0.25])], DIM)


@register(
    "F8_learned_rerank",
    # next to -1e9 a double has no sixth decimal
    best("learned", 60).replace("round(score, 9)", "round(score, 4)"),
    *RANKED,
    Z,
    mean_of("raw_means", "f_crops", "bundle_id", "greatest(conf, 0.1::double)"),
    "queries as (select bundle_id, list_transform(v, lambda e: e / greatest(sqrt(list_inner_product(v, v)), 1e-8)) as q from raw_means)",
    f"""m as (select bundle_id, product_id, list_inner_product({WEIGHT_LIST}, {features('q', 'p', str(DIM))}) + 0.25::double as m
          from z join queries using (bundle_id) join (select product_id, v::double[] as p from f_index where category <> '') using (product_id))""",
    f"""learned as (select z.bundle_id, z.product_id, {grid('coalesce(m.m, -1e9::double) + 0.2::double * z')} as score
          from z left join m using (bundle_id, product_id))""",
)
def _(x):
    index = x.f_index.filter("category <> ''")
    learned = listwise.learned_rerank(stored(x), x.f_crops, index, linear_model())
    return learned.select("bundle_id", "product_id", F.round("score", 4).alias("score"), "rank")


@register("F9_zscore", f"select bundle_id, product_id, {r6('score', 'score')}, {r6('z', 'z')}, rank from z", *RANKED, Z)
def _(x):
    return rank.zscore(stored(x))


@register("F10_top_n", best("fused", 15), hits(20), fused("fused", WEIGHTED))
def _(x):
    return rank.top_n(ranked(x, 10_000), 15)


POPULAR = """popular as (select cast(l_partkey as varchar) as product_id, row_number() over (order by count(*) desc, cast(l_partkey as varchar)) as pos
    from lineitem group by l_partkey qualify pos <= 30)"""


@register(
    "F11_pad",
    """select bundle_id, product_id, row_number() over (partition by bundle_id order by padded, pos) as rank, padded from (
         select bundle_id, product_id, rank as pos, false as padded from held
         union all select b.bundle_id, f.product_id, f.pos, true from (select distinct bundle_id from f_bundles) b
           cross join popular f anti join held h on h.bundle_id = b.bundle_id and h.product_id = f.product_id)
       qualify row_number() over (partition by bundle_id order by padded, pos) <= 15""",
    "held as (select distinct on (bundle_id, product_id) * from f_submissions where submission = 1 and rank <= 15 order by bundle_id, product_id, rank)",
    POPULAR,
)
def _(x):
    held = x.f_submissions.filter("submission = 1 and rank <= 15")
    held = catalog.keep_first(held, ["bundle_id", "product_id"], ["rank"])[0]
    return rank.pad(held, x.f_bundles, catalog.most_popular(x.f_links, 30), 15)


@register(
    "F12_rank_by",
    "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as rank from events",
)
def _(x):
    return rank.rank_by(x.events, ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "rank")


@register(
    "F13_blend",
    best("mixed", 60),
    *RANKED,
    f"""mixed as (select bundle_id, product_id, {grid('cast(length(product_id) as double) + 0.2::double * score')} as score from ranked)""",
)
def _(x):
    learned = ranked(x).withColumn("base", F.col("score")).withColumn("score", F.length("product_id").cast("double"))
    return rank.blend(learned, F.col("base")).select("bundle_id", "product_id", "score", "rank")


# ----------------------------------------------------------------------------- ensembles

WEIGHED = """weights as (select submission, exp((quality - 56.18) / 2) / sum(exp((quality - 56.18) / 2)) over () as weight
    from (select distinct submission, quality from f_submissions))"""


@register("H1_submission_weights", f"select submission, {r6('weight', 'weight')} from weights", WEIGHED)
def _(x):
    quality = x.f_submissions.select("submission", "quality").distinct()
    return ensemble.submission_weights(quality).select("submission", "weight")


@register(
    "H2_rrf",
    f"""{SCORED}, row_number() over (partition by bundle_id order by s desc, seen) as rank from (
          select bundle_id, product_id, score as s, score, seen from (select bundle_id, product_id, {grid('sum(1.0::double / (60 + rank))')} as score,
            min(submission * 1000000 + rank) as seen from f_submissions group by 1, 2)) qualify rank <= 15""",
)
def _(x):
    return ensemble.rrf(x.f_submissions).select("bundle_id", "product_id", "score", "rank")


def ranked_files(x):
    """The three submissions written as files whose row order is the rank, and read again."""
    out = []
    for number in (1, 2, 3):
        path = x.scratch() + ".csv"
        sinks.write_submission(x.f_submissions.where(F.col("submission") == number), path)
        out.append(tables.read_ranked_csv(x.spark, path, number))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("F12_ranked_csv", "select submission, bundle_id, product_id, rank from f_submissions")
def _(x):
    return ranked_files(x)


@register(
    "plan_rrf_files",
    f"""{SCORED}, row_number() over (partition by bundle_id order by s desc, seen) as rank from (
          select bundle_id, product_id, score as s, score, seen from (select bundle_id, product_id, {grid('sum(1.0::double / (60 + rank))')} as score,
            min(submission * 1000000 + rank) as seen from f_submissions group by 1, 2)) qualify rank <= 15""",
)
def _(x):
    return ensemble.rrf(checkpointed(ranked_files(x))).select("bundle_id", "product_id", "score", "rank")


@register(
    "H2_incomplete",
    "select bundle_id, least(count(distinct product_id), 15) as n from f_submissions group by 1 having n <> 4",
)
def _(x):
    return ensemble.incomplete_bundles(ensemble.rrf(x.f_submissions), 4)


RRF = f"rrf as (select bundle_id, product_id, {grid('sum(weight / (60 + rank))')} as score from f_submissions join weights using (submission) group by 1, 2)"


@register("H3_weighted_rrf", f"{SCORED} from rrf", WEIGHED, RRF)
def _(x):
    weights = ensemble.submission_weights(x.f_submissions.select("submission", "quality").distinct())
    return ensemble.weighted_rrf(x.f_submissions, weights)


def repair(scores: str, guard: str) -> tuple[str, ...]:
    """CTEs replaying the sequential repair over every matched product, one per step."""
    return (
        f"pa as (select product_id, {ARTICLE} as article from f_articles), ba as (select bundle_id, {ARTICLE} as article from f_article_bundles)",
        f"""held as (select bundle_id, list({{'p': product_id, 's': coalesce(s.score, 0.0::double)}} order by rank) as slots
              from f_submissions left join {scores} s using (bundle_id, product_id) where submission = 3 and rank <= 15 group by 1)""",
        f"""wanted as (select bundle_id, list({{'p': product_id, 's': coalesce(s.score, 0.0::double)}} order by product_id) as items
              from ba join pa using (article) left join {scores} s using (bundle_id, product_id) group by 1)""",
        f"""walk as (select h.bundle_id, slots, items, 1 as i from held h left join wanted w using (bundle_id)
              union all select bundle_id, case when len(list_filter(slots, lambda e: e.p = items[i].p)) = 0 {guard}
                then list_transform(slots, lambda e, j: case when j = list_position(list_transform(slots, lambda f: f.s), list_min(list_transform(slots, lambda f: f.s)))
                                                             then items[i] else e end)
                else slots end, items, i + 1 from walk where i <= len(items))""",
        """repaired as (select bundle_id, unnest(slots).p as product_id, unnest(slots).s as score, unnest(range(1, len(slots) + 1)) as rank
              from walk where items is null or i = len(items) + 1)""",
        """flagged as (select r.*, coalesce(ba.article = pa.article, false) as is_match from repaired r left join ba using (bundle_id) left join pa using (product_id))""",
    )


@register(
    "H4_article_repair_votes",
    "select bundle_id, product_id, rank, score::bigint as votes, is_match from flagged",
    "v as (select bundle_id, product_id, count(*)::double as score from f_submissions group by 1, 2)",
    *repair("v", "and list_min(list_transform(slots, lambda f: f.s)) <= 4"),
)
def _(x):
    return recommend.ensemble_votes(x.f_submissions, x.f_article_bundles, x.f_articles)


@register(
    "H5_article_repair_rrf",
    f"""select bundle_id, product_id, {r6('score', 'score')}, is_match, row_number() over (partition by bundle_id order by is_match desc, case when is_match then 0 else -s end, pos) as rank
        from (select *, score as s, rank as pos from flagged)""",
    WEIGHED,
    RRF,
    *repair("rrf", ""),
)
def _(x):
    return recommend.ensemble_rrf(x.f_submissions, x.f_article_bundles, x.f_articles)


@register(
    "H6_article_precision",
    f"""select count(l.bundle_id) as tp, count(*) - count(l.bundle_id) as fp, {r6('count(l.bundle_id) / count(*)::double', 'precision')}
        from (select bundle_id, product_id from ba join pa using (article) where bundle_id in (select bundle_id from f_links)) m
        left join (select distinct bundle_id, product_id from f_links) l using (bundle_id, product_id)""",
    f"pa as (select product_id, {ARTICLE} as article from f_articles), ba as (select bundle_id, {ARTICLE} as article from f_article_bundles)",
)
def _(x):
    return ensemble.article_precision(x.f_article_bundles, x.f_articles, x.f_links)


# ---------------------------------------------------------------------------- evaluation

WHOLE = "listed15 as (select * from ranked where rank <= 15)"
# for M2: truth of every bundle, lists for the bundles of two sections only
LISTED = "listed15 as (select * from ranked where rank <= 15 and bundle_id in (select bundle_id from f_crops where section < 2))"


def listed(x):
    few = x.f_crops.filter("section < 2").select("bundle_id")
    return ranked(x, 15).join(few, "bundle_id", "left_semi")


@register("M1_hit_recall", metric_rows((5, 10, 15)), *RANKED, WHOLE, *metrics("listed15", "f_truth", (5, 10, 15)))
def _(x):
    return evaluate.hit_recall(ranked(x, 15), x.f_truth)


@register(
    "M2_predicted_only",
    metric_rows((5, 10, 15)),
    *RANKED,
    LISTED,
    *metrics("listed15", "f_truth", (5, 10, 15), join="semi"),
)
def _(x):
    return evaluate.hit_recall(listed(x), x.f_truth, scope="predicted")


INDEXED = "indexed as (select t.* from f_truth t semi join (select product_id from f_index where category <> '') i using (product_id))"


@register(
    "M3_ranking_metrics",
    metric_rows((5, 15), "queries")
    + " union all select 'mrr', 15, round(avg(case when first_hit <= 15 then 1.0::double / first_hit else 0.0::double end), 6) + 0.0::double from per",
    *RANKED,
    WHOLE,
    INDEXED,
    *metrics("listed15", "indexed", (5, 15)),
)
def _(x):
    return evaluate.ranking_metrics(ranked(x, 15), x.f_truth, x.f_index.filter("category <> ''"), (5, 15))


@register(
    "M4_coverage",
    "select 'queries' as metric, 0 as k, count(*)::double as value from per"
    + "".join(
        f""" union all select 'coverage', {k}, round(avg((h{k} > 0)::int::double), 6) + 0.0::double from per
             union all select 'avg_pos_in_top', {k}, round(avg(h{k}::double), 6) + 0.0::double from per"""
        for k in (1, 20, 50)
    ),
    *UNIT_MEANS,
    hits(50, name="near", queries="means", key="bundle_id"),
    *metrics("near", "f_truth", (1, 20, 50)),
)
def _(x):
    found = retrieve.topk(bundle_queries(x), x.f_index.select("product_id", "v"), 50)
    return evaluate.coverage(found, x.f_truth, [0, 20, 200], 50)


@register(
    "M5_validate_regions",
    "select * from (" + metric_rows((15,)) + ") where metric <> 'hit'",
    *UNIT_MEANS,
    hits(15, name="near", queries="means", key="bundle_id"),
    *metrics("near", "f_truth", (15,)),
)
def _(x):
    return evaluate.validate_regions(x.f_crops, x.f_index, x.f_truth)[0]


@register(
    "M5_positives",
    "select n_positives, count(*) as n_bundles from (select bundle_id, count(*) as n_positives from f_truth group by 1) group by 1",
)
def _(x):
    return evaluate.validate_regions(x.f_crops, x.f_index, x.f_truth)[1]


# ------------------------------------------------------------------------------ listwise

POOL = (
    *UNIT_MEANS,
    hits(40, name="near", queries="means", key="bundle_id"),
    "marked as (select n.bundle_id, n.product_id, n.score, n.rank, t.bundle_id is not null as positive from near n left join f_truth t using (bundle_id, product_id))",
    """reasons as (select bundle_id, case when bundle_id not in (select bundle_id from f_truth) then 'no_truth'
         when not bool_or(positive) then 'no_positive' when bool_and(positive) then 'all_positive' else 'usable' end as reason from marked group by 1)""",
    "records as (select * from marked where bundle_id in (select bundle_id from reasons where reason = 'usable'))",
)


def pool(x):
    found = retrieve.topk(bundle_queries(x), x.f_index.select("product_id", "v"), 40)
    return splits.listwise_records(found, x.f_truth)


@register("N5_listwise_records", f"select bundle_id, product_id, {r6('score', 'score')}, rank, positive from records", *POOL)
def _(x):
    return pool(x)[0].select("bundle_id", "product_id", "score", "rank", "positive")


@register("N5_counts", "select reason, count(*) as queries from reasons group by 1", *POOL)
def _(x):
    return pool(x)[1]


@register(
    "N6_listwise_loss",
    f"""select bundle_id, {r6('-ln(p)', 'loss')}, {r6('p', 'pos_prob')} from (
          select bundle_id, sum(exp(score)) filter (positive) / sum(exp(score)) as p from records group by 1)""",
    *POOL,
)
def _(x):
    return listwise.listwise_losses(pool(x)[0])


@register("N7_fit_linear")
def _(x):
    queries = bundle_queries(x)
    dim = len(queries.first()["v"])
    _, history, _ = prepare.train_reranker(queries, x.f_index, x.f_truth, dim, pool=40, ratio=0.2, epochs=4, lr=0.01)
    return x.spark.createDataFrame(history)


# a fixed network with three hidden units
HIDDEN = [[((i * (7 + 2 * j)) % 13 - 6) / 32 for i in range(2 * DIM + 1)] for j in range(3)]
SHIFT, OUT = [0.125, -0.25, 0.5], [1.5, -0.75, 0.5]
UNITS = ", ".join("[" + ", ".join(f"{w}::double" for w in unit) + "]" for unit in HIDDEN)


def network():
    return [([list(row) for row in zip(*HIDDEN)], SHIFT), ([[w] for w in OUT], [0.0625])]


@register(
    "N7_mlp_epoch0",
    """select metric, round(value, 6) + 0.0::double as value from (
          select 'train_loss' as metric, avg(-ln(share)) as value from lists union all select 'train_pos_prob', avg(share) from lists
          union all select 'queries', count(*)::double from per union all select 'recall@5', avg(h5 / n::double) from per
          union all select 'hit@5', avg((h5 > 0)::int::double) from per union all select 'recall@15', avg(h15 / n::double) from per
          union all select 'hit@15', avg((h15 > 0)::int::double) from per union all select 'mrr', avg(coalesce(1.0::double / first, 0)) from per
          union all select 'base_recall', avg(base / n::double) from per)""",
    *POOL,
    f"""scored as (
          select n.*, bundle_id::int % 4 = 0 as val, {' + '.join(f"{o}::double * greatest(0.0::double, list_inner_product(u[{j}], f) + {b}::double)" for j, (o, b) in enumerate(zip(OUT, SHIFT), 1))} + 0.0625::double as logit
          from (select m.*, {features('q', 'p', str(DIM))} as f, [{UNITS}] as u
                from marked m join (select bundle_id, v as q from means) using (bundle_id) join (select product_id, v::double[] as p from f_index) using (product_id)
                where bundle_id in (select bundle_id from f_truth)) n),
        lists as (select bundle_id, sum(exp(logit)) filter (positive) / sum(exp(logit)) as share from scored
                  where not val and bundle_id in (select bundle_id from records) group by 1),
        placed as (select *, row_number() over (partition by bundle_id order by round(logit + 0.2::double * score, 9) desc, product_id) as place from scored where val),
        per as (select bundle_id, (select count(*) from f_truth t where t.bundle_id = p.bundle_id) as n, count(*) filter (positive and place <= 5) as h5,
                       count(*) filter (positive and place <= 15) as h15, min(place) filter (positive and place <= 15) as first, count(*) filter (positive and rank <= 15) as base
                from placed p group by 1)""",
)
def _(x):
    # the state before the first step, over all lists: loss and probability of training lists, metrics of the others
    queries, truth = bundle_queries(x), catalog.truth(x.f_truth)
    found = checkpointed(retrieve.topk(queries, x.f_index.select("product_id", "v"), 40))
    side = F.when(F.col("bundle_id").cast("int") % 4 == 0, "val").otherwise("train")
    train = splits.listwise_records(found.where(side == "train"), truth)[0].withColumn("split", F.lit("train"))
    val = catalog.mark_hits(found.where(side == "val"), truth).withColumnRenamed("hit", "positive").withColumn("split", F.lit("val"))
    rows = train.unionByName(val, allowMissingColumns=True)
    _, history = mlp.fit_mlp(rows, queries, x.f_index, truth, DIM, epochs=0, ks=(5,), layers=mlp_layers(network()))
    return x.spark.createDataFrame([(m, v) for m, v in history[0].items() if m != "epoch"], "metric string, value double")


def mlp_layers(layers):
    return listwise.make_model(layers, DIM)["layers"]


@register("N7_fit_mlp")
def _(x):
    queries = bundle_queries(x)
    dim = len(queries.first()["v"])
    _, history, _ = prepare.train_reranker(queries, x.f_index, x.f_truth, dim, pool=40, ratio=0.2, hidden=(16,), epochs=2, lr=0.01, batch_size=16)
    return x.spark.createDataFrame(history)


@register(
    "N8_score_pairs",
    f"""select n.bundle_id, n.product_id, round(list_inner_product({WEIGHT_LIST}, {features('q', 'p', str(DIM))}) + 0.25::double, 6) + 0.0::double as model_score
        from near n join (select bundle_id, v as q from means) using (bundle_id) join (select product_id, v::double[] as p from f_index) using (product_id)""",
    *POOL,
)
def _(x):
    found = retrieve.topk(bundle_queries(x), x.f_index.select("product_id", "v"), 40)
    pairs = listwise.with_vectors(found.select("bundle_id", "product_id"), bundle_queries(x), x.f_index)
    return listwise.score_pairs(pairs, linear_model())
