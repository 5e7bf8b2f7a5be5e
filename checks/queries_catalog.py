"""Joins, sets, counts, sections, time alignment and splits: J*, U*, A*, N1-N4."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries_text import ARTICLE, EXCLUDED, LABELS, TS
from checks.registry import r6, register
from stitchrank.operators import alignment, catalog, splits
from stitchrank.operators.scale import checkpointed

# ------------------------------------------------------------------------------- joins


@register(
    "J1_links_inner",
    """select l.bundle_id, l.product_id, b.section, p.description from f_links l
       join f_bundles b using (bundle_id) join f_products p using (product_id)""",
)
def _(x):
    return catalog.links_enriched(
        x.f_links, x.f_bundles.select("bundle_id", "section"), x.f_products.select("product_id", "description")
    )


# half of the catalogue: links then have orphans on either side
HALF = "half as (select * from f_products where description is not null), dated as (select * from f_bundles where section is not null)"


@register(
    "J2_links_left",
    """select l.bundle_id, l.product_id, b.section, p.description from f_links l
       left join dated b using (bundle_id) left join half p using (product_id)""",
    HALF,
)
def _(x):
    bundles = x.f_bundles.filter("section is not null").select("bundle_id", "section")
    products = x.f_products.filter("description is not null").select("product_id", "description")
    return catalog.links_enriched(x.f_links, bundles, products, "left")


def _checked(x):
    return catalog.check_links(x.f_links, x.f_bundles.filter("section is not null"), x.f_products.filter("description is not null"))


@register(
    "J3_valid_links",
    "select l.* from f_links l where bundle_id in (select bundle_id from dated) and product_id in (select product_id from half)",
    HALF,
)
def _(x):
    return _checked(x)[0]


@register(
    "J3_counts",
    """select count(*) as relations_total, count(*) filter (b.bundle_id is null) as relations_missing_bundle,
              count(*) filter (p.product_id is null) as relations_missing_product,
              count(*) filter (b.bundle_id is not null and p.product_id is not null) as relations_valid
       from f_links l left join dated b using (bundle_id) left join half p using (product_id)""",
    HALF,
)
def _(x):
    return _checked(x)[1]


@register(
    "J3_test_ids",
    """select count(*) as test_rows_total, count(*) filter (b.bundle_id is null) as test_rows_missing_bundle
       from f_links l left join dated b using (bundle_id)""",
    HALF,
)
def _(x):
    return catalog.check_test_ids(x.f_links, x.f_bundles.filter("section is not null"))


@register(
    "J4_lookup",
    """select l.bundle_id, l.product_id, coalesce(b.section, 0) as section from f_links l left join f_bundles b using (bundle_id)""",
)
def _(x):
    return catalog.lookup(x.f_links, x.f_bundles, "bundle_id", ["section"], {"section": 0})


ARTICLES = f"""pa as (select product_id, {ARTICLE} as article from f_products),
  ba as (select bundle_id, {ARTICLE} as article from f_bundles)"""


@register("J5_article_matches", "select bundle_id, product_id, article from ba join pa using (article)", ARTICLES)
def _(x):
    return catalog.article_matches(x.f_bundles, x.f_products)


# manifests with a direct id, a list in text form, or both; a tenth of the products is unknown
LINK_MANIFEST = """select cast(o_orderkey as {s}) as bundle_id, case when o_orderkey % 3 = 0 then cast(o_custkey as {s}) end as product_id,
    case o_orderkey % 4 when 0 then concat(o_orderkey % 2500, '|', o_custkey) when 1 then concat('["', o_orderkey % 2500, '"]')
         when 2 then ' none ' end as positives from {orders}"""
LINK_CTES = (
    "m as (" + LINK_MANIFEST.format(s="varchar", orders="orders") + ")",
    """pairs as (select distinct bundle_id, product_id from (
        select bundle_id, product_id from m where product_id is not null
        union all select bundle_id, unnest(string_split(positives, '|')) from m where contains(positives, '|')
        union all select bundle_id, positives[3:-3] from m where starts_with(positives, '[')))""",
)


def _restricted(x):
    manifest = x.spark.sql(LINK_MANIFEST.format(s="string", orders="{orders}"), orders=x.orders)
    return catalog.restrict_links(manifest, x.f_products)


@register(
    "J6_restrict_links",
    "select bundle_id, product_id from pairs where product_id in (select product_id from f_products)",
    *LINK_CTES,
)
def _(x):
    return _restricted(x)[0]


@register(
    "J6_counts",
    """select count(*) as links_total, count(*) filter (product_id not in (select product_id from f_products)) as links_dropped
       from pairs""",
    *LINK_CTES,
)
def _(x):
    return _restricted(x)[1]


@register(
    "J7_eligible_queries",
    """select bundle_id, section from f_bundles where bundle_id in (
         select bundle_id from f_links where product_id in (select product_id from f_products))""",
)
def _(x):
    return catalog.eligible_queries(
        x.f_bundles.select("bundle_id", "section"), x.f_links, x.f_products
    )


@register(
    "J8_mark_hits",
    """select s.submission, s.bundle_id, s.product_id, s.rank, t.bundle_id is not null as hit from f_submissions s
       left join (select distinct cast(l_orderkey as varchar) as bundle_id, cast(l_partkey as varchar) as product_id from lineitem) t
       using (bundle_id, product_id)""",
)
def _(x):
    truth = x.lineitem.selectExpr("cast(l_orderkey as string) as bundle_id", "cast(l_partkey as string) as product_id")
    return catalog.mark_hits(x.f_submissions.select("submission", "bundle_id", "product_id", "rank"), truth)


@register(
    "J9_training_pairs",
    """select p.bundle_id, p.product_id, b.box_id from (
         select bundle_id, product_id from (select distinct bundle_id, product_id from f_links)
         qualify row_number() over (partition by bundle_id order by product_id) <= 8) p
       left join f_boxes b using (bundle_id)""",
)
def _(x):
    return catalog.training_pairs(x.f_boxes, x.f_links)


@register(
    "J10_override_description",
    """select p.product_id, coalesce(nullif(upper(trim(coalesce(e.description, ''))), ''), upper(trim(coalesce(p.description, '')))) as category
       from f_products p left join (select cast(p_partkey as varchar) as product_id, case when p_size % 2 = 0 then p_brand else ' ' end as description
                                    from part) e using (product_id)""",
)
def _(x):
    enriched = x.part.selectExpr(
        "cast(p_partkey as string) as product_id", "case when p_size % 2 = 0 then p_brand else ' ' end as description"
    )
    return catalog.override_description(x.f_products, enriched).select("product_id", "category")


# ---------------------------------------------------------------------- set operations


@register("U1_union_ids", "select bundle_id as id from f_links union select bundle_id from f_images")
def _(x):
    return catalog.union_ids(x.f_links.select("bundle_id"), x.f_images.select("bundle_id"))


@register("U2_distinct_first", "select user_id, min(event_id) as first_pos from events group by 1")
def _(x):
    return catalog.distinct_first(x.events, "user_id", "event_id")


@register("U3_unknown_ids", "select bundle_id from f_images except select bundle_id from f_links")
def _(x):
    return catalog.unknown_ids(x.f_images.select("bundle_id"), x.f_links.select("bundle_id"))


@register(
    "U4_union_links",
    """select bundle_id, product_id from f_links union
       select cast(o_custkey as varchar), cast(o_orderkey as varchar) from orders""",
)
def _(x):
    other = x.orders.selectExpr("cast(o_custkey as string) as bundle_id", "cast(o_orderkey as string) as product_id")
    return catalog.union_links(x.f_links, other)


# ------------------------------------------------------------------- cleaning and labels


@register(
    "A1_keep_first",
    """select user_id, event_type, event_id, value from events
       qualify row_number() over (partition by user_id, event_type order by event_id) = 1""",
)
def _(x):
    return catalog.keep_first(x.events, ["user_id", "event_type"], ["event_id"])[0].select(
        "user_id", "event_type", "event_id", "value"
    )


@register(
    "A1_counts",
    """select count(*) as rows_total, count(*) - count(distinct (user_id, event_type)) as duplicates from events""",
)
def _(x):
    return catalog.keep_first(x.events, ["user_id", "event_type"], ["event_id"])[1]


KEPT = f"kept as (select *, list_filter(labels, lambda e: e not in ({EXCLUDED})) as k from labelled)"
RECORDS = (
    LABELS,
    KEPT,
    """records as (select bundle_id, list_sort(list(distinct label)) as labels from (
         select l.bundle_id, unnest(k) as label from f_links l join f_bundles using (bundle_id) join kept using (product_id)
       ) group by 1)""",
)


def _records(x):
    return catalog.bundle_labels(x.f_links, x.f_bundles, x.f_products)


@register(
    "A2_bundle_labels",
    """select bundle_id, section, trim(coalesce(image_url, '')) as image_url, array_to_string(labels, '~') as labels
       from records join f_bundles using (bundle_id)""",
    *RECORDS,
)
def _(x):
    return _records(x)[0].withColumn("labels", F.array_join("labels", "~"))


@register(
    "A2_counts",
    """select count(*) as relations_total, count(*) filter (b.bundle_id is null) as relations_missing_bundle,
         count(*) filter (k.product_id is null) as relations_missing_product, count(b.bundle_id) filter (k.product_id is not null) as relations_valid,
         count(*) filter (k.product_id is not null and k.description is null) as products_missing_description,
         count(*) filter (k.description is not null and len(k.k) = 0) as products_empty_labels_after_clean,
         cast(sum(len(k.labels) - len(k.k)) as bigint) as labels_removed_excluded_categories, 0 as bundles_without_labels,
         (select count(*) from records) as bundles_with_labels
       from f_links l left join f_bundles b using (bundle_id) left join kept k using (product_id)""",
    *RECORDS,
)
def _(x):
    return _records(x)[1]


VOCAB = "vocab as (select label, row_number() over (order by label) - 1 as label_index from (select distinct unnest(labels) as label from records))"


@register("A3_label_vocab", "select label, label_index from vocab", *RECORDS, VOCAB)
def _(x):
    return catalog.label_vocab(_records(x)[0])


@register(
    "A3_index_labels",
    """select bundle_id, string_agg(cast(label_index as varchar), ',' order by label_index) as label_indices
       from (select bundle_id, unnest(labels) as label from records) join vocab using (label) group by 1""",
    *RECORDS,
    VOCAB,
)
def _(x):
    records = _records(x)[0]
    indexed = catalog.index_labels(records, catalog.label_vocab(records))
    return indexed.select("bundle_id", F.array_join("label_indices", ",").alias("label_indices"))


HASHED = "sha256(concat('42||', bundle_id))"
STRATA = (
    "rec as (select bundle_id, len(labels) as stratum from records)",
    """strata as (select stratum, count(*) as n, cast(floor(count(*) * 0.1::double) as bigint) as base,
         count(*) * 0.1::double - floor(count(*) * 0.1::double) as remainder from rec group by 1)""",
    """slots as (select stratum, n, base + greatest(0, least(n - base,
         (select cast(round_even(sum(n) * 0.1::double, 0) as bigint) - sum(base) from strata)
         - coalesce(sum(n - base) over (order by remainder desc, stratum rows between unbounded preceding and 1 preceding), 0))) as n_val
       from strata)""",
    f"""split as (select bundle_id, stratum, case when row_number() over (partition by stratum order by {HASHED}) <= n_val
         then 'val' else 'train' end as split from rec join slots using (stratum))""",
)


@register("N3_stratified_split", "select bundle_id, cast(stratum as int) as stratum, split from split", *RECORDS, *STRATA)
def _(x):
    return splits.stratified_split(_records(x)[0])


@register(
    "A4_corpus_stats",
    f"""select 'num_bundles_total' as metric, '' as key, count(*)::double as value from records
        union all select 'pct_bundles_image_available', '', round(100.0::double * avg((image_url is not null)::int), 4) from records join f_bundles using (bundle_id)
        union all select 'num_bundles_train', '', count(*)::double from split where split = 'train'
        union all select 'num_bundles_val', '', count(*)::double from split where split = 'val'
        union all select 'num_labels', '', count(distinct label)::double from (select unnest(labels) as label from records)
        union all select 'label_frequency', label, count(*)::double from (select unnest(labels) as label from records) group by label
        union all select 'labels_per_bundle', len(labels)::varchar, count(*)::double from records group by len(labels)""",
    *RECORDS,
    *STRATA,
)
def _(x):
    # written once, since the split and every statistic read them
    records = checkpointed(_records(x)[0])
    split = checkpointed(splits.stratified_split(records))
    available = x.f_bundles.filter("image_url is not null")
    return catalog.corpus_stats(records, split.filter("split = 'train'"), split.filter("split = 'val'"), available)


# ---------------------------------------------------------------------- time alignment

ALIGNED = (
    f"bt as (select bundle_id, {TS} as bundle_ts from f_bundles)",
    f"pt as (select product_id, {TS} as product_ts from f_products)",
    """linked as (select bundle_id, product_id, bundle_ts, make_timestamp(bundle_ts * 1000) as bw, make_timestamp(product_ts * 1000) as pw,
         bundle_ts is not null and product_ts is not null as both_ts, abs(bundle_ts - product_ts) / 1000.0::double / 3600 as delta
       from (select distinct bundle_id, product_id from f_links) left join bt using (bundle_id) left join pt using (product_id))""",
    """timed as (select *, coalesce(bw::date = pw::date, false) as same_date,
         coalesce(strftime(bw, '%Y-%m') = strftime(pw, '%Y-%m'), false) as same_month,
         coalesce(year(bw) = year(pw) and quarter(bw) = quarter(pw), false) as same_quarter from linked)""",
)
PERIOD_COLUMNS = ", ".join(
    f"""count(*) filter (same_{p}) as n_products_same_{p}, count(*) filter (both_ts and not same_{p}) as n_products_diff_{p},
        round(count(*) filter (same_{p}) / nullif(count(*) filter (both_ts), 0)::double, 6) + 0.0::double as pct_products_same_{p},
        count(*) filter (both_ts) > 0 and count(*) filter (same_{p}) = count(*) filter (both_ts) as all_products_same_{p},
        count(*) filter (same_{p}) > 0 as any_product_same_{p}"""
    for p in alignment.PERIODS
)
REPORT = f"""select bundle_id, any_value(bundle_ts) as bundle_ts, strftime(any_value(bw), '%Y-%m-%dT%H:%M:%S+00:00') as bundle_datetime,
    strftime(any_value(bw), '%Y-%m-%d') as bundle_date, strftime(any_value(bw), '%Y-%m') as bundle_month,
    concat(year(any_value(bw)), '-Q' || quarter(any_value(bw))) as bundle_quarter, count(*) as n_products,
    count(*) filter (both_ts) as n_products_with_ts, count(*) filter (not both_ts) as n_products_missing_ts, {PERIOD_COLUMNS},
    round(avg(delta), 6) + 0.0::double as avg_delta_hours_abs, round(max(delta), 6) + 0.0::double as max_delta_hours_abs
  from timed group by bundle_id"""


def _alignment(x):
    return alignment.ts_alignment(x.f_links, x.f_bundles, x.f_products)


@register(
    "A5_ts_alignment",
    "select * replace (case when bundle_ts is not null then bundle_quarter end as bundle_quarter) from report",
    *ALIGNED,
    f"report as ({REPORT})",
)
def _(x):
    return _alignment(x)


def _ids(condition: str, name: str) -> str:
    return f"coalesce(string_agg(product_id, '|' order by product_id) filter ({condition}), '') as {name}"


@register(
    "A5_ts_alignment_ids",
    f"""select bundle_id, product_id, unnest(case when not both_ts then ['missing_ts'] else [{', '.join(
        f"case when same_{p} then 'same_{p}' else 'diff_{p}' end" for p in alignment.PERIODS)}] end) as list_name
        from timed""",
    *ALIGNED,
)
def _(x):
    return alignment.ts_alignment_ids(x.f_links, x.f_bundles, x.f_products)


TOTALS = ", ".join(
    f"""sum(n_products_same_{p})::bigint as products_same_{p}, count(*) filter (all_products_same_{p}) as bundles_all_same_{p},
        count(*) filter (any_product_same_{p}) as bundles_any_same_{p}, count(*) filter (not any_product_same_{p}) as bundles_none_same_{p}"""
    for p in alignment.PERIODS
)


@register(
    "A6_alignment_totals",
    f"""select count(*) as bundles, sum(n_products)::bigint as products, sum(n_products_with_ts)::bigint as products_with_ts, {TOTALS} from report""",
    *ALIGNED,
    f"report as ({REPORT})",
)
def _(x):
    return alignment.ts_alignment_totals(_alignment(x))


# ---------------------------------------------------------------------------- sections

SECTIONS = (
    """counted as (select product_id, section, count(*) as n from f_links join f_bundles using (bundle_id)
         where section is not null group by all)""",
    """direct as (select product_id, arg_max(section, n * 10 - section)::int as section, count(*) as n_sections, sum(n)::bigint as n_links
         from counted group by 1)""",
    """by_category as (select upper(trim(description)) as category, section, sum(n)::bigint as n from counted join f_products using (product_id)
         where trim(coalesce(description, '')) <> '' group by all)""",
    """exclusive as (select category, arg_max(section, n * 10 - section)::int as section, max(n) / sum(n)::double as share, sum(n)::bigint as n_links
         from by_category group by 1 having max(n) / sum(n)::double >= 0.4)""",
    # a link of every third bundle only, so that some products have no direct section
    """sparse as (select product_id, min(section)::int as section from counted where n > 14 group by 1)""",
    """assigned as (select p.product_id, coalesce(d.section, case when starts_with(upper(trim(coalesce(description, ''))), 'BABY ') then 3 end, e.section, 0)::int as gender,
         case when d.section is not null then 'direct_link' when starts_with(upper(trim(coalesce(description, ''))), 'BABY ') then 'baby_prefix'
              when e.section is not null then 'desc_heuristic' else 'fallback_unknown' end as method
       from f_products p left join sparse d using (product_id) left join exclusive e on e.category = upper(trim(p.description)))""",
)


@register("A7_direct_sections", "select product_id, section, n_sections, n_links from direct", *SECTIONS)
def _(x):
    return catalog.direct_sections(x.f_links, x.f_bundles)


@register(
    "A8_exclusive_sections",
    f"select category, section, {r6('share', 'share')}, n_links from exclusive",
    *SECTIONS,
)
def _(x):
    return catalog.exclusive_sections(x.f_links, x.f_bundles, x.f_products, min_share=0.4)


def _assigned(x):
    linked = catalog.links_enriched(x.f_links, x.f_bundles.filter("section is not null"), x.f_products.select("product_id"))
    sparse = linked.groupBy("product_id", "section").agg(F.count("*").alias("n")).filter("n > 14")
    direct = sparse.groupBy("product_id").agg(F.min("section").alias("section"))
    exclusive = catalog.exclusive_sections(x.f_links, x.f_bundles, x.f_products, min_share=0.4)
    return catalog.assign_sections(x.f_products, direct, exclusive)


@register("A9_assign_sections", "select product_id, gender, method from assigned", *SECTIONS)
def _(x):
    return _assigned(x).select("product_id", "gender", "method")


@register(
    "A9_majority_sections",
    """select product_id, coalesce(d.section, case when baby then 3 end, e.section, 0)::int as gender,
              case when d.section is not null then 'direct_link' when baby then 'baby_prefix' when e.section is not null then 'desc_heuristic' else 'fallback_unknown' end as method
       from (select *, starts_with(upper(trim(coalesce(description, ''))), 'BABY ') as baby from f_products) p
       left join (select * from direct where n_links > 14 and n_sections < 4) d using (product_id) left join exclusive e on e.category = upper(trim(p.description))""",
    *SECTIONS,
)
def _(x):
    # the direct sections of A7, by majority of links
    direct = catalog.direct_sections(x.f_links, x.f_bundles).where("n_links > 14 and n_sections < 4")
    exclusive = catalog.exclusive_sections(x.f_links, x.f_bundles, x.f_products, min_share=0.4)
    return catalog.assign_sections(x.f_products, direct, exclusive).select("product_id", "gender", "method")


@register(
    "A9_distribution",
    """select kind, value, count(*) as n, round(round(100.0::double * count(*) / (select count(*) from assigned), 1), 6) + 0.0::double as pct from (
         select 'method' as kind, method as value from assigned union all select 'gender', gender::varchar from assigned) group by all""",
    *SECTIONS,
)
def _(x):
    return catalog.section_distribution(_assigned(x))


@register(
    "A12_product_sections",
    """select p.product_id, unnest(coalesce(s.sections, [1, 2, 3])) as section from f_products p left join (
         select category, list(distinct section::int) as sections from by_category group by 1) s on s.category = upper(trim(p.description))""",
    *SECTIONS,
)
def _(x):
    return catalog.product_sections(x.f_links, x.f_bundles, x.f_products)


# ------------------------------------------------------------------- counts and reports


@register(
    "A10_popularity",
    """select product_id, n_links, row_number() over (order by n_links desc, product_id) - 1 as position from (
         select product_id, coalesce(n, 0) as n_links from f_products full join
           (select product_id, count(*) as n from f_links group by 1) using (product_id))""",
)
def _(x):
    return catalog.popularity(x.f_links, x.f_products)


@register(
    "A10_most_popular",
    """select product_id, count(*) as n_links, row_number() over (order by count(*) desc, product_id) - 1 as position
       from f_links group by 1 order by 2 desc, 1 limit 30""",
)
def _(x):
    return catalog.most_popular(x.f_links, 30)


@register("A11_truth", "select distinct bundle_id, product_id from f_links")
def _(x):
    return catalog.truth(x.f_links)


@register("A13_votes", "select bundle_id, product_id, count(*) as votes from f_submissions group by all")
def _(x):
    return catalog.votes(x.f_submissions)


@register(
    "A14_detection_stats",
    f"""select count(*) as total, count(n) as with_detections, {r6('avg(coalesce(n, 0))', 'avg_boxes')} from f_images
        left join (select bundle_id, count(*) as n from f_boxes group by 1) using (bundle_id)""",
)
def _(x):
    return catalog.detection_stats(x.f_images, x.f_boxes)


@register(
    "A15_size_stats",
    """select count(*) as bundles, round(avg(n), 6) + 0.0::double as mean_size, min(n) as min_size, max(n) as max_size,
              round(median(n), 6) + 0.0::double as median_size
       from (select bundle_id, coalesce(n, 0) as n from f_bundles left join (select bundle_id, count(*) as n from f_links group by 1) using (bundle_id))""",
)
def _(x):
    return catalog.size_stats(x.f_links, x.f_bundles)


@register(
    "A16_positives_histogram",
    """select n_positives, count(*) as n_bundles from (select bundle_id, count(distinct product_id) as n_positives from f_links group by 1) group by 1""",
)
def _(x):
    return catalog.positives_histogram(x.f_links)


@register(
    "A17_submission_view",
    """select bundle_id, product_id, trim(coalesce(description, '')) as description, count(*) over (partition by bundle_id) as n_products
       from (select distinct bundle_id, product_id from f_submissions) left join f_products using (product_id)""",
)
def _(x):
    return catalog.submission_view(x.f_submissions, x.f_products)


@register(
    "A18_first_description",
    """select cast(l_partkey as varchar) as product_id, arg_min(trim(l_returnflag || ' ' || l_linestatus), l_orderkey * 10 + l_linenumber) as description
       from lineitem where l_returnflag <> 'R' group by 1""",
)
def _(x):
    rows = x.lineitem.selectExpr(
        "cast(l_partkey as string) as product_id", "l_orderkey * 10 + l_linenumber as row_no",
        "case when l_returnflag <> 'R' then concat(l_returnflag, ' ', l_linestatus, ' ') else '  ' end as description",
    )
    return catalog.first_description(rows, "row_no")


# ------------------------------------------------------------------------------ splits

SPLIT = "row_number() over (order by {0}) <= {1}"
IDS = "ids as (select distinct bundle_id from f_links)"
N_VAL = "(select greatest(1, cast(round_even(count(*) * 0.1::double, 0) as bigint)) from ids)"


@register("N1_val_ids", f"select bundle_id from ids qualify {SPLIT.format(HASHED, N_VAL)}", IDS)
def _(x):
    return splits.val_ids(x.f_links.select("bundle_id"))


@register(
    "N2_split_ids",
    f"select bundle_id, case when {SPLIT.format(HASHED, N_VAL)} then 'val' else 'train' end as split from ids",
    IDS,
)
def _(x):
    return splits.split_ids(x.f_links.select("bundle_id"))


@register(
    "N4_split_pairs",
    f"""select l.bundle_id, l.product_id, s.split from f_links l join (
          select bundle_id, case when {SPLIT.format(HASHED, N_VAL)} then 'val' else 'train' end as split from ids) s using (bundle_id)""",
    IDS,
)
def _(x):
    return splits.split_pairs(x.f_links)
