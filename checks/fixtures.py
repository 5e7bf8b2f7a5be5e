"""Inputs derived from the given tables, in SQL that Spark and DuckDB both run.

Every fixture keeps all rows of its tables; expressions on the ids only vary the values.
URL timestamps start in 2020, so that all of them are milliseconds by magnitude.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    # products: URL missing for 1 in 37, no ts for 1 in 11, no description for 1 in 29
    "f_products": """
        select cast(p_partkey as string) as product_id,
               case when p_partkey % 37 = 5 then null
                    when p_partkey % 11 = 3 then concat('https://img.test/', lpad(cast(p_partkey as string), 11, '0'), '-e1.jpg')
                    else concat('https://img.test/', lpad(cast(p_partkey as string), 11, '0'), '-e1.jpg?ts=',
                                cast(1577836800000 + (p_partkey * 37 % 2000) * 86400000 as string)) end as image_url,
               case when p_partkey % 29 = 7 then null
                    when p_partkey % 23 = 1 then concat('baby ', p_name)
                    when p_partkey % 7 = 2 then concat(p_name, '/', p_type, '_', p_brand, ' ')
                    when p_partkey % 31 = 4 then 'Perfume; Hand-Cream'
                    else p_name end as description
        from {part}""",
    # bundles: section missing for 1 in 13, URL for 1 in 17; some show the article of a product
    "f_bundles": """
        select cast(o_orderkey as string) as bundle_id,
               case when o_orderkey % 13 = 4 then null else cast(o_orderkey % 3 + 1 as int) end as section,
               case when o_orderkey % 17 = 6 then null
                    else concat('https://img.test/', lpad(cast(o_orderkey % 2500 as string), 11, '0'), '-p.jpg?ts=',
                                cast(1577836800000 + (o_orderkey * 53 % 2400) * 86400000 as string)) end as image_url
        from {orders}""",
    "f_links": """
        select cast(l_orderkey as string) as bundle_id, cast(l_partkey as string) as product_id from {lineitem}""",
    # products several of which share an article, for the sequential repair
    "f_articles": """
        select cast(p_partkey as string) as product_id,
               concat('https://img.test/', lpad(cast(p_partkey % 50 as string), 6, '0'), '-e1.jpg') as image_url
        from {part}""",
    "f_article_bundles": """
        select cast(o_orderkey as string) as bundle_id,
               concat('https://img.test/', lpad(cast(o_orderkey % 60 as string), 6, '0'), '-p.jpg?ts=1') as image_url
        from {orders}""",
    "f_crops": """
        select cast(cast(floor(vec_id / 20) as int) as string) as bundle_id, vec_id as crop_id, embedding as v,
               case when vec_id % 20 = 19 then 0.6 else cast(30 + vec_id * 7 % 70 as double) / 100 end as conf,
               case when label % 5 = 4 then '' else concat('cls_', cast(label % 4 as string)) end as cls,
               cast(cast(floor(vec_id / 20) as int) % 4 as int) as section,
               concat('a', cast(cast(floor(vec_id / 20) as int) % 40 as string)) as bundle_article,
               1577836800000 + (cast(floor(vec_id / 20) as bigint) * 53 % 2400) * 86400000 as bundle_ts
        from {embeddings}""",
    "f_index": """
        select cast(vec_id as string) as product_id, embedding as v,
               case when vec_id % 17 = 3 then '' else concat('CAT_', cast(label as string)) end as category,
               cast(vec_id % 4 as int) as gender,
               concat('a', cast(vec_id % 40 as string)) as article,
               case when vec_id % 11 = 3 then null
                    else 1577836800000 + (vec_id * 37 % 2400) * 86400000 end as product_ts
        from {embeddings}""",
    "f_sections": """
        select cast(vec_id as string) as product_id, cast(vec_id % 3 + 1 as int) as section from {embeddings}
        union all
        select cast(vec_id as string), cast(case when vec_id % 2 = 0 then (vec_id + 1) % 3 + 1 else vec_id % 3 + 1 end as int)
        from {embeddings}""",
    "f_categories": """
        select concat('CAT_', cast(label as string)) as category, min_by(embedding, vec_id) as v
        from {embeddings} group by label""",
    "f_taxonomy": """
        select distinct concat('CAT_', cast(label as string)) as category, concat('cls_', cast(label % 4 as string)) as cls
        from {embeddings}""",
    # truth: half of the crops' own products, else a product far away
    "f_truth": """
        select distinct cast(cast(floor(vec_id / 20) as int) as string) as bundle_id,
               cast(case when label % 2 = 0 then vec_id
                         else (vec_id * 13 + 7) % (select count(*) from {embeddings}) end as string) as product_id
        from {embeddings}""",
    # three rankings of the same lists, with the published quality of three submissions
    "f_submissions": " union all ".join(
        f"""
        select {number} as submission, cast({quality} as double) as quality, cast(l_orderkey as string) as bundle_id,
               cast(l_partkey as string) as product_id,
               row_number() over (partition by l_orderkey
                                  order by {column} desc, l_linenumber, l_partkey, l_suppkey) as rank
        from {{lineitem}}"""
        for number, quality, column in
        ((1, 56.18, "l_quantity"), (2, 58.03, "l_extendedprice"), (3, 60.28, "l_discount"))
    ),
    # detector boxes on 640 x 960 images, some reaching over the edge
    "f_boxes": """
        select cast(user_id as string) as bundle_id, event_id as box_id,
               cast(event_id * 37 % 600 as int) as x1, cast(event_id * 53 % 900 as int) as y1,
               cast(event_id * 37 % 600 + 20 + event_id * 17 % 200 as int) as x2,
               cast(event_id * 53 % 900 + 20 + event_id * 29 % 300 as int) as y2,
               cast(event_id * 7919 % 1000 as double) / 1024 as conf, event_type as cls,
               640 as width, 960 as height
        from {events}""",
    "f_images": """
        select cast(c_custkey as string) as bundle_id, 640 as width, 960 as height from {customer}""",
}

TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a Spark frame."""
    sql = FIXTURES[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(TABLE.findall(sql))})


def with_fixtures(body: str, *ctes: str) -> str:
    """DuckDB SQL: the fixtures ``body`` and ``ctes`` mention, then ``ctes`` (``name as (...)``), then ``body``."""
    text = " ".join([*ctes, body])
    parts = [
        f"{name} as materialized ({TABLE.sub(r'\1', sql)})"
        for name, sql in FIXTURES.items()
        if re.search(rf"\b{name}\b", text)
    ]
    parts += ctes
    return f"with recursive {', '.join(parts)} {body}" if parts else body
