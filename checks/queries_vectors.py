"""Vector algebra and box geometry: E*, B*."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import r6, register, vector_rows
from stitchrank.fixed_values import BOX_FEATURES
from stitchrank.functions import vectors
from stitchrank.operators import boxes, embeddings

# ----------------------------------------------------------------------------- vectors

NORM = "greatest(sqrt(list_inner_product(v, v)), 1e-8)"


def rows_of(source: str, *keys: str) -> str:
    """SQL for the (keys, pos, x) rows of unit vectors made from ``v`` of ``source``."""
    head = "".join(f"{k}, " for k in keys)
    return f"""select {head}unnest(range(len(v))) as pos, unnest(list_transform(v, lambda e: round(e / {NORM}, 6) + 0.0::double)) as x
               from {source}"""


def mean_of(name: str, source: str, keys: str, weight: str = "1.0::double") -> str:
    """CTE ``name``: weighted mean vectors of ``source`` per ``keys``."""
    return f"""{name}_parts as (select {keys}, unnest(range(len(v))) as pos, unnest(v::double[]) * ({weight}) as x, {weight} as w from {source}),
      {name} as (select {keys}, list(x order by pos) as v from (
        select {keys}, pos, sum(x) / sum(w) as x from {name}_parts group by all) group by all)"""


@register("E1_l2_normalize", rows_of("(select vec_id, list_transform(embedding::double[], lambda e: e * 3 * (label + 1)) as v from embeddings)", "vec_id"))
def _(x):
    scaled = F.transform("embedding", lambda e: e.cast("double") * F.lit(3) * (F.col("label") + 1))
    return vector_rows(x.embeddings.select("vec_id", vectors.l2_normalize(scaled).alias("v")), "vec_id")


def _modal(x):
    img = x.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    # the text vector is the image vector backwards; one label has no text
    txt = x.embeddings.filter("label <> 3").select(F.col("vec_id").alias("id"), F.reverse("embedding").alias("v"))
    return img, txt


def _fused(mix: str) -> str:
    return rows_of(
        f"""(select vec_id as id, case when label = 3 then embedding::double[] else list_transform(range(1, len(embedding) + 1),
              lambda i: {mix.format(a='embedding[i]::double', b='list_reverse(embedding)[i]::double')}) end as v from embeddings)""",
        "id",
    )


@register("E2_fuse_sum", _fused("{a} + {b}"))
def _(x):
    return vector_rows(embeddings.fuse(*_modal(x), mode="sum"), "id")


@register("E2_fuse_alpha", _fused("0.7::double * {a} + 0.3::double * {b}"))
def _(x):
    return vector_rows(embeddings.fuse(*_modal(x), mode="alpha", alpha=0.7), "id")


UNIT = "sqrt(list_inner_product(embedding::double[], embedding::double[]))"


@register("E2_fuse_norm_sum", _fused("{a} / " + UNIT + " + {b} / " + UNIT))
def _(x):
    return vector_rows(embeddings.fuse(*_modal(x), mode="norm_sum"), "id")


VIEWS = "views as (select vec_id, label, embedding as v from embeddings union all select vec_id, label, list_reverse(embedding) from embeddings)"


@register("E3_mean_views", rows_of("means", "vec_id"), VIEWS, mean_of("means", "views", "vec_id"))
def _(x):
    v = F.explode(F.array("embedding", F.reverse("embedding"))).alias("v")
    return vector_rows(embeddings.mean_views(x.embeddings.select("vec_id", v), ["vec_id"]), "vec_id")


@register(
    "E4_weighted_bundle_vector",
    f"select r.*, n.n_crops from ({rows_of('means', 'bundle_id')}) r join (select bundle_id, count(*) as n_crops from f_crops group by 1) n using (bundle_id)",
    mean_of("means", "f_crops", "bundle_id", "greatest(conf, 0.1::double)"),
)
def _(x):
    return vector_rows(embeddings.weighted_bundle_vector(x.f_crops), "bundle_id", "n_crops")


@register("E5_mean_regions", rows_of("means", "bundle_id"), mean_of("means", "f_crops", "bundle_id"))
def _(x):
    return vector_rows(embeddings.mean_regions(x.f_crops), "bundle_id")


def features(q: str, p: str, dim: str) -> str:
    """SQL list of the default pair features of two double lists."""
    return f"""list_concat([list_inner_product({q}, {p})], list_transform(range(1, {dim} + 1), lambda i: abs({q}[i] - {p}[i])),
                           list_transform(range(1, {dim} + 1), lambda i: {q}[i] * {p}[i]))"""


@register(
    "E6_pair_features",
    f"""select vec_id, unnest(range(len(f))) as pos, unnest(list_transform(f, lambda e: round(e, 6) + 0.0::double)) as x from (
          select vec_id, list_concat({features('q', 'p', 'len(q)')}, list_transform(range(1, len(q) + 1), lambda i: (q[i] - p[i]) * (q[i] - p[i])), q, p, [label::double]) as f
          from (select vec_id, label, embedding::double[] as q, list_reverse(embedding)::double[] as p from embeddings))""",
)
def _(x):
    f = vectors.pair_features(
        F.col("embedding"), F.reverse("embedding"), sq_diff=True, raw=True, extra=F.array(F.col("label").cast("double"))
    )
    return vector_rows(x.embeddings.select("vec_id", f.alias("v")), "vec_id")


@register(
    "E7_standardize",
    f"""select event_id, {r6('(value - m) / case when s < 1e-6 then 1.0::double else s end', 'value')},
               {r6('(one - om) / case when os < 1e-6 then 1.0::double else os end', 'one')}
        from (select event_id, value, 1.0::double as one from events), (select avg(value) as m, stddev_pop(value) as s, 1.0::double as om, 0.0::double as os
              from events where event_type = 'click')""",
)
def _(x):
    rows = x.events.select("event_id", "event_type", "value", F.lit(1.0).alias("one"))
    done = embeddings.standardize(rows, ["value", "one"], rows.filter("event_type = 'click'"))
    return done.select("event_id", "value", "one")


# ------------------------------------------------------------------------------- boxes

JITTER = "x1 + (box_id % 4) * 0.25 - 30 as x1, y1 - 0.5 as y1, x2 + (box_id % 3) * 0.5 as x2, y2 + 0.5 as y2"
CLIPPED = f"""clipped as (select bundle_id, box_id, conf, box_id % 6 as cls_id,
    cast(greatest(0, least(round_even(x1, 0), 639)) as int) as x1, cast(greatest(0, least(round_even(y1, 0), 959)) as int) as y1,
    cast(greatest(1, least(round_even(x2, 0), 640)) as int) as x2, cast(greatest(1, least(round_even(y2, 0), 960)) as int) as y2
  from (select bundle_id, box_id, conf, {JITTER} from f_boxes))"""


@register(
    "B1_sanitize_boxes",
    f"""select bundle_id, box_id, x1, y1, x2, y2, {r6('conf', 'conf')}, row_number() over (partition by bundle_id order by conf desc, box_id) as place,
               coalesce(case cls_id when 0 then 'accessories' when 1 then 'bags' when 2 then 'clothing' when 3 then 'shoes' end, 'clothing') as cls
        from clipped where x2 > x1 and y2 > y1 and (x2 - x1) * (y2 - y1) >= cast(floor(640 * 960 * 0.01::double) as bigint)
        qualify place <= 15""",
    CLIPPED,
)
def _(x):
    moved = x.f_boxes.selectExpr(
        "bundle_id", "box_id", *JITTER.split(", "), "conf", "cast(box_id % 6 as int) as cls_id", "width", "height"
    )
    names = {0: "accessories", 1: "bags", 2: "clothing", 3: "shoes"}
    clean = boxes.sanitize_boxes(moved, min_area_ratio=0.01, class_names=names)
    return clean.select("bundle_id", "box_id", "x1", "y1", "x2", "y2", "conf", "place", "cls")


@register(
    "B2_valid_boxes",
    """select bundle_id, box_id, x1, y1, x2 - x1 % 50 as x2, y2,
              case when box_id % 3 = 0 then 1.0::double else round(conf, 6) + 0.0::double end as conf
       from f_boxes where cls not in ('error', 'search') and x2 - x1 % 50 > x1""",
)
def _(x):
    # too short for errors, junk for searches, no score for one in three, some upside down
    box = """case when cls = 'error' then array(cast(x1 as string), '1') when cls = 'search' then array('a', '1', '2', '3', '0.5')
             else filter(array(cast(x1 + 0.25 as string), cast(y1 as string), cast(x2 - x1 % 50 as string), cast(y2 as string),
                        case when box_id % 3 = 0 then null else cast(conf as string) end), e -> e is not null) end as box"""
    return boxes.valid_boxes(x.f_boxes.selectExpr("bundle_id", "box_id", box))


def iou(a: str, b: str) -> str:
    w = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
    return f"(({w} * {h}) / ({area.format(a)} + {area.format(b)} - {w} * {h})::double)"


@register(
    "B3_box_iou",
    f"""select a.bundle_id, a.box_id, {r6(iou('a', 'b'), 'iou')} from (
          select *, lead(box_id) over (partition by bundle_id order by box_id) as next_id from f_boxes) a
        join f_boxes b on b.bundle_id = a.bundle_id and b.box_id = a.next_id""",
)
def _(x):
    box = F.struct("x1", "y1", "x2", "y2")
    pairs = x.f_boxes.select(
        "bundle_id", "box_id", box.alias("a"), F.lead(box).over(Window.partitionBy("bundle_id").orderBy("box_id")).alias("b")
    )
    return pairs.filter("b is not null").select("bundle_id", "box_id", boxes.box_iou(F.col("a"), F.col("b")).alias("iou"))


NMS = (
    """ordered as (select bundle_id, list({'box_id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} order by conf desc, box_id) as items
         from f_boxes where conf >= 0.15 group by 1)""",
    f"""steps as (select bundle_id, items, items[1:0] as kept, 1 as i from ordered
          union all select bundle_id, items, case when len(kept) < 10 and len(list_filter(kept, lambda b: {iou('b', 'items[i]')} >= 0.3)) = 0
                      then list_append(kept, items[i]) else kept end, i + 1 from steps where i <= len(items))""",
)


@register(
    "B4_nms",
    """select bundle_id, unnest(kept).box_id as box_id, unnest(range(1, len(kept) + 1)) as rank from steps where i = len(items) + 1""",
    *NMS,
)
def _(x):
    return boxes.nms(x.f_boxes, iou=0.3).select("bundle_id", "box_id", "rank")


@register(
    "B5_pad_ceil_clamp",
    """select bundle_id, box_id, case when ok then a else x1 end as x1, case when ok then b else y1 end as y1, case when ok then c else x2 end as x2, case when ok then d else y2 end as y2
       from (select *, c > a and d > b as ok from (select *, cast(greatest(0, x1 - ceil((x2 - x1) * 0.15::double)) as int) as a, cast(greatest(0, y1 - ceil((y2 - y1) * 0.15::double)) as int) as b,
             cast(least(640, x2 + ceil((x2 - x1) * 0.15::double)) as int) as c, cast(least(960, y2 + ceil((y2 - y1) * 0.15::double)) as int) as d from f_boxes))""",
)
def _(x):
    return boxes.pad_box(x.f_boxes).select("bundle_id", "box_id", "x1", "y1", "x2", "y2")


@register(
    "B5_pad_trunc",
    """select bundle_id, box_id, case when ok then a else 0 end as x1, case when ok then b else 0 end as y1, case when ok then c else 640 end as x2, case when ok then d else 960 end as y2
       from (select *, c > a and d > b as ok from (select *, cast(greatest(0, least(639, x1 - trunc((x2 - x1) * 0.15::double))) as int) as a, cast(greatest(0, least(959, y1 - trunc((y2 - y1) * 0.15::double))) as int) as b,
             cast(greatest(1, least(640, x2 + trunc((x2 - x1) * 0.15::double))) as int) as c, cast(greatest(1, least(960, y2 + trunc((y2 - y1) * 0.15::double))) as int) as d from f_boxes))""",
)
def _(x):
    return boxes.pad_box(x.f_boxes, mode="trunc").select("bundle_id", "box_id", "x1", "y1", "x2", "y2")


PADDED = """select bundle_id, box_id, cast(x1 - trunc((x2 - x1) * 0.15::double) as int) as x1, cast(y1 - trunc((y2 - y1) * 0.15::double) as int) as y1,
    cast(x2 + trunc((x2 - x1) * 0.15::double) as int) as x2, cast(y2 + trunc((y2 - y1) * 0.15::double) as int) as y2, round(conf, 6) + 0.0::double as conf, cls
  from f_boxes where bundle_id in (select bundle_id from f_images)"""
BOXED = "bundle_id in (select bundle_id from f_boxes)"


@register(
    "B6_crop_plan_always",
    f"""{PADDED} union all select bundle_id, null, null, null, null, null, case when {BOXED} then 0.6::double else 1.0::double end, '' from f_images""",
)
def _(x):
    return boxes.crop_plan(x.f_images, x.f_boxes)


@register(
    "B6_crop_plan_if_none",
    f"{PADDED} union all select bundle_id, null, null, null, null, null, 1.0::double, '' from f_images where not {BOXED}",
)
def _(x):
    return boxes.crop_plan(x.f_images, x.f_boxes, fallback="if_none")


@register(
    "B7_views",
    """select bundle_id, box_id, 'crop' as kind, unnest(['false', 'true']) as view from f_boxes
       union all select bundle_id, null, 'product', unnest(['identity', 'hflip', 'center_crop_85']) from f_images""",
)
def _(x):
    crops = boxes.mirror_views(x.f_boxes).select("bundle_id", "box_id", F.lit("crop").alias("kind"), F.col("mirrored").cast("string").alias("view"))
    products = boxes.expand_views(x.f_images, 3)
    return crops.unionByName(
        products.select("bundle_id", F.lit(None).cast("bigint").alias("box_id"), F.lit("product").alias("kind"), "view")
    )


@register(
    "B8_box_features",
    f"""select i.bundle_id, {', '.join(r6(f'coalesce({e}, 0)', n) for e, n in zip((
            'ln(1 + n)', 'mc', 'xc', 'ma / (640 * 960)', 'xa / (640 * 960)', 'ar', 'cx / 640', 'cy / 960'), BOX_FEATURES))}
        from f_images i left join (select bundle_id, count(*) as n, avg(conf) as mc, max(conf) as xc, avg((x2 - x1) * (y2 - y1)) as ma,
            max((x2 - x1) * (y2 - y1))::double as xa, avg((x2 - x1) / (y2 - y1)::double) as ar, avg((x1 + x2) * 0.5::double) as cx, avg((y1 + y2) * 0.5::double) as cy
          from f_boxes group by 1) using (bundle_id)""",
)
def _(x):
    return boxes.box_features(x.f_images, x.f_boxes)
