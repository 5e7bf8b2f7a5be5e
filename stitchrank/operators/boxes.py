"""Detector boxes as tables (B1-B8): ``bundle_id, box_id, x1, y1, x2, y2, conf[, cls]``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchrank.fixed_values import BOX_FEATURES, PRODUCT_VIEWS
from stitchrank.operators.scale import checkpointed

PADDING = 0.15
DEFAULT_CLASS = "clothing"
NMS_BAND = 256  # boxes of one image folded in one go


def _clip(low: Column, high: Column, c: Column) -> Column:
    return F.greatest(low, F.least(c, high))


def sanitize_boxes(
    boxes: DataFrame,
    min_area_ratio: float = 0.001,
    max_boxes: int = 15,
    class_names: Mapping[int, str] | None = None,
) -> DataFrame:
    """B1: rounded, clipped, not too small boxes, the ``max_boxes`` most confident per image.

    ``boxes`` also has ``width`` and ``height``. With ``class_names``, ``cls_id`` becomes
    ``cls``; an unknown id counts as clothing.
    """
    w, h, zero, one = F.col("width"), F.col("height"), F.lit(0), F.lit(1)
    whole = {c: F.rint(c).cast("int") for c in ("x1", "y1", "x2", "y2")}
    clipped = {
        "x1": _clip(zero, w - 1, whole["x1"]),
        "y1": _clip(zero, h - 1, whole["y1"]),
        "x2": _clip(one, w, whole["x2"]),
        "y2": _clip(one, h, whole["y2"]),
    }
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    least_area = (w * h * F.lit(min_area_ratio)).cast("bigint")
    clean = boxes.withColumns(clipped).filter(
        (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (area >= least_area)
    )
    if class_names is not None:
        pairs = [F.lit(x) for item in class_names.items() for x in item]
        clean = clean.withColumn(
            "cls", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("cls_id")), F.lit(DEFAULT_CLASS))
        )
    order = Window.partitionBy("bundle_id").orderBy(F.desc("conf"), F.asc("box_id"))
    return clean.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_boxes)


def valid_boxes(raw: DataFrame) -> DataFrame:
    """B2: cached boxes ``(bundle_id, box_id, box array<string>)`` that hold four numbers and area.

    A missing fifth value means score 1; one that is no number drops the box.
    """
    def number(i: int) -> Column:
        return F.try_element_at(F.col("box"), F.lit(i)).try_cast("double")

    coordinates = {c: F.rint(number(i)).cast("int") for i, c in enumerate(("x1", "y1", "x2", "y2"), start=1)}
    conf = F.when(F.size("box") >= 5, number(5)).otherwise(1.0)
    rows = raw.withColumns({**coordinates, "conf": conf}).drop("box")
    return rows.filter(
        (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & F.col("conf").isNotNull()
    )


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 for an empty union."""
    def side(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), high - low).cast("bigint")

    overlap = side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * side(
        F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"])
    )
    areas = side(a["x1"], a["x2"]) * side(a["y1"], a["y2"]) + side(b["x1"], b["x2"]) * side(b["y1"], b["y2"])
    union = areas - overlap
    return F.when(union > 0, overlap / union).otherwise(0.0)


def nms(
    boxes: DataFrame, iou: float = 0.5, max_boxes: int = 10, min_score: float = 0.15, band: int = NMS_BAND
) -> DataFrame:
    """Greedy non-maximum suppression per image, best score first.

    An image is folded over its ``band`` best boxes. Detectors return far fewer, so one pass
    is all; an image with more goes on: its remaining boxes are checked against the kept ones
    in parallel and the survivors fill the next band. Every round keeps at least one more
    box per open image, so there are at most ``max_boxes`` rounds, and no task ever holds more
    than one band of an image.
    """
    usable = boxes.filter(F.col("conf") >= min_score)
    columns = [c for c in usable.columns if c != "bundle_id"]
    sort_first = [(-F.col("conf")).alias("_s"), F.col("box_id").alias("_b")]
    item = F.struct(*sort_first, F.struct(*columns).alias("box"))
    order = Window.partitionBy("bundle_id").orderBy(F.desc("conf"), F.asc("box_id"))

    def clear(kept: Column, box: Column) -> Column:
        return F.forall(kept, lambda k: box_iou(k, box) < iou)

    def fold(rest: DataFrame, kept: DataFrame | None) -> DataFrame:
        top = rest.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= band)
        lists = top.groupBy("bundle_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
        empty = F.slice(F.transform("_items", lambda x: x["box"]), 1, 0)
        if kept is None:
            start = empty
        else:
            lists = lists.join(kept, "bundle_id", "left")
            start = F.coalesce("kept", empty)
        grown = F.aggregate(
            "_items",
            start,
            lambda acc, x: F.when(
                (F.size(acc) < max_boxes) & clear(acc, x["box"]), F.concat(acc, F.array(x["box"]))
            ).otherwise(acc),
        )
        return lists.select("bundle_id", grown.alias("kept"))

    kept = fold(usable, None)
    crowded = usable.groupBy("bundle_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > band)
    if not crowded.isEmpty():
        kept = checkpointed(kept)
        rest = usable.join(crowded.select("bundle_id"), "bundle_id", "left_semi")
        while True:
            # A taken box goes by its id: an empty one does not overlap itself.
            taken = F.array_contains(F.transform("kept", lambda k: k["box_id"]), F.col("box_id"))
            rest = checkpointed(
                rest.join(kept, "bundle_id")
                .filter((F.size("kept") < max_boxes) & ~taken & clear(F.col("kept"), F.struct(*columns)))
                .select(*usable.columns)
            )
            if rest.isEmpty():
                break
            grown = fold(rest, kept)
            kept = checkpointed(kept.join(grown, "bundle_id", "left_anti").unionByName(grown))
    rows = kept.select("bundle_id", F.posexplode("kept").alias("_pos", "_box"))
    return rows.select("bundle_id", "_box.*", (F.col("_pos") + 1).alias("rank"))


def pad_box(df: DataFrame, padding: float = PADDING, mode: str = "ceil_clamp") -> DataFrame:
    """Boxes grown by ``padding`` and kept inside ``width`` x ``height``.

    ``ceil_clamp`` rounds the margin up and falls back to the box itself; ``trunc`` cuts the
    margin to whole pixels, clamps as a crop does, and falls back to the full image.
    """
    x1, y1, x2, y2, w, h = (F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height"))
    zero, one = F.lit(0), F.lit(1)
    if mode == "ceil_clamp":
        px = F.ceil((x2 - x1) * F.lit(padding)).cast("int")
        py = F.ceil((y2 - y1) * F.lit(padding)).cast("int")
        grown = [F.greatest(zero, x1 - px), F.greatest(zero, y1 - py), F.least(w, x2 + px), F.least(h, y2 + py)]
        other = [x1, y1, x2, y2]
    elif mode == "trunc":
        px = ((x2 - x1) * F.lit(padding)).cast("int")
        py = ((y2 - y1) * F.lit(padding)).cast("int")
        grown = [
            _clip(zero, w - 1, x1 - px), _clip(zero, h - 1, y1 - py),
            _clip(one, w, x2 + px), _clip(one, h, y2 + py),
        ]
        other = [zero, zero, w, h]
    else:
        raise ValueError(f"unknown padding mode {mode!r}")
    ok = (grown[2] > grown[0]) & (grown[3] > grown[1])
    return df.withColumns(
        {c: F.when(ok, g).otherwise(o) for c, g, o in zip(("x1", "y1", "x2", "y2"), grown, other)}
    )


def crop_plan(
    bundles: DataFrame, boxes: DataFrame, fallback: str = "always", full_conf: float = 0.6, padding: float = PADDING
) -> DataFrame:
    """The crops to cut for every bundle; a NULL box is the full image.

    ``always`` adds the full image at ``full_conf`` behind the boxes, ``if_none`` does not; a
    bundle without boxes gets the full image at confidence 1 and no class either way.
    """
    if fallback not in ("always", "if_none"):
        raise ValueError(f"unknown fallback policy {fallback!r}")
    images = bundles.select("bundle_id").distinct()
    px = ((F.col("x2") - F.col("x1")) * F.lit(padding)).cast("int")
    py = ((F.col("y2") - F.col("y1")) * F.lit(padding)).cast("int")
    cls = F.col("cls") if "cls" in boxes.columns else F.lit("")
    padded = boxes.join(images, "bundle_id", "left_semi").select(
        "bundle_id", "box_id",
        (F.col("x1") - px).alias("x1"), (F.col("y1") - py).alias("y1"),
        (F.col("x2") + px).alias("x2"), (F.col("y2") + py).alias("y2"),
        "conf", cls.alias("cls"),
    )
    boxed = boxes.select("bundle_id").distinct().withColumn("_boxed", F.lit(True))
    full = images.join(boxed, "bundle_id", "left")
    if fallback == "if_none":
        full = full.filter(F.col("_boxed").isNull())
    types = dict(padded.dtypes)
    nothing = [F.lit(None).cast(types[c]).alias(c) for c in ("box_id", "x1", "y1", "x2", "y2")]
    conf = F.when(F.col("_boxed"), full_conf).otherwise(1.0)
    return padded.unionByName(full.select("bundle_id", *nothing, conf.alias("conf"), F.lit("").alias("cls")))


def expand_views(df: DataFrame, n: int) -> DataFrame:
    """Every product row once per view, one to five of them."""
    views = PRODUCT_VIEWS[: max(1, min(n, len(PRODUCT_VIEWS)))]
    return df.withColumn("view", F.explode(F.array(*[F.lit(v) for v in views])))


def mirror_views(crops: DataFrame) -> DataFrame:
    """Every crop once as it is and once mirrored."""
    return crops.withColumn("mirrored", F.explode(F.array(F.lit(False), F.lit(True))))


def box_features(bundles: DataFrame, boxes: DataFrame) -> DataFrame:
    """The eight box features of every bundle; zeros without boxes or image size.

    Sums in pixels are taken per bundle first and scaled by the image size after the join.
    """
    bw = F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")).cast("double"))
    bh = F.greatest(F.lit(1.0), (F.col("y2") - F.col("y1")).cast("double"))
    sums = boxes.groupBy("bundle_id").agg(
        F.count("*").alias("_n"),
        F.avg("conf").alias("_mean_conf"),
        F.max("conf").alias("_max_conf"),
        F.avg(bw * bh).alias("_mean_area"),
        F.max(bw * bh).alias("_max_area"),
        F.avg(bw / bh).alias("_aspect"),
        F.avg((F.col("x1") + F.col("x2")) * F.lit(0.5)).alias("_cx"),
        F.avg((F.col("y1") + F.col("y2")) * F.lit(0.5)).alias("_cy"),
    )
    area = F.col("width").cast("double") * F.col("height")
    values = [
        F.log1p(F.col("_n").cast("double")), F.col("_mean_conf"), F.col("_max_conf"),
        F.col("_mean_area") / area, F.col("_max_area") / area, F.col("_aspect"),
        F.col("_cx") / F.col("width"), F.col("_cy") / F.col("height"),
    ]
    sized = (F.col("width") > 1) & (F.col("height") > 1)
    return bundles.join(sums, "bundle_id", "left").select(
        "bundle_id",
        *[F.coalesce(F.when(sized, v), F.lit(0.0)).alias(name) for name, v in zip(BOX_FEATURES, values)],
    )
