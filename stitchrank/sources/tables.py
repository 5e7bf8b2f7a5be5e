"""Readers: tables, manifests, image listings, vectors, box caches, candidate caches."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stitchrank.functions.text import strip
from stitchrank.functions.vectors import l2_normalize
from stitchrank.operators.boxes import valid_boxes
from stitchrank.operators.retrieve import topk

CORRUPT = "_corrupt_record"


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_table(spark: SparkSession, path: str, required: Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (or Parquet) table that has all ``required`` columns, else a ``ValueError``.

    CSV columns are text unless ``schema`` names a type; columns are matched by name.
    """
    if _suffix(path) == "csv":
        df = spark.read.csv(path, header=True, multiLine=False, escape='"')
    else:
        df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks required columns {missing}; it has {df.columns}")
    if schema is None:
        return df
    types = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in types if f.name in df.columns])


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """``bundle_id, section, image_url``; a section such as ``2.0`` is read as 2."""
    df = read_table(spark, path, ["bundle_asset_id", "bundle_image_url"])
    section = F.col("bundle_id_section") if "bundle_id_section" in df.columns else F.lit(None)
    return df.select(
        F.col("bundle_asset_id").cast("string").alias("bundle_id"),
        section.cast("string").try_cast("double").cast("int").alias("section"),
        F.col("bundle_image_url").alias("image_url"),
    )


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """``product_id, image_url, description`` and ``gender`` where the file has it (NULL is 0)."""
    df = read_table(spark, path, ["product_asset_id", "product_image_url", "product_description"])
    columns = [
        F.col("product_asset_id").cast("string").alias("product_id"),
        F.col("product_image_url").alias("image_url"),
        F.col("product_description").alias("description"),
    ]
    if "gender" in df.columns:
        gender = F.col("gender").cast("string").try_cast("double").cast("int")
        columns.append(F.coalesce(gender, F.lit(0)).alias("gender"))
    return df.select(*columns)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """``bundle_id, product_id`` as text, duplicates kept."""
    df = read_table(spark, path, ["bundle_asset_id", "product_asset_id"])
    return df.select(
        F.col("bundle_asset_id").cast("string").alias("bundle_id"),
        F.col("product_asset_id").cast("string").alias("product_id"),
    )


RANK_BYTES = 8 << 20  # bytes of ranked files that one task sorts


def read_ranked_csv(spark: SparkSession, path: str, submission: int) -> DataFrame:
    """a foreign submission whose row order is the rank; a file, or a folder of files in order of their names.

    A row's place is the number of its file, the block of the file it was read from, and its turn in that block, so
    files are read in parallel and split. Rows are dealt to as many tasks as the size of the files asks for, about
    ``RANK_BYTES`` each. Data of our own carries ``rank`` and needs none of this.
    """
    raw = read_table(spark, path, ["bundle_asset_id", "product_asset_id"])
    # What the driver gets is the list of files that it makes for any scan; contents are not read.
    listed = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size").collect()
    names = sorted((r["file_path"] for r in listed), key=lambda name: name.encode())
    numbers = spark.createDataFrame(pa.table({"_number": pa.array(range(len(names)), pa.int32()), "_name": pa.array(names, pa.string())}))
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(session, -(-sum(r["file_size"] for r in listed) // RANK_BYTES))
    rows = raw.select(
        F.col("bundle_asset_id").cast("string").alias("bundle_id"),
        F.col("product_asset_id").cast("string").alias("product_id"),
        F.col("_metadata.file_path").alias("_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    changed = F.raise_error(F.concat(F.lit("not a file when the list was opened: "), "_name"))
    placed = rows.join(F.broadcast(numbers), "_name", "left").withColumn("_file", F.coalesce("_number", changed.cast("int")))
    # Names would be most of each row in the sort; numbers leave it a few words wide.
    dealt = placed.select("bundle_id", "product_id", "_file", "_block", "_row").repartition(parts, "bundle_id")
    order = F.row_number().over(Window.partitionBy("bundle_id").orderBy("_file", "_block", "_row"))
    return dealt.select(F.lit(submission).alias("submission"), "bundle_id", "product_id", order.alias("rank"))


def read_manifest(
    spark: SparkSession, path: str, strict: bool = False, schema: T.StructType | str | None = None
) -> DataFrame:
    """``.jsonl`` or ``.csv`` manifest. Blank lines never count; a broken JSON line fails the
    job when ``strict`` and is skipped otherwise. Give ``schema`` to save the inference pass.
    """
    suffix = _suffix(path)
    if suffix == "csv":
        return spark.read.csv(path, header=True, escape='"')
    if suffix != "jsonl":
        raise ValueError(f"{path}: manifests are .jsonl or .csv")
    if schema is None:
        schema = T.StructType([f for f in spark.read.json(path).schema if f.name != CORRUPT])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("r")).filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)


# Column names that manifests of products use, the first that holds a value counts.
MANIFEST_ID = ("product_asset_id", "product_id", "asset_id", "id")
MANIFEST_IMAGE = ("image_path", "product_image_path", "path", "local_image_path")
MANIFEST_TEXT = ("product_description", "description", "text")


def _first_filled(df: DataFrame, keys: Sequence[str]) -> Column:
    """The first of the columns ``keys`` with a value in the row, stripped; an empty string if none has one."""
    filled = [F.nullif(strip(F.col(k).cast("string")), F.lit("")) for k in keys if k in df.columns]
    return F.coalesce(*filled, F.lit(""))


def product_manifest(rows: DataFrame, folder: str) -> DataFrame:
    """(product_id, image_path, description) of the rows of a manifest, whose columns may have other names, row by row.

    Rows without an id are left out; a missing path is ``<folder>/<product_id>.jpg``, a missing description an empty string.
    Of rows with one id the last read stays.
    """
    named = rows.select(
        _first_filled(rows, MANIFEST_ID).alias("product_id"), _first_filled(rows, MANIFEST_IMAGE).alias("_path"),
        _first_filled(rows, MANIFEST_TEXT).alias("description"), F.monotonically_increasing_id().alias("_at"),
    ).filter(F.col("product_id") != "")
    path = F.when(F.col("_path") == "", F.concat(F.lit(folder.rstrip("/") + "/"), "product_id", F.lit(".jpg"))).otherwise(F.col("_path"))
    last = named.groupBy("product_id").agg(F.max_by(F.struct(path.alias("image_path"), "description"), "_at").alias("_last"))
    return last.select("product_id", "_last.*")


def list_assets(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``asset_id`` (file name without its last suffix) and ``path``. Contents are not read; files without content are no assets."""
    files = spark.read.format("binaryFile").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return files.select(stem.alias("asset_id"), "path").groupBy("asset_id").agg(F.min("path").alias("path"))


def _alias(df: DataFrame, keys: Sequence[str], what: str) -> str:
    for key in keys:
        if key in df.columns:
            return key
    raise KeyError(f"no {what} column: tried {list(keys)}, have {df.columns}")


def as_vectors(
    df: DataFrame, id_keys: Sequence[str], vec_keys: Sequence[str], feat_keys: Sequence[str] = (), normalize: bool = True
) -> DataFrame:
    """``id, v[, feat]`` from the first alias present of each kind.

    A row whose vector is missing or of another length than the rest fails the job that reads
    it. Features of varying length are dropped with a warning.
    """
    vec = _alias(df, vec_keys, "vector")
    key = _alias(df, id_keys, "id")
    first = df.select(F.size(vec).alias("n")).filter(F.col("n") > 0).first()
    dim = first["n"] if first else 0
    v = F.when(F.size(vec) == dim, F.col(vec)).otherwise(
        F.raise_error(F.concat(F.lit(f"vector is not of length {dim}: id "), F.col(key).cast("string")))
    )
    columns = [F.col(key).cast("string").alias("id"), (l2_normalize(v) if normalize else v).cast("array<float>").alias("v")]
    feat = next((k for k in feat_keys if k in df.columns), None)
    if feat is not None:
        low, high, gaps = df.agg(F.min(F.size(feat)), F.max(F.size(feat)), F.count_if(F.col(feat).isNull())).first()
        if low != high or gaps:
            warnings.warn(f"features {feat!r} ignored: lengths {low} to {high}, {gaps} missing", stacklevel=2)
        else:
            columns.append(F.col(feat).cast("array<double>").alias("feat"))
    return df.select(*columns)


def read_vectors(
    spark: SparkSession,
    path: str,
    id_keys: Sequence[str] = ("bundle_ids", "query_ids", "product_ids", "pids", "ids", "id"),
    vec_keys: Sequence[str] = ("embeddings", "query_embeddings", "product_embeddings", "bundle_embeddings", "v"),
    feat_keys: Sequence[str] = ("query_features", "box_features", "extra_features", "feat"),
    normalize: bool = True,
    images: DataFrame | None = None,
) -> DataFrame:
    """Parquet vector table; ``images`` (S3) keeps only ids that have an image."""
    df = as_vectors(spark.read.parquet(path), id_keys, vec_keys, feat_keys, normalize)
    if images is not None:
        df = df.join(images.select(F.col("asset_id").alias("id")), "id", "left_semi")
    return df


def boxes_cache_path(root: str, conf: float = 0.25, iou: float = 0.45, max_boxes: int = 15, min_area: float = 0.001) -> str:
    """Cache folder whose name holds the detector parameters, so that others never match."""
    return f"{root.rstrip('/')}/bundle_boxes_conf{conf}_iou{iou}_max{max_boxes}_area{min_area}"


def boxes_from_json(lines: DataFrame) -> DataFrame:
    """Boxes of JSON objects ``{bundle: [[x1, y1, x2, y2, score], ...]}`` in ``value``."""
    cache = F.from_json("value", "map<string,array<array<string>>>")
    per_bundle = lines.select(F.explode(cache).alias("bundle_id", "boxes"))
    raw = per_bundle.select("bundle_id", F.posexplode("boxes").alias("box_id", "box"))
    return valid_boxes(raw)


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Box cache: one JSON document (``.json``), one object per line (``.jsonl``), or Parquet."""
    suffix = _suffix(path)
    if suffix in ("json", "jsonl"):
        return boxes_from_json(spark.read.text(path, wholetext=suffix == "json"))
    return spark.read.parquet(path)


def missing_ids(ids: DataFrame, cache: DataFrame) -> DataFrame:
    """Ids the cache lacks, the only ones to be detected again."""
    return ids.select("bundle_id").distinct().join(cache.select("bundle_id"), "bundle_id", "left_anti")


def fingerprint(df: DataFrame, key: str) -> str:
    """Order-free fingerprint of an id set."""
    row = df.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64(key)).alias("x"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("s")
    ).first()
    return f"{row['n']}.{row['x'] or 0}.{row['s'] or 0}"


def cached_topk(
    spark: SparkSession, path: str, queries: DataFrame, index: DataFrame, k: int, key: str = "bundle_id"
) -> DataFrame:
    """Top-k candidates, read back when query ids, product ids and k all match, else computed.

    The folder is named after the three, and a Parquet job only shows its files once complete.
    """
    folder = f"{path.rstrip('/')}/q{fingerprint(queries, key)}_p{fingerprint(index, 'product_id')}_k{k}"
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        topk(queries, index, k).write.mode("overwrite").parquet(folder)
        return spark.read.parquet(folder)
