"""Text columns: null-like values, id lists, labels, seeds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character for which str.isspace() holds; SQL TRIM alone removes only U+0020.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(c: Column) -> Column:
    """Trim any Unicode white space on both sides."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def null_like(c: Column) -> Column:
    """Trimmed text; NULL for an empty value or the words ``nan`` / ``none``."""
    text = strip(c)
    return F.when(~F.lower(text).isin("", "nan", "none"), text)


def first_non_empty(df: DataFrame, keys: Sequence[str]) -> Column:
    """First usable value over the alias columns ``df`` really has, else NULL."""
    present = [null_like(F.col(key)) for key in keys if key in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def _usable(items: Column) -> Column:
    return F.filter(F.transform(items, null_like), lambda x: x.isNotNull())


def parse_id_list(c: Column, is_array: bool = False) -> Column:
    """Ids of a list-valued field.

    Arrays are cleaned as they are. Text is read as a JSON array if it is one, else it
    is split on the first separator (pipe, comma, semicolon, space) that yields an id.
    """
    if is_array:
        return F.coalesce(_usable(c.cast("array<string>")), F.array().cast("array<string>"))
    text = null_like(c)
    from_json = F.when(
        text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>")
    )
    options = [_usable(from_json)]
    for separator in ("|", ",", ";", " "):
        parts = _usable(F.split(text, f"[{separator}]"))
        options.append(F.when(F.contains(text, F.lit(separator)) & (F.size(parts) > 0), parts))
    options.append(F.when(text.isNotNull(), F.array(text)))
    return F.coalesce(*options, F.array().cast("array<string>"))


def category_key(c: Column) -> Column:
    """Trimmed upper-case description; empty text when missing."""
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def clean_labels(c: Column) -> Column:
    """P5: lower-case label tokens of a description, in order, duplicates kept."""
    text = F.regexp_replace(strip(F.lower(c)), r"[_\t\r\n-]+", " ")
    text = F.regexp_replace(text, r"\s+", " ")
    tokens = F.transform(F.split(text, r"[,;|/]+"), strip)
    return F.coalesce(F.filter(tokens, lambda x: x != ""), F.array().cast("array<string>"))


def drop_excluded(c: Column, excluded: Iterable[str]) -> Column:
    """Struct of the labels kept and the number removed."""
    banned = F.array(*[F.lit(word) for word in sorted(set(excluded))]).cast("array<string>")
    kept = F.filter(c, lambda x: ~F.array_contains(banned, x))
    return F.struct(kept.alias("kept"), (F.size(c) - F.size(kept)).alias("removed"))


def dedup_keep_first(c: Column) -> Column:
    """Distinct items in order of first appearance."""
    return F.array_distinct(c)


def sorted_set(c: Column) -> Column:
    """Distinct items, ascending."""
    return F.array_sort(F.array_distinct(c))


def is_baby(c: Column) -> Column:
    """Description starting with the kids prefix ``BABY``."""
    return category_key(c).startswith("BABY ")


def stable_seed(*parts: Column) -> Column:
    """Unsigned 64-bit seed from the SHA-256 of the parts joined with ``||``."""
    digest = F.sha2(F.concat_ws("||", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def parse_ks(text: str, positive_only: bool = False) -> list[int]:
    """Sorted distinct cut-offs of a comma-separated argument."""
    ks = sorted({int(token) for token in text.split(",") if token.strip()})
    if positive_only:
        ks = [k for k in ks if k > 0]
    if not ks:
        raise ValueError(f"no usable cut-off in {text!r}")
    return ks


def parse_ks_column(c: Column) -> Column:
    """P18 for a column of such lists."""
    tokens = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda x: x.cast("int"))))


def score_text(c: Column) -> Column:
    """A score printed with four decimals."""
    return F.format_string("%.4f", c.cast("double"))
