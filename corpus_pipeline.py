"""The training-data pipeline: each stage works on all that the one before has kept.

Stages keep the columns of ``docs``, whatever their names, and judge rows, not ids: ids may be null or repeat, and rows
may be equal. Empty tables give empty results; without usable labels or items nothing is dropped on their account.
"""

from __future__ import annotations

from stitchrank.llm import decontaminate, jaccard, mixing, quality, sharding
from stitchrank.llm.common import table, written


def accepted(spark, docs, sf_dir):
    """Documents that the quality classifier, fitted on the labels of this input, does not reject.

    A null text is scored as an empty one; equal texts have equal scores.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select("row.*")


def distinct(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The one with the smallest id stays, null being the largest; ties go by text and row, and of equal rows one stays.
    Texts without words (null, empty) all stay.
    """
    return jaccard.one_of_each(docs)


def decontaminated(spark, docs, sf_dir):
    """Documents that contain no item of the benchmark. Null and empty texts and items match nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Documents repeated or left out so that sources come near their target weights.

    Null sources are one source, the last; equal rows draw alike; null and empty texts have size 0.
    """
    return mixing.mix(docs)


def sharded(spark, docs, sf_dir):
    """doc_id, size, shard and slot of every row: contiguous shards of equal bytes; null ids come last, equal rows have slots of their own."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", accepted), ("near_duplicates", distinct), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded),
]

# The classifier is not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
