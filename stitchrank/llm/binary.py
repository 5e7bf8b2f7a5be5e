"""Operator 10: token ids in bit-packed files with block offsets."""

from __future__ import annotations

import itertools
import os
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stitchrank.llm.common import NULL_ID, partitions, table
from stitchrank.operators.scale import shared_dir

END_ID = 2
MAGIC = b"PKIDS1\0\0"
# Ids in a block; a multiple of 64, so that every block of any width ends on a whole word.
BLOCK = 4096
# Ids after which a task begins another file.
FILE_IDS = 32_000_000
# Parts a worker remembers; parts encoded in one call; characters of text cut at a time.
KNOWN = 1_400_000
TOGETHER = 64
LOT_CHARS = 2_000_000
# How the byte-level alphabet writes a space; it writes ASCII letters as they are.
SPACE = "\u0120"
# White space other than spaces and line breaks.
_OTHER = re.compile(r"[^\S \n]")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, lowest bit first, without gaps."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """Inverse of :func:`pack`, vectorised."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    return (planes.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """One file: magic, packed blocks, then doc ids, doc starts and block offsets, then a fixed-size tail."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.offsets, self.ids, self.starts, self.n = [], [], [], 0
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        out.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            data = pack(ids[at : min(at + BLOCK, whole)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.pending, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for values in (self.ids, self.starts, self.offsets):
            self.out.write(np.asarray(values, "<i8").tobytes())
        self.out.write(struct.pack("<qqqq", self.bits, len(self.ids), self.n, len(self.offsets)) + MAGIC)
        self.out.close()


class Reader:
    """Random access to a file: its documents, and the ids of any range."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(32 + len(MAGIC), size - 32 - len(MAGIC))
        if tail[32:] != MAGIC:
            raise ValueError("not a file of packed ids, or a part of one")
        self.bits, docs, self.n, blocks = struct.unpack("<qqqq", tail[:32])
        table_ = np.frombuffer(source.read_at(8 * (2 * docs + blocks), size - 32 - len(MAGIC) - 8 * (2 * docs + blocks)), "<i8")
        self.ids, self.starts, self.offsets = table_[:docs], table_[docs : 2 * docs], table_[2 * docs :]

    def document(self, i: int) -> np.ndarray:
        end = self.starts[i + 1] if i + 1 < len(self.starts) else self.n
        return self.range(int(self.starts[i]), int(end))

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end``, reading only the blocks that hold them."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (end - 1) // BLOCK
        count = min((last + 1) * BLOCK, self.n) - first * BLOCK
        data = self.source.read_at((count * self.bits + 7) // 8, int(self.offsets[first]))
        return unpack(data, self.bits, count)[start - first * BLOCK : end - first * BLOCK]


class Encoder:
    """Ids of whole texts from a byte-level tokenizer that never joins a word with the space before the next.

    A text is cut before each single space, and around each single line break, between two other
    characters; the tokenizer's pattern always ends a piece there, so the ids of the parts are the ids of
    the whole. Frequent parts are remembered. New parts are encoded many in one text: a part begins
    with the only space in it, and so do its ids, or stands between line breaks, which shows where one ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for parts that are one piece of the pattern already, written in the byte-level alphabet.
        self.pieces = Tokenizer.from_file(path)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.known: dict[str, int] = {}
        self._empty()

    def _empty(self) -> None:
        """No part is known. The ids of part ``i`` are ``ids[starts[i] : starts[i] + sizes[i]]``."""
        self.known.clear()
        self.ids, self.used_ids = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int64)

    @staticmethod
    def parts(text: str) -> list[str]:
        """Names of the parts: after a space those that no space precedes, without theirs the others."""
        odd = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0].isspace() or text[-1].isspace()
        if not odd and _OTHER.search(text) is None:
            # A single line break is a part of its own, too.
            cut = text.replace("\n", " \n ").split(" ")
            cut[0] = " " + cut[0]
            at = -1
            for _ in range(text.count("\n")):
                at = cut.index("\n", at + 1)
                cut[at] = " \n"
                cut[at + 1] = " " + cut[at + 1]
            return cut
        cut = text.split(" ")
        out = [" " + cut[0]]
        for p in cut[1:]:
            if p and not p[0].isspace() and not out[-1][-1].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def _store(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.known)
        while at + len(names) > len(self.starts):
            self.starts, self.sizes, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes, self.uses))
        while self.used_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used_ids : self.used_ids + len(ids)] = ids
        self.starts[at : at + len(names)] = self.used_ids + np.cumsum(sizes) - sizes
        self.sizes[at : at + len(names)] = sizes
        self.used_ids += len(ids)
        self.known.update(zip(names, range(at, at + len(names)), strict=True))

    def _learn(self, names: set[str]) -> None:
        """Encode new parts: those with white space inside alone, all others many in one text."""
        letters, words, firsts, alone = [], [], [], []
        for name in names:
            if name.isascii() and name.isalpha():
                letters.append(name)
            elif len(name.split()) != 1 or name[-1].isspace() or name[:2].isspace():
                alone.append(name)
            else:
                (firsts if name[0] == " " else words).append(name)
        for at in range(0, len(alone), TOGETHER):
            some = alone[at : at + TOGETHER]
            texts = [n[1:] if n[0] == " " else " " + n for n in some]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._store(some, np.concatenate(found), np.array([len(f) for f in found]))
        for model, parts, glue in ((self.pieces, letters, " " + SPACE), (self.tokenizer, words, " ")):
            for at in range(0, len(parts), TOGETHER):
                some = parts[at : at + TOGETHER]
                ids = np.array(model.encode_batch_fast([glue + glue.join(some)], add_special_tokens=False)[0].ids, np.uint32)
                self._store(some, ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))))
        for at in range(0, len(firsts), TOGETHER):
            some = firsts[at : at + TOGETHER]
            lines = "\n".join([n[1:] for n in some])
            ids = np.array(self.tokenizer.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
            breaks = np.flatnonzero(ids == self.line_break)
            self._store(some, np.delete(ids, breaks), np.diff(np.concatenate(([-1], breaks, [len(ids)]))) - 1)

    def _keep_frequent(self) -> None:
        """Forget the parts that were used once since the last time."""
        names = list(self.known)
        kept = np.flatnonzero(self.uses[: len(names)] > 1)
        if len(kept) > KNOWN // 2:
            kept = kept[np.argsort(-self.uses[kept], kind="stable")[: KNOWN // 2]]
        sizes, starts = self.sizes[kept], self.starts[kept]
        ids = self.ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        self._empty()
        self._store([names[i] for i in kept.tolist()], ids, sizes)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > KNOWN:
            self._keep_frequent()
        cut = [self.parts(t) if t else [] for t in texts]
        names = list(itertools.chain.from_iterable(cut))
        which = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(which < 0)
        if len(missing):
            late = [names[i] for i in missing.tolist()]
            self._learn(set(late))
            which[missing] = np.fromiter(map(self.known.__getitem__, late), np.int64, len(late))
        if not len(which):
            return [np.empty(0, np.uint32) for _ in texts]
        self.uses += np.bincount(which, minlength=len(self.uses))
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        stops = np.concatenate(([0], ends))[np.cumsum([len(c) for c in cut])]
        return np.split(ids, stops[:-1])


# One encoder per Python worker, which serves many tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_bits(path: str) -> int:
    """Bits of the largest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return max(1, int(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def encoded(docs: DataFrame, tokenizer: str, bits: int, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, packed): the packed ids of each whole text and the end id."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes, packed, lot, held = [], [], [], 0
            for i, text in enumerate(texts):
                lot.append(text)
                held += len(text or "")
                if held >= LOT_CHARS or i == len(texts) - 1:
                    for ids in known.encode(lot):
                        sizes.append(len(ids) + 1)
                        packed.append(pack(np.append(ids, np.uint32(end_id)), bits))
                    lot, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "packed"]
            )

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n_tokens long, packed binary")


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` in ascending doc_id order; returns the manifest (part, file, n_docs, n_ids).

    Texts are encoded where they are read and only packed ids are shuffled, into ranges of doc_id cut
    at quantiles of the ids. A task writes its range as files of about ``FILE_IDS`` ids, each under a name
    of its own and renamed when complete, so a task that is run again leaves whole files. Null ids come
    last; rows of one id are ordered by their ids. ``folder`` must be one that all executors see.
    """
    spark = docs.sparkSession
    bits = vocabulary_bits(tokenizer)
    n = partitions(spark)
    cuts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    part = F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    lined = (
        encoded(docs, tokenizer, bits, end_id).withColumn("part", part.cast("int"))
        .repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "packed")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done, writer, names, at = [], None, None, None

        def close():
            writer.close()
            fs.move(names[0], names[1])
            done.append((at, len(done), names[1], len(writer.ids), writer.n))

        for batch in batches:
            for doc_id, count, packed, of in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if writer is not None and (of != at or writer.n >= FILE_IDS):
                    close()
                    writer = None
                if writer is None:
                    at = of
                    name = f"{of:06d}-{len(done):04d}"
                    names = posixpath.join(root, f"_{name}-{uuid.uuid4().hex}"), posixpath.join(root, f"{name}.ids")
                    writer = Writer(fs.open_output_stream(names[0]), bits)
                writer.add(doc_id, unpack(packed, bits, count))
        if writer is not None:
            close()
        columns = list(zip(*done, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=["part", "seq", "file", "n_docs", "n_ids"],
        )

    return lined.mapInArrow(write, "part int, seq int, file string, n_docs long, n_ids long")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, decoded from the files.

    ``start`` is the sum of the ids in the files before (one row per file meets in that window) and in the file before.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = files.select("file", "first").repartition(partitions(manifest.sparkSession), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with fs.open_input_file(file) as source:
                    reader = Reader(source)
                    for at in range(0, len(reader.ids), 1000):
                        ids = [reader.document(i).astype("<u4") for i in range(at, min(at + 1000, len(reader.ids)))]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([None if d == NULL_ID else int(d) for d in reader.ids[at : at + 1000]], pa.int64()),
                                pa.array(reader.starts[at : at + 1000] + first, pa.int64()),
                                pa.array([len(i) for i in ids], pa.int64()),
                                pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                                pa.array([file] * len(ids)),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                        )

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a new folder under the shared one and read the files back.

    Null and empty texts have the end id alone; an empty table writes no file and gives no rows.
    """
    from stitchrank.llm.common import written

    folder = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_ids(written(write_ids(docs, folder, tokenizer, end_id)), folder)


def op10_binary_ids(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")
