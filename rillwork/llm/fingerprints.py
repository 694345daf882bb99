"""Operator 7: fingerprints of documents as homomorphic multiset hashes of their paragraphs.

A paragraph is a line, or a sentence of one. It is hashed to a wide vector, and
a document's fingerprint is the sum of its paragraphs' vectors, each lane modulo
a power of two: the order of paragraphs does not matter, and a paragraph is put
in or taken out by adding or subtracting its vector. Two groups of lanes:

* COUNT: the number of paragraphs, modulo 2**32, and SUMS: four lanes of random
  64-bit values modulo 2**64, for equality;
* SIGNS: 128 lanes modulo 2**16 to which each run of three words within the
  paragraph, and the paragraph itself, gives +1 or -1. The product of two
  documents' lanes estimates how many runs they share, which gives a likeness
  from 0 to 1.

The next document in the order of doc_id comes from a range partitioning; where
a partition ends, its last document meets the first of the next partition.

Cases: a null text is empty, which is one empty paragraph; rows of one doc_id
follow each other by text; a null doc_id comes first; a single document is its
own next; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import pick, settle, shuffle_partitions, small_batches, text_or_empty
from rillwork.llm.words import mix, split_words, windows

LANES = 128
#: Words of a run.
RUN = 3
RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
STAGED = RESULT + ", edge int, part int, text string"


def paragraphs(text: str) -> list[str]:
    return text.replace(". ", ".\n").split("\n")


@dataclass
class Sums:
    """Fingerprints of several multisets of paragraphs, a row each."""

    count: np.ndarray
    sums: np.ndarray
    signs: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.count + other.count, self.sums + other.sums, self.signs + other.signs)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.count - other.count, self.sums - other.sums, self.signs - other.signs)

    def __getitem__(self, rows: slice) -> Sums:
        return Sums(self.count[rows], self.sums[rows], self.signs[rows])

    def bytes(self) -> list[bytes]:
        return [
            c.tobytes() + s.tobytes() + x.tobytes()
            for c, s, x in zip(self.count.astype("<u4"), self.sums.astype("<u8"), self.signs.astype("<u2"), strict=True)
        ]

    def likeness(self, other: Sums) -> np.ndarray:
        """Shared runs as a part of all runs of both, estimated from the lanes; 1 for equal fingerprints."""
        a, b = (x.signs.astype(np.uint16).astype(np.int16).astype(float) for x in (self, other))
        ab, both = (a * b).sum(axis=1), (a * a + b * b).sum(axis=1)
        same = (self.count == other.count) & (self.sums == other.sums).all(axis=1)
        part = np.clip(ab / np.maximum(both - ab, 1e-9), 0.0, 1.0)
        return np.where(same, 1.0, part)


def fingerprints_of(multisets: list[list[str]]) -> Sums:
    """Hash each paragraph to its vector and add up the vectors of each multiset."""
    n = len(multisets)
    size = np.fromiter(map(len, multisets), np.int64, n)
    flat = [p for own in multisets for p in own]
    raw = b"".join([hashlib.blake2b(p.encode("utf-8", "replace"), digest_size=40).digest() for p in flat])
    rows = np.frombuffer(raw, "<u8").reshape(len(flat), 5)
    words = split_words(pa.array(flat, pa.string()))
    runs, _, begin = windows(words.hashes, words.first, RUN)
    # what each paragraph adds to SIGNS: its runs and itself
    marks = np.concatenate([np.insert(runs, begin[1:], rows[:, 4])]) if len(flat) else runs
    ends = np.cumsum(np.diff(begin) + 1)
    out = Sums(size.astype(np.uint32), np.zeros((n, 4), np.uint64), np.zeros((n, LANES), np.uint32))
    cuts = np.concatenate([[0], np.cumsum(size)])
    at = np.concatenate([[0], ends])[cuts]
    full = np.flatnonzero(size)
    if len(full):
        out.sums[full] = np.add.reduceat(rows[:, :4], cuts[full], axis=0)
        bits = np.stack([mix(marks), mix(marks ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
        for low in range(0, len(full), 64):  # bounds what is unpacked at once
            some = full[low : low + 64]
            own = np.unpackbits(bits[at[some[0]] : at[some[-1] + 1]].view(np.uint8), axis=1)
            ones = np.add.reduceat(own, at[some] - at[some[0]], axis=0, dtype=np.uint32)
            out.signs[some] = 2 * ones - (at[some + 1] - at[some]).astype(np.uint32)[:, None]
    return out


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many, or all, of the next document."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def results(ids: list, texts: list[str], own: Sums) -> list[tuple]:
    """Rows of all documents but the last, each with the one behind it as its next.

    The edited text's fingerprint is the document's with the paragraphs behind
    the common ones taken out and put in.
    """
    edited = [edited_text(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    gone, come = [], []
    for a, b in zip(texts, edited, strict=False):
        old, new = paragraphs(a), paragraphs(b)
        same = next((i for i, (x, y) in enumerate(zip(old, new, strict=False)) if x != y), min(len(old), len(new)))
        gone.append(old[same:])
        come.append(new[same:])
    here, after = own[:-1], own[1:]
    changed = here - fingerprints_of(gone) + fingerprints_of(come)
    shas = [hashlib.sha256(x.encode("utf-8", "replace")).digest() for x in edited]
    near = here.likeness(changed).tolist(), here.likeness(after).tolist()
    return list(zip(ids, map(len, texts), shas, here.bytes(), changed.bytes(), *near, strict=False))


KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
KINDS += [pa.int32(), pa.int32(), pa.string()]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, KINDS[: len(names)], strict=True)], names)


def fingerprints(df: DataFrame) -> DataFrame:
    """One row for each row of ``df`` (doc_id, text); fingerprints as hexadecimal strings."""
    spark = df.sparkSession
    small_batches(spark)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            first = [] if texts else [(batch.column(0)[0].as_py(), *[None] * 6, 0, part, batch.column(1)[0].as_py())]
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            rows = results(ids, texts, fingerprints_of([paragraphs(t) for t in texts]))
            yield _batch(first + [(*r, None, None, None) for r in rows], STAGED)
            ids, texts = ids[-1:], texts[-1:]
        if texts:
            yield _batch([(ids[0], *[None] * 6, 1, part, texts[0])], STAGED)

    ranged = (
        pick(df, "doc_id", "text")
        .select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .repartitionByRange(shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    staged = settle(ranged.mapInArrow(walk, STAGED), "fingerprints")
    ends = staged.filter(F.col("edge").isNotNull())
    parts = sorted(r["part"] for r in ends.filter("edge = 0").select("part").collect())  # one for each partition
    turns = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1])] or [(-1, -1)], "part int, then int")
    heads = ends.filter("edge = 0").select(F.col("part").alias("then"), F.col("text").alias("following"))
    last = (
        ends.filter("edge = 1")
        .select("doc_id", "text", "part")
        .join(F.broadcast(turns), "part")  # a row for each shuffle partition
        .join(heads, "then")
        .select("doc_id", "text", "following")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                texts = [r["text"], r["following"]]
                rows += results([r["doc_id"]], texts, fingerprints_of([paragraphs(t) for t in texts]))
            yield _batch(rows, RESULT)

    names = [c.split()[0] for c in RESULT.split(", ")]
    whole = staged.filter(F.col("edge").isNull()).select(*names).unionByName(last.mapInArrow(close, RESULT))
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return whole.withColumns(hexed)
