"""Operator 2: vector best-fit packing of documents into sequences, over all data at once.

A piece asks for (tokens, one document, attention cost = tokens squared); a
sequence offers a capacity of each. All three follow from the piece's length,
so pieces of one length are alike and a histogram of lengths, never longer than
a sequence, says all that packing needs. The driver packs that histogram:
lengths from the longest, each into the open bin that scores best among those
with room in every dimension. Bins in the same state are kept as one entry with
a count, so the work does not grow with the number of documents. Pieces then
find their bin by their rank among those of their length: a task numbers its own
pieces as it cuts them, and a table of counts, a row for each task and length, says
how many come before.

``score="norm"`` takes the bin whose weighted residual norm after placing is
least; ``score="dot"`` the bin whose weighted dot-product of residual and demand
is greatest.

Cases: a null or empty text is one piece with the end id only; rows that repeat
are packed each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.common import pick, settle, small_batches, trimmed
from rillwork.llm.token_matrix import cut
from rillwork.llm.tokens import tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLAN = "length long, lo long, hi long, each long, first_sequence long, at long"
#: Plan rows up to which the plan is broadcast (48 bytes a row); the histogram bounds them, this makes sure.
PLAN_ROWS = 200_000


def token_pieces(df: DataFrame, vocabulary: str, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of each document of ``df`` (doc_id, text): only documents longer than ``seq_len`` are cut.

    part and nth: the task, and how many pieces of the same length it gave before.
    """
    small_batches(df.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        given = np.zeros(seq_len + 1, np.int64)
        for batch in trimmed(batches):
            ids, begin = own.ids(batch.column("text"), end_id)
            doc, piece, start, length = cut(np.diff(begin), seq_len)
            raw = memoryview(ids.astype("<u4", copy=False).tobytes())
            at = (begin[doc] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            columns = [batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            order = np.argsort(length, kind="stable")
            run = np.searchsorted(length[order], length[order])
            nth = np.empty(len(length), np.int64)
            nth[order] = given[length[order]] + np.arange(len(length)) - run
            given += np.bincount(length, minlength=seq_len + 1)
            columns += [pa.array(np.full(len(length), part), pa.int32()), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    return pick(df, "doc_id", "text").mapInArrow(pieces, PIECES)


def plan_bins(
    histogram: dict[int, int],
    tokens: int = 2048,
    documents: int | None = None,
    attention: int | None = None,
    score: str = "norm",
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``histogram`` (length to count). Rows: length, ranks from and below, pieces a bin, first bin, place in it."""
    caps = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=float)
    factors = np.array(weights) / (caps**2)
    left = np.zeros((64, 3))
    bins = np.zeros(64, np.int64)
    held: list[list[tuple[int, int, int]]] = []  # of each entry: (length, pieces a bin, first rank)

    def new_entry(room: np.ndarray, count: int, content: list[tuple[int, int, int]]) -> None:
        nonlocal left, bins
        if len(held) == len(bins):
            left, bins = np.concatenate([left, np.zeros_like(left)]), np.concatenate([bins, np.zeros_like(bins)])
        left[len(held)], bins[len(held)] = room, count
        held.append(content)

    def split(g: int, count: int) -> int:
        """Take ``count`` bins off entry ``g`` as an entry of their own; they have its first ranks."""
        new_entry(left[g], count, list(held[g]))
        held[g] = [(length, k, lo + count * k) for length, k, lo in held[g]]
        bins[g] -= count
        return len(held) - 1

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        need = np.array([length, 1, length * length], dtype=float)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} ids fits no sequence")
        while n:
            live = left[: len(held)]
            fits = np.flatnonzero((live >= need).all(axis=1))
            if len(fits):
                after = live[fits] - need if score == "norm" else live[fits]
                value = (after**2) @ factors if score == "norm" else -(after @ (factors * need))
                g = int(fits[np.argmin(value)])
                most = int((left[g] // need).min()) if score == "norm" else 1
                k = min(most, n)
                count = min(int(bins[g]), n // k)
            else:
                k = min(int((caps // need).min()) if score == "norm" else 1, n)
                count = n // k
                new_entry(caps, count, [])
                g = len(held) - 1
            if count < bins[g]:
                g = split(g, count)
            held[g].append((length, k, rank))
            left[g] -= need * k
            rank += count * k
            n -= count * k
    out, first = [], 0
    for g, content in enumerate(held):
        at = 0
        for length, k, lo in content:
            out.append((length, lo, lo + k * int(bins[g]), k, first, at))
            at += length * k
        first += int(bins[g])
    return out


def bins_of(plan: list[tuple[int, int, int, int, int, int]]) -> int:
    return max((first + -(-(hi - lo) // each) for _, lo, hi, each, first, _ in plan), default=0)


def tightest(histogram: dict[int, int], tokens: int, score: str) -> tuple[int, int, list]:
    """Capacities of documents and of attention, least to an eighth, that need no more sequences than ids alone, and the plan.

    Documents first; attention has no choice where one piece fills a sequence.
    """
    plan = plan_bins(histogram, tokens, score=score)
    fewest, total = bins_of(plan), sum(histogram.values())
    held: dict[int, list[int]] = {}  # documents and attention of the bins from each first one
    for length, _, _, each, first, _ in plan:
        own = held.setdefault(first, [0, 0])
        own[0], own[1] = own[0] + each, own[1] + each * length * length
    caps = [max((own[k] for own in held.values()), default=1) for k in (0, 1)]
    least = [-(-total // max(fewest, 1)), max((n * n for n in histogram), default=1)]
    for k in (0, 1):
        low = max(least[k], 1)
        while caps[k] - low > caps[k] // 8:
            tried = [*caps[:k], (low + caps[k]) // 2, *caps[k + 1 :]]
            other = plan_bins(histogram, tokens, *tried, score=score)
            if bins_of(other) <= fewest:
                plan, caps = other, tried
            else:
                low = tried[k] + 1
    return *caps, plan


def assign(pieces: DataFrame, plan: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Give each of ``pieces`` (a settled table) its sequence and its place there."""
    spark = pieces.sparkSession
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
    bases = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("_rank", F.col("_base") + F.col("nth"))
    # as Arrow, so that no Python worker but those of the work itself is started for it
    names = [c.split()[0] for c in PLAN.split(", ")]
    columns = np.array(plan, np.int64).reshape(-1, len(names)).T
    table = spark.createDataFrame(pa.table([pa.array(c) for c in columns], names), PLAN)
    if len(plan) <= PLAN_ROWS:
        table = F.broadcast(table)
    here = (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    nth = F.col("_rank") - F.col("lo")
    return ranked.join(table, here).select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack_vectors(
    df: DataFrame,
    vocabulary: str,
    seq_len: int = 2048,
    documents: int | None = None,
    attention: int | None = None,
    score: str = "norm",
    end_id: int = 0,
) -> DataFrame:
    """Pack all of ``df`` (doc_id, text) under the capacities; one row for each piece.

    Without ``documents`` and ``attention`` the tightest capacities are taken with
    which the number of sequences is still that of ids alone (``tightest``), so that
    sequences hold alike many documents. A given attention capacity must leave
    room for one full piece.
    """
    pieces = settle(token_pieces(df, vocabulary, seq_len, end_id), "pieces")
    rows = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # seq_len rows at most
    histogram = {r["length"]: r["n"] for r in rows}
    if documents or attention:
        plan = plan_bins(histogram, seq_len, documents, attention, score)
    else:
        *_, plan = tightest(histogram, seq_len, score)
    return assign(pieces, plan)
