"""Operator 1: token-id matrices packed best-fit-decreasing, block by block.

Each task turns its documents into ids, cuts overlong documents into pieces
without loss, and packs blocks of pieces: longest first, each into the open
row with the least room that still holds it, found in a segment tree over room.
A block holds a bounded number of ids, so memory is bounded and no id is
shuffled. What a block leaves open is closed with it: less than one row in a
thousand for a full block of the default size. A task that does not fill one
closes its open rows too, so many small partitions are packed less tightly.

Cases: a null or empty text is one piece that holds the end id only; equal
documents are packed each on its own; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rillwork.llm.common import fresh_path, pick, small_batches
from rillwork.llm.tokens import tokenizer
from rillwork.llm.words import gather

SCHEMA = (
    "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "resets array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"
)


class RoomTree:
    """A segment tree over room 0..capacity that counts the open rows with each room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of ``need`` or more."""
        count, k = self.count, need + self.size
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room, at = k - self.size, k
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices of ``lengths``; each row sums to ``capacity`` at most."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room, row = tree.take(lengths[i]) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        tree.put(room - lengths[i], row)
    return rows


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: its document's index, number, start and length."""
    n = np.maximum(-(-lengths // capacity), 1)
    doc = np.repeat(np.arange(len(lengths)), n)
    piece = gather(np.zeros(len(n), np.int64), n)
    return doc, piece, piece * capacity, np.minimum(lengths[doc] - piece * capacity, capacity)


def pack_tokens(
    df: DataFrame,
    vocabulary: str,
    seq_len: int = 2048,
    end_id: int = 0,
    block_tokens: int = 1 << 22,
) -> DataFrame:
    """One row for each packed sequence of ``df`` (doc_id, text).

    input_ids: ``seq_len`` little-endian unsigned ids, 16-bit if the vocabulary
    allows it, zeros behind n_tokens; cu_seqlens: ends of the segments, from 0;
    resets: the places in the row at which position ids start from 0 again, one for
    each segment; position_resets: the place in its document at which each goes on.
    """
    small_batches(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        task, made = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids = np.concatenate([h[0] for h in held])
            docs, piece, start, length = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4))
            at = np.concatenate([[0], np.cumsum(length)])
            held.clear()
            rows = best_fit_decreasing(length.tolist(), seq_len)
            for begin in range(0, len(rows), 256):
                out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
                for row in rows[begin : begin + 256]:
                    row_ids = ids[gather(at[row], length[row])]
                    line = np.zeros(seq_len, own.dtype)
                    line[: len(row_ids)] = row_ids
                    out["sequence_id"].append(task + made)
                    out["n_tokens"].append(len(row_ids))
                    out["input_ids"].append(line.tobytes())
                    out["cu_seqlens"].append(np.concatenate([[0], np.cumsum(length[row])]))
                    out["position_resets"].append(start[row])
                    out["resets"].append(out["cu_seqlens"][-1][:-1])
                    out["doc_ids"].append([docs[k] for k in row])
                    out["pieces"].append(piece[row])
                    out["starts"].append(start[row])
                    made += 1
                yield pa.RecordBatch.from_pydict(out, schema=ARROW)

        waiting = 0
        for batch in batches:
            ids, begin = own.ids(batch.column("text"), end_id)
            doc, piece, start, length = cut(np.diff(begin), seq_len)
            names = np.array([*batch.column("doc_id").to_pylist(), None], dtype=object)[:-1]
            held.append((ids, names[doc], piece, start, length))
            waiting += len(ids)
            if waiting >= block_tokens:
                yield from close()
                waiting = 0
        if held:
            yield from close()

    return pick(df, "doc_id", "text").mapInArrow(pack, SCHEMA)


ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("input_ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("pieces", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int64())),
    ]
)


def write_packed(packed: DataFrame, path: str | None = None) -> DataFrame:
    """Write packed rows as Parquet files in a folder all can reach, and return what the files hold."""
    spark = packed.sparkSession
    path = path or fresh_path(spark, "token-matrix")
    packed.write.parquet(path)
    return spark.read.schema(packed.schema).parquet(path)
