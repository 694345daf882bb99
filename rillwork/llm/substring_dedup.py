"""Operator 10: repeated passages of words, by super-k-mers dealt by their minimisers.

A window is WINDOW consecutive words; its minimiser is the least hash among its
runs of SHORT words. Consecutive windows with one minimiser form a super-k-mer.
Equal windows have equal minimisers, so a window can only repeat where its
minimiser does:

1. every document gives its super-k-mers as (minimiser, place, length); those
   whose minimiser stands at one place only, in all data, are done with. No text
   has moved so far;
2. each of the others travels to its minimiser's bucket as one packed string.
   Equal strings are counted together on the way, so copies stay one row;
3. a bucket sorts the windows of its strings and counts them exactly. A
   minimiser with more strings than a task should hold is dealt by windows
   instead of by minimiser, with the same counts;
4. the places of repeated windows go back to their documents, which drop every
   word that such a window covers.

The plan is the same at all sizes: which documents' texts must move is asked of a
Bloom filter of fixed size, with exact joins behind it. What is counted under a
key is staged before it is joined, so that both sides of every join are plain
exchanges and a task that would hold a hot minimiser, window or string is split at
run time.

Windows are compared by two hashes of 64 bits, each from its own hash of every
word, so neither rests on the other. Windows are judged on the input as it is.

Cases: a null or empty text has no words and the hash of nothing; texts under
WINDOW words lose none; rows that repeat count as documents of their own; a null
doc_id is an id like any other; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import may_hold, pick, scratch, settle, shuffle_partitions, small_batches
from rillwork.llm.words import Words, gather, split_words, string_bytes, windows

WINDOW = 35
SHORT = 8
#: Distinct strings of one minimiser that one bucket sorts.
BUCKET_STRINGS = 2_000

PLACES = "doc_id long, th long, n_words long, sha binary, mins array<long>, firsts array<int>, counts array<int>, marks array<int>"
PACKED = "doc_id long, th long, first int, m long, p1 long, p2 long, packed binary"
REPEATED = "p1 long, p2 long, at array<int>"


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """The least of each ``k`` values in a row, by doubling."""
    out, span = h, 1
    while span * 2 <= k:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    return np.minimum(out[: len(h) - k + 1], out[k - span :]) if len(h) >= k else h[:0]


def super_kmers(words: Words, window: int, short: int) -> tuple[np.ndarray, ...]:
    """Of each super-k-mer: text, first window in it, windows, minimiser, and places of the minimiser."""
    n = np.diff(words.first)
    shorts, _, begin = windows(words.hashes, words.first, short)
    span = window - short + 1
    least = sliding_min(shorts, span)
    count = np.maximum(n - window + 1, 0)
    at = gather(begin[:-1], count)
    text = np.repeat(np.arange(len(n)), count)
    place = at - begin[:-1][text]
    value = least[at]
    if not len(at):
        return text, place, place, value, place
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    own = shorts[gather(at[first], length + span - 1)]
    cuts = np.concatenate([[0], np.cumsum(length + span - 1)])[:-1]
    marks = np.add.reduceat((own == np.repeat(value[first], length + span - 1)).astype(np.int64), cuts)
    return text[first], place[first], length, value[first], marks


def squeezed(raw: bytes) -> bytes:
    """Words joined by one space: bytes.split cuts at the six white-space bytes."""
    return b" ".join(raw.split())


def places(df: DataFrame, window: int, short: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column("text"))
            text, first, count, least, marks = super_kmers(words, window, short)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            data, offsets = string_bytes(batch.column("text"))
            raw = data.tobytes()
            at = offsets.tolist()
            sha = [hashlib.sha256(squeezed(raw[a:b])).digest() for a, b in zip(at, at[1:], strict=False)]
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(np.diff(words.first)), pa.array(sha, pa.binary())]
            columns.append(pa.ListArray.from_arrays(cuts, pa.array(least.view(np.int64))))
            columns += [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (first, count, marks)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PLACES.split(", ")])

    return df.mapInArrow(find, PLACES)


def pack(affected: DataFrame, window: int) -> DataFrame:
    """Each noted super-k-mer of ``affected`` (doc_id, th, text, refs) as one string of words."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, th, text, refs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().split()
                for first, count, m in {(r["first"], r["count"], r["m"]) for r in refs}:
                    packed = b" ".join(words[first : first + count + window - 1])
                    p = np.frombuffer(hashlib.blake2b(packed, digest_size=16).digest(), "<i8")
                    out.append((doc_id, th, first, m, int(p[0]), int(p[1]), packed))
                if len(out) > 20_000:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PACKED.split(", ")])

    return affected.select("doc_id", "th", "text", "refs").mapInArrow(strings, PACKED)


def window_hashes(packed: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window of each string, and where each string's windows begin."""
    words = split_words(packed.cast(pa.string()), second=True)
    one, _, begin = windows(words.hashes, words.first, window)
    two, _, _ = windows(words.second, words.first, window)
    return one, two, begin


def lists(cuts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(values.astype(np.int32)))


def sort_buckets(strings: DataFrame, window: int) -> DataFrame:
    """Repeated windows of distinct strings (m, p1, p2, packed, c), all of a minimiser in one bucket."""

    def of(whole: pa.Table) -> pa.RecordBatch:
        one, two, begin = window_hashes(whole.column("packed").combine_chunks(), window)
        length = np.diff(begin)
        weight = np.repeat(whole.column("c").to_numpy(), length)
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        group = np.cumsum(new) - 1
        total = np.bincount(group, weight[order])
        repeated = np.zeros(len(one), dtype=bool)
        repeated[order] = total[group] > 1
        hits = np.flatnonzero(repeated)
        string = np.searchsorted(begin, hits, "right") - 1
        cuts = np.searchsorted(string, np.arange(len(length) + 1))
        table = [whole.column(k).combine_chunks() for k in ("p1", "p2")]
        return pa.RecordBatch.from_arrays([*table, lists(cuts, hits - begin[string])], ["p1", "p2", "at"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, key = 0, None
        for batch in batches:
            m = batch.column("m").to_numpy()
            if not len(m):
                continue
            # whole minimisers are sorted together, some thousand strings at a time
            cuts = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if n > 4 * BUCKET_STRINGS and m[a] != key:
                    yield of(pa.Table.from_batches(held))
                    held, n = [], 0
                key = m[a]
                held.append(batch.slice(a, b - a))
                n += b - a
        if held:
            yield of(pa.Table.from_batches(held))

    dealt = strings.repartition(shuffle_partitions(strings.sparkSession), "m").sortWithinPartitions("m")
    return dealt.select("m", "p1", "p2", "packed", "c").mapInArrow(walk, REPEATED)


def count_windows(strings: DataFrame, window: int) -> DataFrame:
    """The same for minimisers with many strings: windows are dealt one by one."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, begin = window_hashes(batch.column("packed"), window)
            length = np.diff(begin)
            at = np.arange(len(one)) - np.repeat(begin[:-1], length)
            string = pa.array(np.repeat(np.arange(len(length)), length))
            columns = [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(at.astype(np.int32))]
            columns += [batch.column(k).take(string) for k in ("p1", "p2", "c")]
            yield pa.RecordBatch.from_arrays(columns, ["w1", "w2", "j", "p1", "p2", "c"])

    rows = strings.select("p1", "p2", "packed", "c").mapInArrow(explode, "w1 long, w2 long, j int, p1 long, p2 long, c long")
    rows = settle(rows, "windows")
    more = settle(rows.groupBy("w1", "w2").agg(F.sum("c").alias("n")).filter("n > 1").select("w1", "w2"), "more")
    hits = rows.join(more, ["w1", "w2"], "left_semi")
    return hits.groupBy("p1", "p2").agg(F.collect_list("j").alias("at"))  # windows of one string


def drop_words(affected: DataFrame, window: int) -> DataFrame:
    """What is left of each of ``affected`` (doc_id, th, text, hits) without the words under repeated windows."""
    schema = "doc_id long, th long, n_removed long, kept binary"

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha = [], []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.concatenate([h["first"] + np.array(h["at"], np.int64) for h in hits]))
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                covered = np.cumsum(change[:-1]) > 0
                removed.append(int(covered.sum()))
                sha.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~covered)])).digest())
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(sha, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_removed", "kept"])

    return affected.select("doc_id", "th", "text", "hits").mapInArrow(drop, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, short: int = SHORT, bucket: int = BUCKET_STRINGS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession, "repeats") as result:
        return result(_repeats(pick(docs, "doc_id", "text"), window, short, bucket))


def _repeats(docs: DataFrame, window: int, short: int, bucket: int) -> DataFrame:
    nowhere = -(1 << 63)
    df = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(nowhere)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("th", F.xxhash64("text"))
    key = ["doc_id", "th"]
    own = settle(places(df, window, short), "super-k-mers")
    zipped = F.explode(F.arrays_zip("mins", "firsts", "counts", "marks")).alias("s")
    each = own.select(*key, zipped).select(
        *key, F.col("s.mins").alias("m"), F.col("s.firsts").alias("first"), F.col("s.counts").alias("count"), F.col("s.marks").alias("marks")
    )
    shared = settle(each.groupBy("m").agg(F.sum("marks").alias("n")).filter("n > 1").select("m"), "shared")
    noted = each.join(shared, "m", "left_semi")
    refs = settle(noted.groupBy(*key).agg(F.collect_list(F.struct("first", "count", "m")).alias("refs")), "noted")

    packed = settle(pack(texts_of(df, refs, key), window), "packed")
    strings = packed.groupBy("p1", "p2").agg(F.first("m").alias("m"), F.first("packed").alias("packed"), F.count("*").alias("c"))
    strings = settle(strings, "strings")
    large = settle(strings.groupBy("m").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("m"), "large")
    repeated = sort_buckets(strings.join(large, "m", "left_anti"), window)
    repeated = repeated.unionByName(count_windows(strings.join(large, "m", "left_semi"), window))
    repeated = settle(repeated.filter(F.size("at") > 0), "repeated")
    back = packed.select(*key, "first", "p1", "p2").join(repeated, ["p1", "p2"])
    hits = back.groupBy(*key).agg(F.collect_list(F.struct("first", "at")).alias("hits"))  # windows of one document
    left = drop_words(texts_of(df, settle(hits, "hits"), key), window).dropDuplicates(key)
    return own.select(*key, "n_words", "sha").join(left, key, "left").select(
        F.when(F.col("doc_id") != nowhere, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256"),
    )


def texts_of(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` (key and more) with the texts of their documents; of other documents hardly any text moves."""
    some = may_hold(rows.select(F.xxhash64(*key)))
    return df.filter(some(F.xxhash64(*key))).join(rows, key)
