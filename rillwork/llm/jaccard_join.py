"""Operator 4: exact n-gram Jaccard join, with size-banded tiles, bitmap signatures and sorted-array intersection.

A document's set holds the hashes of its distinct five-word shingles. Two
documents of similarity t or more share one of their first n - ceil(t n) + 1
shingles in any order that is the same for all; the order here puts shingles
last that many documents have, by counters over all data. The join goes:

1. equal sets are put together by their digests;
2. documents meet under each shingle of their prefixes; of those under one
   shingle, each is compared with the one whose prefix is the most common by the
   counters, and verified links are joined to components. In a group of near
   copies that is the one with the fewest shingles of its own, which is near most
   others whatever the ids are, so such groups are settled without all their pairs;
3. under shingles where several components still meet, documents are laid out
   in tiles: a tile holds one band of set sizes and the next, and at most
   TILE rows of each side. Within a tile, pairs of different components are
   bounded by their bitmaps: bits in which two signatures differ count shingles
   that only one of them has, which bounds the overlap from above;
4. what the bound lets through is verified on the sorted hashes.

No pair of different components that meets in step 3 is left out, so the
components are those of all links. A hot shingle is split over many tiles. What
is counted under a key is staged before it is joined, so that both sides of every
join are plain exchanges: a task that would hold a hot key is split at run time.
A shingle under which n rows of one size band and of several components still
meet costs n * n / TILE copied rows of (id, size, bitmap).

The plan is the same at all sizes. Texts are never shuffled: whose sets are
needed is asked of a Bloom filter of fixed size, and the joins behind it are exact.

Cases: a null or empty text, or one without words, has an empty set and no link;
with fewer than five words the whole sequence is the one shingle; a row whose
doc_id is null has a null component; rows of one doc_id are one node; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import Mapped, among, key_filter, pick, scratch, settle, shuffle_partitions, small_batches, trimmed
from rillwork.llm.components import components
from rillwork.llm.words import mix, split_words, windows

#: Words of a shingle.
N = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Counters that say which shingles are common: a fixed 4 MB, whatever the data.
COUNTERS = 1 << 20
COUNTER_PARTS = 64
#: Rows of one side of a tile.
TILE = 512
SETS = "doc_id long, n long, d1 long, d2 long, prefix array<long>, bitmap binary, weight long"


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and where each text's begin."""
    words = split_words(texts, lower=True)
    n = np.diff(words.first)
    hashes, _, begin = windows(words.hashes, words.first, N)
    text_of = np.repeat(np.arange(len(n)), np.diff(begin))
    few = np.flatnonzero((n > 0) & (n < N))
    if len(few):
        whole = [mix(np.bitwise_xor.reduce(mix(words.hashes[words.first[i] : words.first[i + 1]] + np.arange(n[i]).astype(np.uint64))).reshape(1) + np.uint64(n[i]))[0] for i in few]
        hashes, text_of = np.concatenate([hashes, np.array(whole, np.uint64)]), np.concatenate([text_of, few])
        order = np.argsort(text_of, kind="stable")
        hashes, text_of = hashes[order], text_of[order]
    cuts = np.searchsorted(text_of, np.arange(len(n) + 1)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        hashes[a:b].sort()
    if len(hashes):
        first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])])
        hashes, text_of = hashes[first], text_of[first]
    return hashes, np.searchsorted(text_of, np.arange(len(n) + 1))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def bitmap(own: np.ndarray) -> bytes:
    """Parity of the set's hashes in a power of two of bits, two for a shingle or more, 64 to 16,384."""
    bits = min(max(64, 1 << (2 * len(own) - 1).bit_length()), 1 << 14)
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A bitmap of fewer bytes: bits whose places agree in the lower part are added without carry."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, size), axis=0)


def may_link(n1: int, n2: int, b1: bytes, b2: bytes) -> bool:
    if 100 * min(n1, n2) < PERCENT * max(n1, n2):
        return False
    size = min(len(b1), len(b2))
    apart = int(np.bitwise_count(folded(b1, size) ^ folded(b2, size)).sum())
    return links((n1 + n2 - apart) // 2, n1, n2)


def links(both: int, n1: int, n2: int) -> bool:
    return 100 * both >= PERCENT * (n1 + n2 - both)


def common_counters(df: DataFrame) -> np.ndarray:
    """How often shingles fall on each of COUNTERS counters, over all of ``df``."""
    part = COUNTERS // COUNTER_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in trimmed(batches):
            words = split_words(batch.column("text"), lower=True)
            hashes, _, _ = windows(words.hashes, words.first, N)
            total += np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        rows = total.astype("<u4").reshape(COUNTER_PARTS, part)
        packed = [zlib.compress(r.tobytes(), 1) for r in rows]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(COUNTER_PARTS), pa.int32()), "counts": packed})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own = np.frombuffer(zlib.decompress(r["counts"]), "<u4").astype(np.uint64)
                sums[r["part"]] = sums[r["part"]] + own if r["part"] in sums else own
        rows = [np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array(rows, pa.binary())})

    schema = "part int, counts binary"
    each = df.select("text").mapInArrow(count, schema).repartition(COUNTER_PARTS, "part").mapInArrow(add, schema)
    out = np.zeros((COUNTER_PARTS, part), np.int64)
    for r in each.collect():  # COUNTERS numbers, whatever the data
        out[r["part"]] += np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


def describe(df: DataFrame) -> Mapped:
    """Of each row its set's size and digest; for the first row of a set in a task also prefix, bitmap and weight.

    The weight is the sum of the counters of the prefix.
    """
    spark = df.sparkSession
    # COUNTERS numbers; shingles in the order of their counters: rare ones first, common ones last
    usual = spark.sparkContext.broadcast(np.minimum(common_counters(df), 2**32 - 1).astype(np.uint32))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in trimmed(batches):
            hashes, begin = shingle_sets(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            often = usual.value[(hashes >> np.uint64(44)).astype(np.int64)]
            second = mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))
            out: dict[str, list] = {c.split()[0]: [] for c in SETS.split(", ")}
            for i, doc_id in enumerate(ids):
                own = hashes[begin[i] : begin[i + 1]]
                digest = int(own.sum(dtype=np.uint64)), int(second[begin[i] : begin[i + 1]].sum(dtype=np.uint64))
                prefix = bits = weight = None
                if len(own) and doc_id is not None and digest not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen.add(digest)
                    counts = often[begin[i] : begin[i + 1]]
                    rank = np.argsort(counts, kind="stable")[: prefix_length(len(own))]
                    prefix, weight = own[rank].view(np.int64), int(counts[rank].sum(dtype=np.int64))
                    bits = bitmap(own)
                for name, value in zip(out, (doc_id, len(own), *digest, prefix, bits, weight), strict=True):
                    out[name].append(value)
            columns = [pa.array(out["doc_id"], pa.int64()), pa.array(out["n"], pa.int64())]
            columns += [pa.array(np.array(out[k], np.uint64).view(np.int64)) for k in ("d1", "d2")]
            columns += [pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["bitmap"], pa.binary())]
            columns.append(pa.array(out["weight"], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, list(out))

    return Mapped(df, sets, SETS)


def sorted_sets(df: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, hashes) of the rows of ``df`` whose id is in ``ids`` (doc_id), and of a few more; no text is shuffled."""
    held = key_filter(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            batch = batch.filter(among(held.value, batch.column("doc_id")))
            if not batch.num_rows:
                continue
            hashes, begin = shingle_sets(batch.column("text"))
            raw = [hashes[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "hashes"])

    return df.mapInArrow(sets, "doc_id long, hashes binary")


def verified(df: DataFrame, pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: sizes and bitmaps first, then the intersection of the sorted hashes."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n1, n2, b1, b2 = (c.to_pylist() for c in batch.columns)
            keep = pa.array([may_link(*x) for x in zip(n1, n2, b1, b2, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    def intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(links(int((y[at] == x).sum()), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = info.select(F.col("doc_id").alias("a"), F.col("n").alias("n1"), F.col("bitmap").alias("b1"))
    two = info.select(F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("bitmap").alias("b2"))
    near = pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "b1", "b2")
    near = settle(Mapped(near, bounded, "a long, b long"), "near")
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = settle(sorted_sets(df, ids).distinct(), "sets")
    one, two = sets.toDF("a", "ha"), sets.toDF("b", "hb")
    return near.join(one, "a").join(two, "b").select("a", "b", "ha", "hb").mapInArrow(intersected, "a long, b long")


def tile_pairs(tiles: DataFrame) -> DataFrame:
    """Pairs within each tile of ``tiles`` that sizes, components and bitmaps let through."""

    def of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, comp, n = (rows.column(k).to_numpy() for k in ("node", "component", "n"))
        raw = rows.column("bitmap").to_pylist()
        size = min(map(len, raw))
        bits = np.unpackbits(np.stack([folded(b, size) for b in raw]), axis=1).astype(np.float32)
        ones = bits.sum(axis=1)
        found = []
        for low in range(0, len(node), TILE):
            part = slice(low, low + TILE)
            apart = ones[part, None] + ones[None] - 2 * (bits[part] @ bits.T)
            both = n[part, None] + n[None]
            small, large = np.minimum(n[part, None], n[None]), np.maximum(n[part, None], n[None])
            ok = (node[part, None] < node[None]) & (comp[part, None] != comp[None]) & (100 * small >= PERCENT * large)
            most = (both - apart) // 2
            ok &= 100 * most >= PERCENT * (both - most)
            i, j = np.nonzero(ok)
            found.append((node[i + low], node[j]))
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            a, b = of(whole)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        key = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("token", "band", "i", "j")], axis=1)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = tuple(keys[a].tolist())
                if held and own != key:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    spread = tiles.repartition(shuffle_partitions(tiles.sparkSession), "token", "band", "i", "j")
    return spread.sortWithinPartitions("token", "band", "i", "j").mapInArrow(walk, "a long, b long").distinct()


def lay_tiles(meets: DataFrame) -> DataFrame:
    """Rows (token, node, component, n, bitmap) under each tile that they belong to."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")
    banded = meets.withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    sizes = banded.groupBy("token", "band").agg(
        F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    chunks = F.greatest(F.lit(1), F.ceil(F.col("rows") / TILE)).cast("int")
    mixed = settle(sizes.filter("low < high").select("token", "band", chunks.alias("chunks")), "bands")
    tiled = banded.join(mixed, ["token", "band"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    return tiled.select("*", other).select(
        "token",
        "band",
        F.least("chunk", "other").alias("i"),
        F.greatest("chunk", "other").alias("j"),
        "node",
        "component",
        "n",
        "bitmap",
    )


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession, "jaccard", by_workers=True) as result:
        return result(_components(pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))))


def _components(df: DataFrame) -> DataFrame:
    own = settle(describe(df), "shingle-sets")
    digest = ["n", "d1", "d2"]
    slim = own.select("doc_id", *digest).filter("n > 0 and doc_id is not null")
    first = settle(slim.groupBy(*digest).agg(F.min("doc_id").alias("rep")), "first")
    member = settle(slim.join(first, digest).select("doc_id", "rep").distinct(), "members")
    # size and bitmap of each set, under the id that stands for it
    info = own.filter("prefix is not null").select(*digest, "bitmap").dropDuplicates(digest).join(first, digest)
    info = settle(info.select(F.col("rep").alias("doc_id"), "n", "bitmap"), "signatures")

    tokens = own.filter("prefix is not null").select("doc_id", "weight", F.explode("prefix").alias("token"))
    most = F.min(F.struct((-F.col("weight")).alias("w"), "doc_id"))["doc_id"]
    shared = tokens.groupBy("token").agg(most.alias("lo"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y")
    meets = settle(tokens.drop("weight").join(settle(shared.select("token", "lo"), "shared"), "token"), "meets")
    as_rep = member.toDF("doc_id", "node")
    stars = meets.select("lo", "doc_id").distinct().join(as_rep, "doc_id")
    stars = stars.join(member.toDF("lo", "hub"), "lo").filter("hub <> node")
    pairs = stars.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    joined = settle(components(verified(df, pairs, info)), "components")

    # the hub under each shingle has met all others there
    under = meets.join(as_rep, "doc_id").join(member.toDF("lo", "hub"), "lo").filter("hub <> node")
    under = under.select("token", "node").distinct()
    known = joined.select("node", "component")
    parts = settle(under.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "under")
    sizes = parts.groupBy("token").agg(
        F.count("*").alias("rows"), F.min("component").alias("x"), F.max("component").alias("y")
    )
    parts = settle(parts.join(settle(sizes.filter("x < y").select("token", "rows"), "sizes"), "token"), "mixed")
    # shingles under which the same few documents meet are one group
    few_nodes = parts.filter(F.col("rows") <= TILE).groupBy("token").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    groups = few_nodes.select("nodes").distinct().select(F.xxhash64("nodes").alias("token"), F.explode("nodes").alias("node"))
    groups = groups.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    many_nodes = parts.filter(F.col("rows") > TILE)
    under = many_nodes.select("token", "node", "component").unionByName(groups.select("token", "node", "component"))
    laid = lay_tiles(settle(under.join(info.withColumnRenamed("doc_id", "node"), "node"), "laid"))
    others = verified(df, tile_pairs(laid), info)
    # rows of one id are one node: its sets hang together
    several = settle(member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b"), "several")
    same = member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")
    spokes = known.filter("node <> component").toDF("a", "b")  # they hold together what the first links do
    joined = components(spokes.union(others).union(same)).toDF("rep", "component")

    known = member.join(joined, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    known = known.groupBy("doc_id").agg(F.min("component").alias("component"))
    return own.select("doc_id", "n").join(known, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
