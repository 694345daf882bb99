"""Operator 9: benchmark decontamination with a BM25 index of test items and block-max WAND.

The index is built from the test items; every passage of every training
document is a query. A term's impact in an item is its BM25 weight divided by
the item's weight against itself, so a score says what part of an item a
passage covers, and one threshold serves all items. Block-max WAND walks the
posting lists of a passage's terms: a pivot is found from the terms' greatest
impacts, refined by the greatest impacts of the blocks it falls in, and only
then scored. Retrieved pairs are verified by the overlap of word n-grams with
the item's question and with its answer (its last sentence): both reach OVERLAP,
or the item as a whole does and each of the two at least PARTIAL.

Words are runs of letters and digits; A to Z and the accented capitals of
Latin-1 count as small letters, so case and punctuation do not hide a copy.
Items are dealt by length into bands (up to 16 words, 32, 64 and so on), each with
an index of its own. A text is cut into blocks of the band's greatest length, and
each two blocks in a row are a passage, so each copy lies whole in one of them and
a long item does not widen the passages of short ones. A passage is walked only if
its words can reach the threshold for some item; that bound is exact (see ``Index``).

Test items are stated queries: they are taken in blocks of ITEM_BLOCK, each
against all documents, so the corpus is read once for each ITEM_BLOCK of items.
Only such a block is on the driver or broadcast. What BM25 needs to know of all
items (``Benchmark``) is counted before, so that a pair's score does not depend on
the block.

Cases: null or empty texts match nothing, on either side; an item without a
word matches nothing; items of fewer words than N are matched as one whole run;
repeated documents each get their rows; repeated items each match; empty tables
give an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import pick, small_batches, trimmed
from rillwork.llm.words import Words, gather, split_loose, windows

K1, B = 1.2, 0.75
#: Part of an item's BM25 weight that a passage must cover.
THRESHOLD = 0.6
#: Words of an n-gram, and the part of n-grams that must be there.
N, OVERLAP = 5, 0.8
#: Part of the n-grams of question and of answer that must be there even if the whole item's reach OVERLAP.
PARTIAL = 0.5
#: Words of the items of the first band.
BAND = 16
ITEM_BLOCK = 20_000
#: Items of one block of a posting list.
POSTING_BLOCK = 16
MATCHES = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; a single sentence is question and answer."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def grams(words: Words, i: int) -> np.ndarray:
    """Hashes of the n-grams of text ``i``; of one whole run if it has fewer words."""
    own = words.hashes[words.first[i] : words.first[i + 1]]
    if not len(own):
        return own
    k = min(N, len(own))
    return np.unique(windows(own, np.array([0, len(own)]), k)[0])


@dataclass
class Benchmark:
    """Of all test items: how many, their mean and greatest length in words, and how many hold each of the terms given."""

    items: int
    mean: float
    longest: int
    holding: Callable[[np.ndarray], np.ndarray]


def counted(rows: DataFrame) -> Benchmark:
    """``Benchmark`` of ``rows`` (item_id, text); a call of ``holding`` is a job that counts these terms only."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = words = longest = 0
        for batch in batches:
            own = np.diff(split_loose(batch.column("text")).first)
            items, words, longest = items + len(own), words + int(own.sum()), int(own.max(initial=longest))
        yield pa.RecordBatch.from_pydict({"items": [items], "words": [words], "longest": [longest]})

    def holding(terms: np.ndarray) -> np.ndarray:
        held = rows.sparkSession.sparkContext.broadcast(terms)  # of a block of items

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = held.value
            n = np.zeros(len(terms), np.int64)
            for batch in batches:
                words = split_loose(batch.column("text"))
                item = np.repeat(np.arange(len(batch)), np.diff(words.first))
                at = np.minimum(np.searchsorted(terms, words.hashes), len(terms) - 1)
                known = terms[at] == words.hashes
                once = np.unique(at[known] * len(batch) + item[known])
                n += np.bincount(once // len(batch), minlength=len(terms))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["term", "n"])

        out = np.zeros(len(terms), np.int64)
        if len(terms):
            sums = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
            out[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
        held.destroy()
        return out

    total = rows.mapInArrow(lengths, "items long, words long, longest long").agg(
        F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest")
    )
    items, words, longest = (x or 0 for x in total.first())
    return Benchmark(items, words / max(items, 1), longest, holding)


def counted_here(items: list[tuple[int, str]]) -> Benchmark:
    """``Benchmark`` of items that are all there are."""
    words = split_loose(pa.array([t for _, t in items], pa.string()))
    lengths = np.diff(words.first)
    terms, term = np.unique(words.hashes, return_inverse=True)
    pairs = np.unique(term * max(len(items), 1) + np.repeat(np.arange(len(items)), lengths))
    n = np.bincount(pairs // max(len(items), 1), minlength=len(terms))
    return Benchmark(len(items), float(lengths.sum()) / max(len(items), 1), int(lengths.max(initial=0)), lambda some: n[np.searchsorted(terms, some)])


class Index:
    """Posting lists of the items' terms: items in order, impacts, and the greatest impact of each block.

    ``key_items`` and ``key_impacts``: postings of each item's heaviest terms, taken
    until the others cover half the threshold at most. A passage that reaches the
    threshold for an item has ``need`` of it from these terms alone.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float, whole: Benchmark | None = None, span: int = 0):
        """``whole``: counts over all items, if ``items`` are not all; ``span``: words of a block, the longest item's if 0."""
        whole = whole or counted_here(items)
        self.ids = [i for i, _ in items]
        self.threshold = threshold
        words = split_loose(pa.array([t for _, t in items], pa.string()))
        parts = [question_and_answer(t) for _, t in items]
        ask, tell = (split_loose(pa.array([p[k] for p in parts], pa.string())) for k in (0, 1))
        self.whole = [grams(words, i) for i in range(len(items))]
        self.short = [int(words.first[i + 1] - words.first[i]) for i in range(len(items))]
        self.question = [grams(ask, i) for i in range(len(items))]
        self.answer = [grams(tell, i) for i in range(len(items))]
        self.question_n = [min(N, int(ask.first[i + 1] - ask.first[i])) for i in range(len(items))]
        self.answer_n = [min(N, int(tell.first[i + 1] - tell.first[i])) for i in range(len(items))]
        self.terms, term = np.unique(words.hashes, return_inverse=True)
        lengths = np.diff(words.first)
        self.span = span or int(lengths.max(initial=1))
        item = np.repeat(np.arange(len(items)), lengths)
        pairs, tf = np.unique(term * max(len(items), 1) + item, return_counts=True)
        term, item = pairs // max(len(items), 1), pairs % max(len(items), 1)
        df = whole.holding(self.terms)
        idf = np.log(1 + (whole.items - df + 0.5) / (df + 0.5))
        mean = max(whole.mean, 1e-9)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
        impact = weight / np.bincount(item, weight, minlength=len(items))[item]
        cuts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        spans = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
        blocks = [list(range(a, b, POSTING_BLOCK)) for a, b in spans]
        #: of each term: items, impacts, greatest impact of each block, last item of each block, greatest of all
        self.lists = [
            (
                item[a:b].tolist(),
                impact[a:b].tolist(),
                [float(impact[k : min(k + POSTING_BLOCK, b)].max()) for k in starts],
                [int(item[min(k + POSTING_BLOCK, b) - 1]) for k in starts],
                float(impact[a:b].max()),
            )
            for (a, b), starts in zip(spans, blocks, strict=True)
        ]
        order = np.lexsort((-impact, item))
        run = np.concatenate([[0.0], np.cumsum(impact[order])])
        before = run[:-1] - run[np.searchsorted(item[order], item[order])] if len(order) else run[:-1]
        key = np.zeros(len(term), dtype=bool)
        key[order[1 - before > threshold / 2]] = True
        self.key_items, self.key_impacts = item[key], impact[key]
        self.key_offsets = np.searchsorted(term[key], np.arange(len(self.terms) + 1))
        self.need = threshold - 1 + np.bincount(self.key_items, self.key_impacts, minlength=len(items)) - 1e-9

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items that the distinct ``terms`` cover to the threshold: block-max WAND."""
        goal = self.threshold - 1e-9
        lists = [self.lists[t] for t in terms]
        place = [0] * len(lists)
        live = sorted(range(len(lists)), key=lambda k: lists[k][0][0])
        found = []
        while live:
            bound, pivot = 0.0, -1
            for j, k in enumerate(live):
                bound += lists[k][4]
                if bound >= goal:
                    pivot = j
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][0][place[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][place[live[pivot + 1]]] == item:
                pivot += 1
            lead = live[: pivot + 1]
            # the blocks that hold the pivot, found without moving
            at = [bisect_left(lists[k][3], item) for k in lead]
            held = sum(lists[k][2][b] for k, b in zip(lead, at, strict=True) if b < len(lists[k][2]))
            if held >= goal:
                score = 0.0
                for k in lead:
                    place[k] = bisect_left(lists[k][0], item, place[k])
                    if place[k] < len(lists[k][0]) and lists[k][0][place[k]] == item:
                        score += lists[k][1][place[k]]
                        place[k] += 1
                if score >= goal:
                    found.append((item, score))
            else:
                # nothing before the nearest block end can reach the goal
                ends = [lists[k][3][b] for k, b in zip(lead, at, strict=True) if b < len(lists[k][3])]
                beyond = min(ends) + 1 if ends else item + 1
                if pivot + 1 < len(live):
                    beyond = min(beyond, lists[live[pivot + 1]][0][place[live[pivot + 1]]])
                beyond = max(beyond, item + 1)
                for k in lead:
                    place[k] = bisect_left(lists[k][0], beyond, place[k])
            live = sorted((k for k in live if place[k] < len(lists[k][0])), key=lambda k: lists[k][0][place[k]])
        return found


class Bands:
    """A block of items, dealt into bands by length, and the terms of all of them."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, whole: Benchmark | None = None):
        whole = whole or counted_here(items)
        words = split_loose(pa.array([t for _, t in items], pa.string()))
        lengths = np.diff(words.first)
        self.terms = np.unique(words.hashes)
        n = whole.holding(self.terms)
        same = Benchmark(whole.items, whole.mean, whole.longest, lambda some: n[np.searchsorted(self.terms, some)])
        bound = np.maximum(BAND, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        #: of each band its index and the number there of each of ``terms``, -1 for terms of other bands
        self.bands: list[tuple[Index, np.ndarray]] = []
        for span in np.unique(bound[lengths > 0]).tolist():
            own = [items[k] for k in np.flatnonzero((bound == span) & (lengths > 0)).tolist()]
            index = Index(own, threshold, same, span)
            number = np.full(len(self.terms) + 1, -1)  # the last is that of words of no item
            number[np.searchsorted(self.terms, index.terms)] = np.arange(len(index.terms))
            self.bands.append((index, number))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``terms``, the one behind them all for words of no item."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, len(self.terms))


def passages_to_walk(index: Index, words: Words, term: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first word, end) of each passage whose key terms reach the need of some item."""
    span = index.span
    n = np.diff(words.first)
    base = np.concatenate([[0], np.cumsum(-(-n // span))])
    hits = np.flatnonzero((term >= 0) & (np.diff(index.key_offsets)[term] > 0))
    text = np.searchsorted(words.first, hits, "right") - 1
    block = base[text] + (hits - words.first[text]) // span
    many = np.diff(index.key_offsets)[term[hits]]
    at = gather(index.key_offsets[:-1][term[hits]], many)
    keys, back = np.unique(np.repeat(block, many) * len(index.ids) + index.key_items[at], return_inverse=True)
    mass = np.bincount(back, index.key_impacts[at], minlength=len(keys))
    # what a block and the one behind it hold of an item
    behind = np.searchsorted(keys, keys + len(index.ids))
    behind = np.where(behind < len(keys), behind, 0)
    both = mass + np.where(keys[behind] == keys + len(index.ids), mass[behind], 0.0)
    need = index.need[keys % len(index.ids)]
    alone = keys[mass >= need] // len(index.ids)
    blocks = np.unique(np.concatenate([keys[both >= need] // len(index.ids), alone, alone - 1]))
    out = []
    for b in blocks[blocks >= 0].tolist():
        i = int(np.searchsorted(base, b, "right")) - 1
        start = int(words.first[i]) + (b - int(base[i])) * span
        out.append((i, start, min(start + 2 * span, int(words.first[i + 1]))))
    return out


def matches_of(block: Bands, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of all verified pairs."""
    if not block.bands:
        return []
    words = split_loose(texts)
    at = block.lookup(words.hashes)
    out, seen = [], {}

    def part(wanted: np.ndarray, k: int, i: int) -> float:
        if (i, k) not in seen:
            if len(seen) > 64:
                seen.clear()
            own = words.hashes[words.first[i] : words.first[i + 1]]
            seen[i, k] = np.unique(windows(own, np.array([0, len(own)]), k)[0])
        return float(np.isin(wanted, seen[i, k]).mean()) if len(wanted) else 0.0

    for index, number in block.bands:
        term = number[at]
        best: dict[tuple[int, int], float] = {}
        for i, start, end in passages_to_walk(index, words, term):
            own = np.unique(term[start:end])
            for item, score in index.search(own[own >= 0].tolist()):
                best[i, item] = max(best.get((i, item), 0.0), score)
        for (i, item), score in sorted(best.items()):
            asked = part(index.question[item], index.question_n[item], i)
            told = part(index.answer[item], index.answer_n[item], i)
            least = min(asked, told)
            if least >= OVERLAP or (least >= PARTIAL and part(index.whole[item], min(N, index.short[item]), i) >= OVERLAP):
                out.append((i, index.ids[item], min(score, 1.0), asked, told))
    return out


def item_rows(benchmark: DataFrame) -> DataFrame:
    own = pick(benchmark, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long"))
    return own.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())


def item_blocks(benchmark: DataFrame, size: int = ITEM_BLOCK) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    for r in item_rows(benchmark).orderBy("item_id", "text").toLocalIterator():  # a block of stated queries at a time
        block.append((r[0], r[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = ITEM_BLOCK) -> DataFrame:
    """One row for each verified pair of a document of ``docs`` (doc_id, text) and an item."""
    spark = docs.sparkSession
    small_batches(spark)
    own = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = None
    whole = counted(item_rows(benchmark))
    for items in item_blocks(benchmark, block):
        one = len(items) == whole.items  # then the block knows all
        index = spark.sparkContext.broadcast(Bands(items, threshold, None if one else whole))  # a block of items

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in trimmed(batches):
                rows = matches_of(index.value, batch.column("text"))
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [batch.column("doc_id").take(at), pa.array([r[1] for r in rows], pa.int64())]
                columns += [pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in MATCHES.split(", ")])

        found = own.mapInArrow(find, MATCHES)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], MATCHES) if out is None else out
