"""Operator 6: language identification by sparse logistic regression on TF-IDF character n-grams.

Texts are lower-cased, all but letters become one space, and runs of one to
three characters are hashed to features. A multinomial logistic regression is
trained by follow-the-regularised-leader with elastic-net penalties, a document
at a time, and a temperature fitted on documents kept out of the training turns
its scores into probabilities. The model is fitted on the driver from a sample
of labelled rows, at most ``per_language`` different texts of each of the LANGUAGES
most frequent languages, with document frequencies of all labelled rows; it is
applied to the whole of every text. Only the text goes to Python for that.

Cases: a null text, or one without a letter, is ``und`` with score 0; equal
texts get equal results; long texts count whole; an empty table, or one without
a labelled row, gives ``und`` for every row; other columns are kept as they are,
whatever their names, but for those called like the results, which they replace.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.common import numbered, pick, place_of, small_batches, trimmed

BITS = 13
#: Labelled rows of one language that the model is fitted on at most, and how many languages: the bound of the sample.
PER_LANGUAGE, LANGUAGES = 800, 256
UNKNOWN = "und"
_NO_LETTERS = regex.compile(r"[^\p{L}]+")
_STEPS = np.random.Generator(np.random.PCG64(6)).integers(0, 2**64, 3, dtype=np.uint64) | np.uint64(1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the counts of its n-grams: row, feature and count, by row."""
    clean = [_NO_LETTERS.sub(" ", (t or "").lower()).strip() for t in texts]
    clean = [f" {t} " if t else "" for t in clean]
    lengths = np.fromiter(map(len, clean), np.int64, len(clean))
    chars = np.frombuffer("".join(clean).encode("utf-32-le"), "<u4").astype(np.uint64)
    text_of = np.repeat(np.arange(len(clean)), lengths)
    codes = []
    h = np.zeros(len(chars), np.uint64)
    for k in range(3):
        h = h[: len(chars) - k] + chars[k:] * _STEPS[k] if len(chars) > k else h[:0]
        row = text_of[: len(h)]
        whole = text_of[k:] == row
        g = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        codes.append(((row << BITS) + (g ^ np.uint64(k * 977)).astype(np.int64))[whole])
    counts = np.bincount(np.concatenate(codes), minlength=len(clean) << BITS)
    at = np.flatnonzero(counts)
    return at >> BITS, at & ((1 << BITS) - 1), counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vectors(self, row: np.ndarray, feature: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """TF-IDF values, of length 1 for each text."""
        value = (1 + np.log(count)) * self.idf[feature]
        norm = np.sqrt(np.bincount(row, value * value, minlength=n))
        return value / np.maximum(norm[row], 1e-12)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each text, and whether it has a letter."""
        row, feature, count = features(texts)
        n = len(texts)
        value = self.vectors(row, feature, count, n)
        logits = np.stack(
            [np.bincount(row, value * w[feature], minlength=n) for w in self.weights.T], axis=1
        )
        return softmax(logits / self.temperature), np.bincount(row, minlength=n) > 0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def inverse_frequency(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def frequencies(df: DataFrame) -> tuple[int, np.ndarray]:
    """Texts of ``df`` that have a letter, and of each feature the texts that hold it; a row a feature on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 << BITS) + 1, np.int64)  # the last is that of texts
        for batch in trimmed(batches):
            row, feature, _ = features(batch.column("text").to_pylist())
            n[:-1] += np.bincount(feature, minlength=1 << BITS)
            n[-1] += len(np.unique(row))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["feature", "n"])

    small_batches(df.sparkSession)
    sums = df.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n = np.zeros((1 << BITS) + 1, np.int64)
    for r in sums:
        n[r["feature"]] = r["n"]
    return int(n[-1]), n[:-1]


def fit(
    samples: list[tuple[np.ndarray, np.ndarray]],
    labels: list[str],
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 2e-4,
    l2: float = 1e-4,
    passes: int = 3,
    idf: np.ndarray | None = None,
) -> Model:
    """FTRL-proximal over (features, counts) of each sample; every fifth sample calibrates.

    ``idf``: of each feature; that of the samples if none is given.
    """
    languages = sorted(set(labels))
    target = {name: k for k, name in enumerate(languages)}
    if idf is None:
        df = np.zeros(1 << BITS)
        for feature, _ in samples:
            df[feature] += 1
        idf = inverse_frequency(len(samples), df)
    model = Model(languages, idf, np.zeros((1 << BITS, len(languages))), 1.0)
    xs = [(f, model.vectors(np.zeros(len(f), np.int64), f, c, 1)) for f, c in samples]
    ys = [target[name] for name in labels]
    train = [i for i in range(len(xs)) if i % 5] or list(range(len(xs)))
    keep = [i for i in range(len(xs)) if i % 5 == 0]
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(
            np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        )

    for _ in range(passes):
        for i in train:
            feature, value = xs[i]
            w = weights(z[feature], n[feature])
            error = softmax(value @ w)
            error[ys[i]] -= 1
            g = value[:, None] * error
            sigma = (np.sqrt(n[feature] + g * g) - np.sqrt(n[feature])) / alpha
            z[feature] += g - sigma * w
            n[feature] += g * g
    model.weights = weights(z, n)
    if keep:
        logits = np.stack([xs[i][1] @ model.weights[xs[i][0]] for i in keep])
        truth = np.array([ys[i] for i in keep])
        loss = {
            t: -np.log(softmax(logits / t)[np.arange(len(keep)), truth] + 1e-12).mean()
            for t in np.geomspace(0.02, 5, 60).tolist()
        }
        model.temperature = min(loss, key=loss.get)
    return model


def train(df: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit a model from the labelled rows of ``df`` (doc_id, text, lang) that are not held out.

    A language with more texts than ``per_language`` gives those whose hash is
    small, so the sample is the same each time; rows with one text count once.
    """
    small_batches(df.sparkSession)
    own = pick(df, "doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * per_language / r["n"]))])
    point = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature, count = features(batch.column("text").to_pylist())
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            spans = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": batch.column("doc_id"),
                    "lang": batch.column("lang"),
                    "f": pa.array([feature[s].astype("<u2").tobytes() for s in spans], pa.binary()),
                    "c": pa.array([count[s].astype("<u4").tobytes() for s in spans], pa.binary()),
                }
            )

    some = own.withColumn("hash", F.xxhash64("text")).filter(point < share[F.col("lang")])
    some = some.groupBy("lang", "hash").agg(F.min(F.col("doc_id").cast("long")).alias("doc_id"), F.first("text").alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))  # of twice per_language texts, about
    sample = some.withColumn("rank", order).filter(F.col("rank") <= per_language).select("doc_id", "text", "lang")
    rows = sample.mapInArrow(counted, "key long, lang string, f binary, c binary").collect()  # bounded by per_language
    rows = sorted((r for r in rows if r["f"]), key=lambda r: (zlib.crc32(str(r["key"]).encode()), r["key"]))
    if not rows:
        return None
    return fit(
        [(np.frombuffer(r["f"], "<u2").astype(np.int64), np.frombuffer(r["c"], "<u4")) for r in rows],
        [r["lang"] for r in rows],
        idf=inverse_frequency(*frequencies(own)),
    )


def identify(
    df: DataFrame, model: Model | None, into: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``df`` (text and more) with the language and the score in the columns ``into``."""
    small_batches(df.sparkSession)

    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in trimmed(batches):
            texts = batch.to_pylist()
            if model is None:
                name, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            else:
                odds, letters = model.scores(texts)
                best = odds.argmax(axis=1)
                name = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                score = np.where(letters, odds.max(axis=1), 0.0)
            columns = [pa.array(name, pa.string()), pa.array(score, pa.float64())]
            yield pa.StructArray.from_arrays(columns, ["lang", "score"])

    names = df.columns
    kept = [k for k, name in enumerate(names) if name not in into]
    columns = [F.col(f"c{k}") for k in kept]
    found = numbered(df).select(*columns, predict(F.col(f"c{place_of(df, 'text')}").cast("string")).alias("found"))
    return found.select(*columns, "found.lang", "found.score").toDF(*[names[k] for k in kept], *into)
