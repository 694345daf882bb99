"""Operator 3: secrets in texts, by fixed patterns and by sliding entropy, in DataFrame functions only.

Base kinds are found by their patterns. The method adds spans: candidate
strings of one character class are slid over with a window whose Shannon
entropy is kept up by counts, one character in and one out; a candidate with a
window above the class's threshold is a span unless the allow-list knows it.
A slash is in the class, so a candidate may be a path, a key, or a key behind a
path: parts at its ends that read as words are left out of the judgement.

Positions come from splitting: the pieces between matches and the matches
themselves, laid end to end, give every start. They count code points; ends are
exclusive.

Cases: a null or empty text has no spans; equal spans of several kinds are all
kept; an empty table gives an empty table; other columns are kept as they are,
whatever their names, but for one that is called like the result, which it takes
the place of. Work grows with the length of a text, of a candidate, and with the
number of matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import numbered, place_of

# Fixed values of the contract: kinds, in order, and their patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

#: Kinds that the method adds, after the base kinds.
ENTROPY_WINDOW = 20
#: Of each class: kind, characters, least window entropy in bits.
CLASSES = (
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7),
    ("entropy_hex", "0123456789ABCDEFabcdef", 3.0),
)
KINDS = ("assign", "access", "hex", *(name for name, _, _ in CLASSES))

#: A part of a path that is no key: words, in one case or as humps, with numbers at their ends, joined by dashes.
WORD = r"[0-9]*+(?:[A-Z]++(?![a-z])|[A-Z]?+[a-z]*+(?:[A-Z][a-z]{2,}+)*+)[0-9]*+"
PART = rf"{WORD}(?:[_+-]++{WORD})*+"

#: Candidates that are no secrets: dashed identifiers, paths, dates and counters, sample keys.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z_-]*$",
    r"^[0-9_/+-]*$",
    rf"^(?=[^/]*/[^/]*/)(?:{PART}/)*+{PART}$",
    r"(?i)example|sample|dummy|xxxx|0123456|abcdef0|123456789",
)

#: Matches that are laid end to end in one go.
BLOCK = 256

SPAN = "array<struct<kind:int,start:int,end:int>>"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is worked out once however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, in order: array of (start, end, match).

    They are laid end to end in blocks, first the blocks by their lengths and
    then the matches of each, so that no fold carries a list of all of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("b"), found.alias("m"))
    width = lambda x: F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def cut(all_pieces: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor((F.size(all_pieces) - 1) / BLOCK).cast("int"))
        return F.transform(number, lambda k: F.slice(all_pieces, k * BLOCK + 1, F.lit(BLOCK)))

    def starts(blocks: Column) -> Column:
        return F.aggregate(
            blocks,
            F.array(F.lit(0)),
            lambda acc, own: F.concat(
                acc, F.array(F.aggregate(own, F.element_at(acc, -1), lambda at, x: at + width(x)))
            ),
        )

    def lay(own: Column, first: Column) -> Column:
        return F.aggregate(
            own,
            F.struct(first.alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out")),
            lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
                F.struct(
                    (acc["at"] + width(x)).alias("at"),
                    F.concat(
                        acc["out"],
                        F.array(
                            F.struct(
                                (acc["at"] + F.length(x["b"])).alias("start"),
                                (acc["at"] + width(x)).alias("end"),
                                x["m"].alias("match"),
                            )
                        ),
                    ).alias("out"),
                )
            ),
            lambda acc: acc["out"],
        )

    def laid(blocks: Column) -> Column:
        return once(starts(blocks), lambda at: F.flatten(F.transform(blocks, lambda own, k: lay(own, F.get(at, k)))))

    return once(once(pieces, cut), laid)


def spans_of(text: Column, pattern: str, kind: str, keep=None) -> Column:
    found = matches(text, pattern)
    if keep is not None:
        found = F.filter(found, keep)
    out = F.transform(
        found,
        lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end")),
    )
    # most texts have none: then nothing is split or folded
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(SPAN)).cast(SPAN)


def most_entropy(candidate: Column, alphabet: str, window: int) -> Column:
    """The greatest Shannon entropy of any ``window`` characters of ``candidate``, -1 if it is shorter.

    The fold keeps a count for each character and the sum of c * log2(c); a
    step takes one character in and, once the window is full, one out, and
    changes the two terms that these touch.
    """

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(F.when(c > 1, c).otherwise(1).cast("double"))).otherwise(0.0)

    places = F.transform(F.split(candidate, ""), lambda ch: F.position(ch, F.lit(alphabet)) - 1)

    def pairs(places: Column) -> Column:
        return F.transform(
            places,
            lambda p, i: F.struct(
                p.alias("come"), F.when(i >= window, F.get(places, i - window)).otherwise(-1).alias("go"), i.alias("i")
            ),
        )

    zero = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best")
    )

    def bump(n: Column, at: Column, by: int) -> Column:
        return F.transform(n, lambda v, j: F.when(j == at, v + by).otherwise(v))

    def step(acc: Column, x: Column) -> Column:
        out = F.when(x["go"] >= 0, F.get(acc["n"], x["go"])).otherwise(0)
        lessened = F.when(x["go"] >= 0, bump(acc["n"], x["go"], -1)).otherwise(acc["n"])
        s = acc["s"] + F.when(x["go"] >= 0, term(out - 1) - term(out)).otherwise(0.0)
        same = F.when(x["go"] == x["come"], 1).otherwise(0)
        before = F.get(acc["n"], x["come"]) - same
        grown = s + term(before + 1) - term(before)
        entropy = F.lit(float(window)).cast("double")
        entropy = F.log2(entropy) - grown / window
        return F.struct(
            bump(lessened, x["come"], 1).alias("n"),
            grown.alias("s"),
            F.when(x["i"] >= window - 1, F.greatest(acc["best"], entropy)).otherwise(acc["best"]).alias("best"),
        )

    return F.aggregate(once(places, pairs), zero, step, lambda acc: acc["best"])


def core_of(candidate: Column) -> Column:
    """What is judged of a candidate with two slashes or more: from its first part that is no word to its last."""
    parts = F.split(candidate, "/", -1)
    odd = F.filter(
        F.transform(parts, lambda p, i: F.when(~p.rlike(f"^{PART}$"), i)), lambda i: i.isNotNull()
    )
    core = F.array_join(F.slice(parts, F.array_min(odd) + 1, F.array_max(odd) - F.array_min(odd) + 1), "/")
    return F.when(candidate.rlike("/[^/]*/"), F.coalesce(core, F.lit(""))).otherwise(candidate)


def entropy_spans(text: Column, kind: str, alphabet: str, least: float, window: int) -> Column:
    escaped = alphabet.replace("-", r"\-")
    # Whole runs of the class with a digit in them: anything else is prose or a number.
    pattern = rf"(?<![{escaped}])(?=[{escaped}]*?[0-9])[{escaped}]{{{window},}}"

    def secret(core: Column) -> Column:
        known = F.lit(False)
        for allowed in ALLOWED:
            known = known | core.rlike(allowed)
        return ~known & (most_entropy(core, alphabet, window) >= least)

    # the span is the whole candidate, as a key's first or last part may look like a word
    return spans_of(text, pattern, kind, lambda m: F.exists(F.array(core_of(m["match"])), secret))


def scan(df: DataFrame, window: int = ENTROPY_WINDOW, into: str = "secret_spans") -> DataFrame:
    """``df`` (text and more) with the column ``into``: array of (start, kind, end) by start, then kind as in KINDS."""
    plain, names = numbered(df), df.columns
    text = F.coalesce(F.col(f"c{place_of(df, 'text')}"), F.lit(""))
    parts = [
        spans_of(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= ASSIGN_VALUE),
        spans_of(text, ACCESS, "access"),
        spans_of(text, HEX, "hex"),
        *(entropy_spans(text, name, alphabet, least, window) for name, alphabet, least in CLASSES),
    ]
    in_order = F.array_sort(
        F.transform(
            F.concat(*parts),
            lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")),
        )
    )
    kept = [k for k, name in enumerate(names) if name != into]
    return plain.select(*[F.col(f"c{k}") for k in kept], in_order.alias("found")).toDF(*[names[k] for k in kept], into)


def spans_text(spans: Column, base_only: bool = False) -> Column:
    """Spans as kind:start:end, joined by commas."""
    if base_only:
        spans = F.filter(spans, lambda s: s["kind"] < 3)
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
                ).alias("out"),
            )
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
