"""Token ids of the public word-end BPE vocabulary, at a word a lookup.

The tokenizer cuts a text at white space before it merges anything, so the
ids of a text are those of its words in turn. The distinct words of a batch are
looked up, by their bytes, in a table kept by each Python worker; only words not
seen before are merged.

The vocabulary's added tokens stand for themselves where a text holds them
literally; texts are cut there before words are split.

Merging is done by the rank-based BPE of ``tiktoken``: the vocabulary's order
is its merge order, and the word-end mark is written as one space, a byte that
no word holds. Both give the same ids for every word as long as each vocabulary
entry, taken alone, merges to itself; the tests check that for the whole file.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

from rillwork.llm.words import gather, split_words

#: Entries after which a worker forgets the words it has seen.
CACHE_WORDS = 100_000

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LOADED: dict[str, WordTokenizer] = {}


def _byte_of_char() -> dict[str, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of words, kept under the words' bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        self._added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added tokens of {path} are not found by their literal text alone")
        chars = _byte_of_char()
        ranks = {}
        for token, i in vocab.items():
            if token in self._added:
                continue
            end = token.endswith("</w>")
            raw = bytes(chars[c] for c in (token[:-4] if end else token))
            ranks[raw + b" " if end else raw] = i
        # The byte 0x20 itself is never met inside a word; its entry stays for completeness.
        self._bpe = tiktoken.Encoding("word_ends", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self._ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self._ends[[i for raw, i in ranks.items() if raw.endswith(b" ")]] = True
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self._added, key=len, reverse=True))) + ")")
        self.dtype = "<u2" if max(*ranks.values(), *self._added.values()) < 1 << 16 else "<u4"
        self._forget()

    def _forget(self) -> None:
        self._seen: dict[bytes, int] = {}
        self._store, self._used = np.zeros(1 << 16, "<u4"), 1  # the first place holds the end id
        self._offsets, self._lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _pieces(self, word: str) -> list[str]:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
            # letter by letter: the tokenizer knows no final sigma
            word = "".join(c.lower() for c in word) if "Σ" in word else word.lower()
        else:
            word = word.lower()
        return [word] if word.isalpha() else _PIECE.findall(word)

    def _learn(self, words: list[bytes]) -> None:
        """Merge all of ``words`` in one call and cut the ids where pieces end."""
        pieces = [self._pieces(w.decode()) for w in words]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = [p for own in pieces for p in own]
        text = " ".join(flat) + " " if flat else ""
        ids = np.array(self._bpe.encode_ordinary(text), dtype="<u4")
        ends = np.concatenate([[0], np.flatnonzero(self._ends[ids]) + 1])
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])]
        known, held = len(self._seen), self._used
        self._seen.update(zip(words, range(known, known + len(words)), strict=True))
        self._store = _room(self._store, held + len(ids))
        self._store[held : held + len(ids)] = ids
        self._offsets = _room(self._offsets, known + len(words))
        self._offsets[known : known + len(words)] = held + cuts[:-1]
        self._lengths = _room(self._lengths, known + len(words))
        self._lengths[known : known + len(words)] = np.diff(cuts)
        self._used += len(ids)

    def _cut_ids(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of texts with added tokens: those of the pieces between, and a token's or ``end`` behind each."""
        pieces: list[str] = []
        behind: list[int] = []
        first = [0]
        for text in texts.to_pylist():
            parts = self._cut.split(text or "")
            pieces += parts[::2]
            behind += [*map(self._added.__getitem__, parts[1::2]), -1 if end is None else end]
            first.append(len(pieces))
        ids, begin = self._plain_ids(pa.array(pieces, pa.large_string()), None)
        marks = np.array(behind, dtype=np.int64)
        put = marks >= 0
        return np.insert(ids, begin[1:][put], marks[put]), (begin + np.concatenate([[0], np.cumsum(put)]))[first]

    def ids(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin; ``end``: an id to put after each text."""
        if any(pc.any(pc.match_substring(texts, t)).as_py() for t in self._added):
            return self._cut_ids(texts, end)
        return self._plain_ids(texts, end)

    def _plain_ids(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of texts that hold no added token."""
        if len(self._seen) > CACHE_WORDS:
            self._forget()
        w = split_words(texts)
        _, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        raw = w.data.tobytes()
        keys = [raw[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
        rows = list(map(self._seen.get, keys))
        if None in rows:
            self._learn([w for w, row in zip(keys, rows, strict=True) if row is None])
            rows = list(map(self._seen.__getitem__, keys))
        rows = np.array(rows, dtype=np.int64)[back]
        offsets, lengths = self._offsets[rows], self._lengths[rows]
        n = len(w.first) - 1
        if end is not None:
            self._store[0] = end
            offsets, lengths = np.insert(offsets, w.first[1:], 0), np.insert(lengths, w.first[1:], 1)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        begin = sums[w.first + (np.arange(n + 1) if end is not None else 0)]
        return self._store[gather(offsets, lengths)], begin


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


def tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
