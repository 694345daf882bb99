import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rillwork.llm import token_matrix, vector_packing
from rillwork.llm.common import TRIM_EVERY, trimmed
from rillwork.llm.tokens import default_vocabulary, tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(library, docs, edge_rows):
    texts = [r[1] for r in edge_rows] + [r.text for r in docs.limit(60).collect()]
    texts += ["It's naïve: İstanbul ΣΑΣ áb don't 12345 \x1cz ... <|endoftext|> ﬁ á \x85q ­"]
    ids, begin = tokenizer(default_vocabulary()).ids(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == ids_of(library, text)


def test_trimming_leaves_batches_as_they_are():
    for n in (0, 1, TRIM_EVERY, 3 * TRIM_EVERY + 1):
        batches = [pa.record_batch({"x": [k]}) for k in range(n)]
        assert list(trimmed(iter(batches))) == batches


ADDED = [
    "alpha <|endoftext|> beta",
    "<|endoftext|><|startoftext|>",
    "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext| > It's<|endoftext|>'s",
    None,
    "no literal here",
    "<|endoftext|>\u0301x  \n<|startoftext|> " + "tail <|endoftext|> " * 1500,
    "",
]


def test_added_tokens_are_the_librarys(spark, library):
    """With the library's default settings, a literal added token is one id."""
    assert ids_of(library, ADDED[0]) == [8624, 49407, 9505]
    for end in (None, 0):
        ids, begin = tokenizer(default_vocabulary()).ids(pa.array(ADDED, pa.string()), end)
        for k, text in enumerate(ADDED):
            assert ids[begin[k] : begin[k + 1]].tolist() == ids_of(library, text) + [0] * (end == 0)
    rows = list(enumerate(ADDED))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed = vector_packing.pack_vectors(df, default_vocabulary()).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str)
    assert got == expected_pieces(library, rows, 2048)
    parts: dict = {}
    for r in token_matrix.write_packed(token_matrix.pack_tokens(df, default_vocabulary())).collect():
        line = np.frombuffer(r.input_ids, "<u2")
        for k, place in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            parts[place] = line[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    for doc_id, text in rows:
        own = [ids for (d, _), ids in sorted(parts.items()) if d == doc_id]
        assert [x for ids in own for x in ids] == [*ids_of(library, text), 0]


def test_every_entry_merges_to_itself(library):
    """What the rank-based BPE rests on: a token's text is that one token."""
    vocab = {k: i for k, i in library.get_vocab().items() if i < 49406}
    for token, i in vocab.items():
        if token.endswith("</w>"):
            assert [t.id for t in library.model.tokenize(token[:-4])] == [i]


def expected_pieces(library, rows, capacity):
    out = []
    for doc_id, text in rows:
        ids = [*ids_of(library, text), 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check_sequences(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_vector_packing(edges, edge_rows, library, score):
    rows = vector_packing.pack_vectors(edges, default_vocabulary(), score=score).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    assert got == expected_pieces(library, [(r[0], r[1]) for r in edge_rows], 2048)
    used = check_sequences(rows, 2048)
    if score == "norm":
        assert used <= -(-sum(r.length for r in rows) // 2048) + 1


def test_vector_packing_of_nothing(empty):
    assert vector_packing.pack_vectors(empty, default_vocabulary()).count() == 0


def test_all_capacities_hold():
    rng = random.Random(3)
    for score in ("norm", "dot"):
        for _ in range(20):
            histogram = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(12)}
            docs, cost = rng.randint(1, 6), rng.randint(10_000, 14_000)
            plan = vector_packing.plan_bins(histogram, 100, docs, cost, score)
            bins: dict[int, list] = {}
            for length, n in histogram.items():
                for rank in range(n):
                    (hit,) = [p for p in plan if p[0] == length and p[1] <= rank < p[2]]
                    bins.setdefault(hit[4] + (rank - hit[1]) // hit[3], []).append(length)
            for own in bins.values():
                assert sum(own) <= 100 and len(own) <= docs and sum(x * x for x in own) <= cost
    with pytest.raises(ValueError):
        vector_packing.plan_bins({50: 1}, 100, 2, 100)


def test_best_fit_is_as_good_as_by_hand():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 60))]
        rows = token_matrix.best_fit_decreasing(lengths, 64)
        assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
        room: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits, key=lambda k: room[k])] -= n
            else:
                room.append(64 - n)
        assert len(rows) == len(room)
        assert sorted(64 - sum(lengths[i] for i in row) for row in rows) == sorted(room)


def test_token_matrix_is_lossless(edges, edge_rows, library):
    packed = token_matrix.write_packed(token_matrix.pack_tokens(edges, default_vocabulary(), block_tokens=5000)).collect()
    parts: dict = {}
    for r in packed:
        line = np.frombuffer(r.input_ids, "<u2")
        assert len(line) == 2048 and not line[r.n_tokens :].any() and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == r.starts
        for k, (doc_id, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            parts.setdefault((doc_id, start), []).append(line[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist())
    assert len({r.sequence_id for r in packed}) == len(packed)
    for doc_id, text in {(r[0], r[1]) for r in edge_rows}:
        copies = sum(r[0] == doc_id for r in edge_rows)
        own = sorted((start, ids) for (d, start), many in parts.items() if d == doc_id for ids in many[:1])
        assert [x for _, ids in own for x in ids] == [*ids_of(library, text), 0]
        assert all(len(many) == copies for (d, _), many in parts.items() if d == doc_id)


def test_token_matrix_of_nothing(empty):
    assert token_matrix.pack_tokens(empty, default_vocabulary()).count() == 0
