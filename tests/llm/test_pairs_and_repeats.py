import collections
import hashlib
import os
import random
import re
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rillwork.llm import common, components, decontaminate, jaccard_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = {}
    for doc_id, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        out.setdefault(doc_id, []).append(own)
    return out


def components_by_hand(rows):
    sets = sets_of(rows)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s and i is not None]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            both = len(a & b)
            if i != j and 5 * both >= 4 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), root(i)) for i, many in sets.items() for s in many)


def joined(df):
    return collections.Counter(map(tuple, jaccard_join.jaccard_components(df).collect()))


def test_edge_documents(edges, edge_rows, empty):
    assert joined(edges) == components_by_hand([(r[0], r[1]) for r in edge_rows])
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_documents(docs):
    assert joined(docs) == components_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_join_stages_what_is_read_again(docs, monkeypatch):
    """On a local folder each file of a staged table costs its task two processes (chmod), so none is staged to be read once."""
    staged, settle = [], common.settle

    def noted(df, tag, path=None):
        staged.append(tag)
        return settle(df, tag, path)

    for module in (common, components, jaccard_join):
        monkeypatch.setattr(module, "settle", noted)
    assert joined(docs) == components_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert len(staged) == 20 and not {"links", "near-ids"} & set(staged)


def test_join_starts_no_process_for_what_it_stages(tmp_path):
    """A child of the JVM shares its memory until it has its own program, and Spark's writer starts chmod for each file."""
    calls, tool = tmp_path / "calls", tmp_path / "bin" / "chmod"
    tool.parent.mkdir()
    tool.write_text(f'#!/bin/sh\necho "$@" >> {calls}\nPATH={os.environ["PATH"]} exec chmod "$@"\n')
    tool.chmod(0o755)
    code = f"""
from pyspark.sql import SparkSession
conf = {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
from rillwork.llm import jaccard_join
rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "x")]
got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
assert sorted(map(tuple, got)) == [(1, 2, 1), (2, 1, 2), (3, 2, 1)], got
spark.range(1).write.parquet("file://{tmp_path}/other")
"""
    env = os.environ | {"PATH": f"{tool.parent}{os.pathsep}{os.environ['PATH']}"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, timeout=400)
    called = calls.read_text()
    assert f"{tmp_path}/other" in called
    assert "/jaccard-" not in called


def test_first_attempt_of_a_task_gives_the_file(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "GROUP_ROWS", 3)
    batches = [pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64())}) for a in ([1, 2], [], [3, 4], [5])]

    def broken():
        yield from batches
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        common.write_part(broken(), str(tmp_path), 7, 0)
    assert not os.listdir(tmp_path)
    common.write_part(iter(batches), str(tmp_path), 7, 1)
    common.write_part(iter(batches[:1]), str(tmp_path), 7, 2)
    common.write_part(iter([]), str(tmp_path), 8, 3)
    assert os.listdir(tmp_path) == ["part-000007.parquet"]
    own = pq.ParquetFile(tmp_path / "part-000007.parquet")
    assert own.read().column("a").to_pylist() == [1, 2, 3, 4, 5] and own.num_row_groups == 2

    def no_links(*_):
        raise PermissionError

    monkeypatch.setattr(os, "link", no_links)
    common.write_part(iter(batches), str(tmp_path), 9, 4)
    assert sorted(os.listdir(tmp_path)) == ["part-000007.parquet", "part-000009.parquet"]


def near_copies(rng, groups, size, length, edits):
    rows = []
    for g in range(groups):
        base = [f"w{g}x{rng.randint(0, 200)}" for _ in range(length)]
        shared = [f"common{k}" for k in range(12)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(length)] = f"new{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(own[: length // 2] + shared + own[length // 2 :])))
    return rows


@pytest.mark.parametrize("tile", [2, 512])
def test_chains_of_near_copies(spark, monkeypatch, tile):
    """Groups whose members link only by way of others, laid out in small tiles too."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = near_copies(random.Random(tile), 6, 12, 80, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert joined(df) == components_by_hand(rows)


def test_exact_threshold(spark):
    """Similarities of exactly 0.8 link; just below they do not."""
    words = [f"a{k}" for k in range(200)]
    rows = [(1, " ".join(words[:94])), (2, " ".join(words[10:104])), (3, " ".join(words[100:190])), (4, " ".join(words[110:200]))]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == components_by_hand(rows)


@pytest.mark.parametrize("task_edges", [0, 3, 10**6])
def test_components(spark, task_edges):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), task_edges).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def repeats_by_hand(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    counts = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(w) - window + 1) if counts[tuple(w[k : k + window])] > 1 for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("bucket", [1, 2000])
def test_repeated_passages(spark, edges, edge_rows, bucket):
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = [(r[0], r[1]) for r in edge_rows]
    for k in range(20):
        own = [f"q{rng.randint(0, 10**6)}" for _ in range(80)]
        at = rng.randint(0, 80)
        part = passage[: rng.choice([20, 34, 35, 36, 60])]
        rows.append((200 + k, "\t".join(own[:at] + part + own[at:])))
    rows += [(300, " ".join(passage[:40] * 2)), (301, " ".join(["Case"] + passage[5:45])), (302, "a b " * 40), (302, "c d " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.remove_repeats(df, bucket=bucket).collect()
    assert sorted(str(tuple(r)) for r in got) == repeats_by_hand(rows, 35)


def test_repeats_in_documents(docs, empty):
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == repeats_by_hand([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert substring_dedup.remove_repeats(empty).count() == 0


ITEMS = [
    (1, "What is the tallest mountain on the northern continent of the second moon? It is Mount Aurel, twelve kilometres high."),
    (2, "Short item here."),
    (3, "Éléphants marchent lentement vers la grande rivière du sud chaque matin. Ils boivent de l'eau fraîche avant midi."),
    (4, None),
    (5, "..."),
    (6, ""),
]


def test_leaks(spark, edges, empty):
    filler = " ".join(f"filler{k % 37} the is of on" for k in range(400))
    rows = [
        (1, filler + " " + ITEMS[0][1] + " " + filler),
        (2, ITEMS[0][1].upper().replace("?", "")),
        (3, filler + " What is the tallest mountain? " + filler),
        (4, filler + "\n" + ITEMS[2][1].upper() + "\n" + filler),
        (5, "a short item here. yes"),
        (6, filler),
        (7, None),
        (8, ITEMS[0][1] + " " + ITEMS[2][1]),
    ]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 3), (5, 2), (8, 1), (8, 3)}
    assert decontaminate.find_leaks(edges, bench).count() == 0
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(df.union(df), bench).count() == 2 * len(got)


def test_block_max_wand_finds_all():
    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(120)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 15)))) for k in range(200)]
    for threshold in (0.3, 0.6, 0.9):
        index = decontaminate.Index(items, threshold)
        score = collections.defaultdict(dict)
        for t, (own, impacts, *_) in enumerate(index.lists):
            for item, impact in zip(own, impacts, strict=True):
                score[item][t] = impact
        for _ in range(40):
            query = rng.sample(range(len(index.terms)), rng.randint(1, 60))
            want = {i: sum(s.get(t, 0) for t in query) for i, s in score.items()}
            want = {i: v for i, v in want.items() if v >= threshold - 1e-9}
            got = dict(index.search(query))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_leaks_in_documents(spark, small, docs):
    """Every document that holds an item word for word is found, and no document without a part of one."""
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    found = {r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()}
    items = [r.text for r in bench.collect()]
    norm = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    texts = {r.doc_id: norm(r.text) for r in docs.collect()}
    assert found == {i for i, t in texts.items() if any(norm(x) in t for x in items)}


def test_scores_do_not_depend_on_blocks(spark):
    """Counts behind a score are those of the whole benchmark, however its items are dealt into blocks."""
    rng = random.Random(11)
    common, rare = [f"w{k}" for k in range(12)], [f"r{k}" for k in range(400)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randint(6, 40))) for _ in range(40)]
    bench = spark.createDataFrame([*enumerate(texts), (None, "no id"), (99, None), (98, "")], "item_id long, text string")
    passages = [" ".join(rng.choices(common, k=30)) + " " + t.rsplit(" ", 1)[0] + " and more" for t in texts]
    df = spark.createDataFrame(list(enumerate(passages)), "doc_id long, text string").repartition(3)

    def rows(block):
        leaks = decontaminate.find_leaks(df, bench, block=block).collect()
        return sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in leaks)

    want = rows(1000)
    assert len(want) >= 40
    assert rows(14) == want
    whole = decontaminate.counted(decontaminate.item_rows(bench))
    assert (whole.items, whole.longest) == (41, max(len(t.split()) for t in texts))
    assert whole.mean == pytest.approx(sum(len(t.split()) for t in texts) / 41)


def test_item_blocks(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [len(b) for b in decontaminate.item_blocks(bench, 2)] == [2, 2, 1]
