import glob
import gzip
import hashlib
import json
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from rillwork.llm import fingerprints, language_id, queries, warc


def test_held_out_accuracy(spark, docs):
    model = language_id.train(docs)
    assert (model.weights == 0).mean() > 0.2
    own = language_id.identify(docs.withColumn("held", language_id.held_out(docs["doc_id"])), model).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in own)
    held = [r for r in own if r.held and r.lang]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in own)


def test_training_sees_only_its_part(spark, docs):
    """Labels and texts of held-out rows do not change the model; the sample is bounded."""
    changed = docs.withColumn("lang", language_id.F.when(language_id.held_out(docs["doc_id"]), "xx").otherwise(docs["lang"]))
    one, two = language_id.train(docs), language_id.train(changed)
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights)
    small = language_id.train(docs, per_language=10)
    assert small.languages and not np.array_equal(small.weights, one.weights)


def test_document_frequencies_cover_all_labelled_rows(docs):
    """The sample bounds the fit only."""
    held = language_id.held_out(docs["doc_id"])
    texts = [r.text for r in docs.filter(~held & docs["lang"].isNotNull() & docs["text"].isNotNull()).collect()]
    row, feature, _ = language_id.features(texts)
    n, df = len(set(row.tolist())), np.bincount(feature, minlength=1 << language_id.BITS)
    assert n > 40
    for bound in (10, 800):
        assert np.allclose(language_id.train(docs, per_language=bound).idf, np.log((1 + n) / (1 + df)) + 1)


def test_no_letters(spark, edges, empty, docs):
    model = language_id.train(docs)
    for r in language_id.identify(edges, model).collect():
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has) and (has or r.score == 0)
    assert language_id.train(empty) is None
    assert {r.lang_pred for r in language_id.identify(edges, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_softmax_and_grams():
    row, feature, count = language_id.features(["ab", None, "b"])
    assert count[row == 0].sum() == 4 + 3 + 2 and not (row == 1).any() and count[row == 2].sum() == 3 + 2 + 1


def plain_ftrl(xs, ys, classes, alpha=0.5, beta=1.0, l1=2e-4, l2=1e-4, passes=3):
    """FTRL-proximal, a coordinate at a time."""
    z, n = Counter(), Counter()

    def weight(f, k):
        if abs(z[f, k]) <= l1:
            return 0.0
        return -(z[f, k] - math.copysign(l1, z[f, k])) / ((beta + math.sqrt(n[f, k])) / alpha + l2)

    for _ in range(passes):
        for x, y in zip(xs, ys, strict=True):
            w = {(f, k): weight(f, k) for f in x for k in range(classes)}
            odds = [math.exp(sum(v * w[f, k] for f, v in x.items())) for k in range(classes)]
            for (f, k), own in w.items():
                g = x[f] * (odds[k] / sum(odds) - (k == y))
                z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / alpha * own
                n[f, k] += g * g
    return {key: weight(*key) for key in z}


def test_training_equals_a_plain_version():
    texts = ["the cat and the dog", "der Hund und die Katze", "le chat et le chien", "a dog on the road", "ein Hund am Weg", "un chien sur la route"] * 2
    labels = ["en", "de", "fr"] * 4
    rows, feature, count = language_id.features(texts)
    samples = [(feature[rows == k], count[rows == k]) for k in range(len(texts))]
    model = language_id.fit(samples, labels)
    df = Counter(f for own, _ in samples for f in own.tolist())
    xs, kept = [], [k for k in range(len(texts)) if k % 5]
    for k in kept:
        value = {f: (1 + math.log(c)) * (math.log((1 + len(texts)) / (1 + df[f])) + 1) for f, c in zip(*(a.tolist() for a in samples[k]), strict=True)}
        norm = math.sqrt(sum(v * v for v in value.values()))
        xs.append({f: v / norm for f, v in value.items()})
    want = np.zeros_like(model.weights)
    for (f, c), w in plain_ftrl(xs, [["de", "en", "fr"].index(labels[k]) for k in kept], 3).items():
        want[f, c] = w
    assert model.languages == ["de", "en", "fr"] and np.allclose(model.weights, want, atol=1e-9) and want.any()


def of(*texts):
    return fingerprints.fingerprints_of([fingerprints.paragraphs(t) for t in texts])


def test_fingerprints_are_homomorphic():
    one, two, both, turned = (of(t).bytes()[0] for t in ("a b c d\ne", "f g h", "a b c d\ne\nf g h", "f g h\na b c d\ne"))
    assert both == turned and one != two
    total = (of("a b c d\ne") + of("f g h")).bytes()[0]
    assert total == both and (of("a b c d\ne\nf g h") - of("f g h")).bytes()[0] == one
    assert of("x\nx").bytes() != of("x").bytes() and of("").bytes() != of("\n").bytes()


def test_edited_documents(spark, edges, edge_rows, empty):
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in edge_rows))
    want = []
    for k, (known, doc_id, text) in enumerate(rows):
        edited = fingerprints.edited_text(text, rows[(k + 1) % len(rows)][2])
        want.append((doc_id if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), of(text).bytes()[0].hex(), of(edited).bytes()[0].hex()))
    got = fingerprints.fingerprints(edges).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(edges.filter("doc_id = 9").limit(1)).first()
    assert one.near_next == 1.0


def test_likeness(spark, docs):
    rows = fingerprints.fingerprints(docs.filter("n_chars > 400")).collect()
    assert np.mean([r.near_edited for r in rows]) > 0.5 and np.mean([r.near_next for r in rows]) < 0.1


def marks_of(text):
    """What a text's fingerprint sums: its paragraphs, and the runs of three words within them."""
    own = Counter()
    for p in re.split(r"\n|(?<=\.) ", text):
        words = re.findall(r"[^\x20\x09-\x0D]+", p)
        own.update([p, *zip(words, words[1:], words[2:], strict=False)])
    return own


def test_fingerprints_equal_brute_force(docs):
    """Equal fingerprints for equal multisets of paragraphs only; likeness near that of the multisets counted in full."""
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    whole = {i: marks_of(texts[i]) for i in ids}
    assert len({got[i].fingerprint for i in ids}) == len({frozenset(Counter(fingerprints.paragraphs(texts[i])).items()) for i in ids})

    def likeness(a, b):
        ab = sum(n * b[x] for x, n in a.items())
        return ab / (sum(n * n for n in a.values()) + sum(n * n for n in b.values()) - ab)

    off = []
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        edited = marks_of(fingerprints.edited_text(texts[i], texts[after]))
        off += [got[i].near_edited - likeness(whole[i], edited), got[i].near_next - likeness(whole[i], whole[after])]
    assert max(map(abs, off)) < 0.5 and np.mean(np.abs(off)) < 0.1 and abs(np.mean(off)) < 0.06


def pages(spark):
    big = "<p>same</p>" * 30
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 200_000), (None, "u", big), (1, "http://b", big)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string"), big


def test_archives(spark, tmp_path):
    df, big = pages(spark)
    folder = f"file://{tmp_path}/w"
    rows = warc.round_trip(df.repartition(2), folder).collect()
    kinds = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows if r.page_id)
    n = len(big)
    assert kinds == [(1, "response", None, n), (1, "response", None, n), (2, "revisit", 1, n), (3, "revisit", 1, n), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (7, "response", None, 0), (8, "response", None, 400_000)]
    assert [r.record_type for r in rows if r.page_id is None] == ["response"]
    assert {r.payload_digest for r in rows if r.page_id in (1, 2, 3)} == {hashlib.sha256(big.encode()).hexdigest()}
    whole = glob.glob(f"{tmp_path}/w/whole/*.warc.gz")
    for path in whole:
        raw = open(path, "rb").read()
        one = zlib.decompressobj(31)
        plain = one.decompress(raw) + one.flush()
        assert one.eof and not one.unused_data
        after = path.replace("/whole/", "/members/")
        assert gzip.decompress(open(after, "rb").read()) == plain
        index = [json.loads(x) for x in open(after + ".index")]
        members = open(after, "rb").read()
        assert sum(x["length"] for x in index) == len(members)
        assert all(gzip.decompress(members[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1") for x in index)


def test_archives_of_nothing(spark):
    df, _ = pages(spark)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_stream_pieces():
    raw = [warc.record(k, "u", b"\r\n\r\n" * k, "d", None) for k in range(50)]
    joined = b"".join(raw)
    for size in (1, 7, 1000):
        assert list(warc.records(joined[k : k + size] for k in range(0, len(joined), size))) == raw


def test_oracles(spark, small):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, small)
        rows = con.execute(sql)
        columns = [c[0] for c in rows.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, rows.fetchall())), name
