"""SimHash, embeddings, toxicity and components against plain Python."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from offerlake.llm import embeddings, queries, simhash, toxicity
from offerlake.llm.common import connected
from offerlake.llm.string_kernel import Landmarks


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(4)
    n = 400
    pairs = [(k, k + 1) for k in range(0, 90)] + [(100, k) for k in range(101, 180)] + [(5, 5)]
    pairs += [(rnd.randrange(200, n), rnd.randrange(200, n)) for _ in range(90)]
    rnd.shuffle(pairs)
    vertices = spark.createDataFrame([(k,) for k in range(n)], "v long")
    edges = spark.createDataFrame(pairs * 2, "a long, b long")
    got = {r.v: r.component for r in connected(vertices, edges, "test").collect()}
    assert [got[k] for k in range(n)] == roots(n, pairs)
    none = connected(vertices, edges.limit(0), "none").collect()
    assert all(r.v == r.component for r in none)


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "one two", "A b c d É", "x y z x y z x y z", "w " * 70_000]
    for text in texts:
        assert simhash.fingerprint(text) == brute_fingerprint(text), text
    row = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert row % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_fingerprint_links_are_complete(spark):
    rnd = random.Random(8)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for base in fps[:30]:
        for _ in range(12):
            value = base
            for bit in rnd.sample(range(64), rnd.randrange(1, 8)):
                value ^= 1 << bit
            fps.append(value)
    fps = sorted(set(fps)) + [0, 2**63]
    pairs = [
        (a, b)
        for a in range(len(fps))
        for b in range(a)
        if (fps[a] ^ fps[b]).bit_count() <= 3
    ]
    assert len(pairs) > 50
    frame = spark.createDataFrame([(simhash._as_long(f),) for f in fps], "fp long")
    found = simhash.links(frame).collect()
    place = {simhash._as_long(f): k for k, f in enumerate(fps)}
    mine = [(place[r.a], place[r.b]) for r in found]
    assert set(map(tuple, map(sorted, mine))) <= set(map(tuple, map(sorted, pairs)))
    assert roots(len(fps), mine) == roots(len(fps), pairs)


def test_simhash_query(spark, tmp_path):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(500)}" for _ in range(300)]
    rows = [(k, " ".join(base), k) for k in (9, 7, 8)]
    for k in range(20, 60):
        words = list(base)
        words[rnd.randrange(300)] = "changed"
        rows.append((k, " ".join(words), k))
    rows += [(1, None, 0), (2, "", 0), (None, "", 0), (3, "alone at last", 0), (3, "alone at last", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_simhash(spark, str(tmp_path)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = roots(len(rows), pairs)
    expected = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        expected.append((str(i), f"{fps[k]:016x}", str(min(ids, default=None))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted(expected)
    kept = simhash.keep_one(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, *(int(c) for _, _, c in expected if c != "None")}
    assert simhash.keep_one(docs.limit(0)).count() == 0


def brute_links(rows):
    def usable(r):
        v = r[1]
        return r[2] is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)

    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if usable(x) and usable(y) and x[2] == y[2] and len(x[1]) == len(y[1]):
                p, q = np.array(x[1], np.float32).astype(float), np.array(y[1], np.float32).astype(float)
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.98:
                    pairs.append((a, b))
    return pairs


def test_embedding_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rnd = np.random.default_rng(3)
    rows = []
    for group in range(12):
        centre = rnd.normal(size=64)
        for _ in range(150 if group == 0 else 12):
            rows.append((centre + rnd.normal(size=64) * rnd.choice([0.05, 0.12]), group % 2))
    rows = [(k, [float(x) for x in v], label) for k, (v, label) in enumerate(rows)]
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(30)]
    rows += [
        (2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, [None] * 64, 1),
        (2004, [float("inf")] + [0.0] * 63, 1), (2005, rows[5][1], None), (2006, rows[5][1][:32], 0),
        (2007, [], 0), (2008, [1.0], 1), (2009, [2.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame.withColumn("u", F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.op10_embedding_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    pairs = brute_links(rows)
    true, found = np.zeros(len(rows), int), np.array([got[r[0]].n_links for r in rows])
    for a, b in pairs:
        true[a] += 1
        true[b] += 1
    assert (found <= true).all()
    assert found.sum() >= 0.95 * true.sum()
    root = roots(len(rows), pairs)
    assert np.mean([got[r[0]].component_id == rows[root[k]][0] for k, r in enumerate(rows)]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_recall_on_given_vectors(spark):
    """The given vectors, and each of them moved a little, against all pairs."""
    folder = "/root/testdata/sf0.001"
    rnd = np.random.default_rng(5)
    given = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    rows = []
    for r in given:
        v = np.array(r.embedding, float)
        for k in range(2):
            moved = v + k * rnd.normal(size=len(v)) * 0.16 * np.linalg.norm(v) / len(v) ** 0.5
            rows.append((2 * r.vec_id + k, [float(x) for x in moved], r.label))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = embeddings.near_duplicates(frame).agg(F.sum("n_links")).first()[0]
    true = 2 * len(brute_links(rows))
    assert true > 200
    assert 0.9 * true <= found <= true


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """Invented sentences; toxic ones hold one of four made-up insults, changed a little."""
    rnd = random.Random(6)
    insults = ["grobblewit", "snarfling", "mudwump", "pillock"]
    syllables = ["ta", "ro", "mi", "ne", "sul", "var", "ket", "do", "lin", "pa"]

    def word():
        return "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))

    def text(insult):
        sentences = [[word() for _ in range(rnd.randrange(4, 12))] for _ in range(rnd.randrange(1, 6))]
        if insult:
            place = rnd.choice(sentences)
            place.insert(rnd.randrange(len(place)), insult)
        return ". ".join(" ".join(s) for s in sentences)

    docs = [(k, text(rnd.choice(insults) if k % 5 == 0 else None), k % 5 == 0) for k in range(1200)]
    odd = {
        9001: ("grob-ble-wit", 1), 9002: ("you are a m u d w u m p indeed", 1), 9003: ("snarfxling", 1),
        9004: ("PILLOCK!", 1), 9005: ("pil.lock", 1), 9006: (None, 0), 9007: ("", 0), 9008: ("a b c d e f", 0),
    }
    folder = str(tmp_path_factory.mktemp("toxic"))
    rows = [(k, t, "en") for k, t, _ in docs] + [(k, t, None) for k, (t, _) in odd.items()]
    rows += [(None, "pillock", None)]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(y)) for k, _, y in docs] + [(None, 1), (3, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {k: int(y) for k, _, y in docs} | {k: y for k, (_, y) in odd.items()}


def test_toxicity_on_held_out_rows(spark, labelled):
    folder, truth = labelled
    rows = queries.op8_toxicity(spark, folder).collect()
    assert len(rows) == len(truth) + 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    wrong = [r.doc_id for r in rows if r.doc_id is not None and r.predicted != truth[r.doc_id]]
    assert not [k for k in wrong if k > 9000], wrong
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.doc_id in wrong for r in held) <= 0.03 * len(held)


def test_toxicity_without_labels(spark, labelled, tmp_path):
    docs = spark.read.parquet(f"{labelled[0]}/documents.parquet")
    labels = spark.read.parquet(f"{labelled[0]}/labels.parquet")
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.train(docs.limit(0), labels) is None
    assert toxicity.score(docs, None).agg(F.max("score")).first()[0] == 0


def test_copies_take_no_places_in_the_sample(spark, monkeypatch):
    """Copies of the text that comes first in the order of the sample, more than it holds."""
    monkeypatch.setattr(toxicity, "SAMPLE", 12)
    rnd = random.Random(9)
    words = ["talvar", "ketdolin", "rosulmi", "panevar", "domiro", "linketsul"]
    toxic = [" ".join(rnd.sample(words, 4) + ["grobblewit", str(k)]) for k in range(30)]
    clean = [" ".join(rnd.sample(words, 4) + [str(k)]) for k in range(30)]
    first = min(toxic, key=lambda t: simhash._as_long(xxhash.xxh64_intdigest(t.encode(), 42)))
    texts = [(t, 1) for t in [*toxic, *[first] * 60]] + [(t, 0) for t in clean]
    ids = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 4 != 2][: len(texts)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in zip(ids, texts, strict=True)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in zip(ids, texts, strict=True)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, share: seen.append((texts, labels)))
    toxicity.train(docs, labels)
    got = [(t, y) for t, y in zip(*seen[0], strict=True)]
    assert len(got) == len(set(got)) == 24
    assert sum(y for _, y in got) == 12


def test_kernel_knows_changed_words():
    marks = Landmarks(["grobblewit", "mudwump"])
    words = ["grobblewit", "grobxblewit", "mudwwump", "talvarket", "thegrobblewits"]
    like = marks.likeness(words)
    assert like[0][0] == pytest.approx(1) and like[4][0] == pytest.approx(1)
    assert like[1][0] > 0.4 and like[2][1] > 0.4
    assert 3 not in like
    assert marks.likeness([]) == {} and marks.likeness(["ab"]) == {}
