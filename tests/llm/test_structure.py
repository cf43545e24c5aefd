"""Merkle manifest, fill-in-the-middle and language labels against plain Python and DuckDB."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlake.llm import fim, langid, merkle, queries
from offerlake.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators give to their own columns.
CLASHES = "item int, leaf int, pos int, n int, tree int, way int, form int, output int, restored int, id int, mark int, pieces int"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SENTINEL = re.compile("<[PSM]>")

ODD_ROWS = [
    (1, None, None, "b", None),
    (2, "", "en", "b", 0),
    (3, "line\nline\n\n", "en", None, 11),
    (3, "line\nline\n\n", "en", None, 11),
    (3, "other of the same id", "en", None, 20),
    (None, "no id\nat all", None, "b", 12),
    (4, "a <M> of its own", "fr", "", 16),
    (5, "é漢😀 " * 20_000, "de", "-", 80_000),
    (6, "\n", "de", "é", 1),
    (-7, "x" * 300_000, "de", "b", 300_000),
    (8, "12 34 :;", "fr", None, 8),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def write(spark, folder, rows):
    wide = [(*row, *range(12)) for row in rows]
    spark.createDataFrame(wide, f"{SCHEMA}, {CLASHES}").write.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    write(spark, folder, ODD_ROWS)
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    write(spark, folder, [])
    return folder


def given(spark, folder):
    return [tuple(r)[:5] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# Merkle manifest


def parents(nodes):
    return [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]


def brute_tree(leaves):
    """Root, and the siblings left and right of each leaf's ancestors, from the leaf up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(parents(levels[-1]))
    ways = []
    for k in range(len(leaves)):
        way = []
        for nodes in levels[:-1]:
            low = k - k % 3
            way.append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + 3])))
            k //= 3
        ways.append(way)
    return levels[-1][0], ways


def brute_manifest(rows):
    def leaf(row, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))

    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row[0], leaf(row, row[1]), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        leaves = sorted(by_source[source], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *brute_tree([x[1] for x in leaves])))
    if not trees:
        return []
    root, group_ways = brute_tree([t[1] for t in trees])
    result = []
    for (leaves, subroot, ways), group_way in zip(trees, group_ways, strict=True):
        for (doc_id, digest, row), way in zip(leaves, ways, strict=True):
            now = digest
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and row[1] is not None:
                now = leaf(row, row[1].replace("\n", ""))
            for left, right in way + group_way:
                now = sha(left + now + right)
            proof = sha("".join(left + right for left, right in way + group_way))
            result.append((doc_id, digest, subroot, root, proof, now, now == root))
    return sorted(result, key=repr)


def test_manifest_of_given_rows(spark):
    assert rows_of(queries.op11_merkle_manifest(spark, SF)) == brute_manifest(given(spark, SF))


def test_manifest_of_odd_rows(spark, odd, empty):
    assert rows_of(queries.op11_merkle_manifest(spark, odd)) == brute_manifest(ODD_ROWS)
    assert rows_of(queries.op11_merkle_manifest(spark, empty)) == []


@pytest.mark.parametrize("folded", [1, 4])
def test_manifest_of_a_source_that_holds_most_rows(spark, folder, monkeypatch, folded):
    """With one level to a block, ways are joined over many rounds and blocks."""
    monkeypatch.setattr(merkle, "FOLDED", folded)
    monkeypatch.setattr(merkle, "BLOCK", 3**folded)
    rows = [(k, f"text\n{k % 50}", "en", "hot" if k % 5 else f"s{k % 35}", 6) for k in range(900)]
    write(spark, folder, rows)
    assert rows_of(queries.op11_merkle_manifest(spark, folder)) == brute_manifest(rows)


def test_positions_of_equal_rows_over_many_ranges(spark):
    rows = spark.range(5000, numPartitions=6).select(
        F.lit("=t").alias("tree"), F.lit(1).alias("key"), F.lit("h").alias("hash"), F.lit(0).alias("item")
    )
    at = merkle.placed(rows, ["key", "hash"]).select("pos", "n").collect()
    assert sorted(r.pos for r in at) == list(range(5000)) and {r.n for r in at} == {5000}


# Fill-in-the-middle


def brute_fim(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or SENTINEL.search(text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(output), sha(text)


def test_fill_in_middle(spark, odd, empty):
    for folder in (SF, odd, empty):
        expected = sorted((brute_fim(r[0], r[1]) for r in given(spark, folder)), key=repr)
        assert rows_of(queries.op12_fill_in_middle(spark, folder)) == expected


def test_fill_in_middle_over_short_stretches(monkeypatch):
    """Stretches and blocks of a few bytes cut through characters, sentinels and empty parts."""
    monkeypatch.setattr(fim, "STRETCH", 7)
    monkeypatch.setattr(fim, "BLOCK", 5)
    rnd = random.Random(5)
    alphabet = ["a", "B", "zz", "é", "漢", "😀", "<", "S", ">", "P", "M", " ", "\n"]
    for _ in range(600):
        texts = ["".join(rnd.choices(alphabet, k=rnd.choice([0, 1, 2, 5, 20]))) for _ in range(rnd.randint(1, 6))]
        forms = [rnd.choice(["plain", "psm", "spm"]) if t and not SENTINEL.search(t) else "plain" for t in texts]
        one, two = (np.array([rnd.getrandbits(32) for _ in texts]) for _ in range(2))
        column = pa.array(["before", *texts], pa.string()).slice(1)
        output, units, _ = fim.rearranged(column, forms, one, two)
        for text, form, made, n, a, b in zip(texts, forms, output.to_pylist(), units, one, two, strict=True):
            words = UNIT.findall(text)
            low, high = sorted((int(a) % (len(words) + 1), int(b) % (len(words) + 1)))
            p, m, s = "".join(words[:low]), "".join(words[low:high]), "".join(words[high:])
            wanted = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}
            assert (made, n) == (wanted[form], len(words))
        assert fim.restored(output, forms).to_pylist() == texts


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_fill_in_middle"])
def test_sql_of_odd_rows(spark, odd, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    frame = queries.QUERIES[name](spark, odd)
    columns = ", ".join(frame.columns)
    expected = connection.execute(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall()
    assert rows_of(frame) == sorted(expected, key=repr)


# Languages


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    small = langid.Network.fresh(["a", "b", "c"], rng, 3)
    network = langid.Network(
        small.languages,
        *([w.astype(float) for w in part] for part in (small.bytes_, small.states)),
        small.labels.astype(float),
        small.shift.astype(float),
    )
    x, inside = langid.pieces_of([b"hello there", b"abc", b"xyz hello"])
    x, inside, truth = x[:12], inside[:12].astype(float), np.array([0, 1, 2])
    _, slopes = network.gradients(x, inside, truth)
    for weights, slope in zip(network.arrays(), slopes, strict=True):
        for _ in range(12):
            at = tuple(int(rng.integers(0, s)) for s in weights.shape)
            if weights.shape[-1] == 256:
                at = (at[0], int(rng.choice(x[inside > 0])))
            old, losses = weights[at], []
            for moved in (1e-5, -1e-5):
                weights[at] = old + moved
                losses.append(network.gradients(x, inside, truth)[0])
            weights[at] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - slope[at]) < 1e-6 + 1e-4 * abs(slope[at])


def test_every_byte_counts_whatever_the_batch(monkeypatch):
    network = langid.Network.fresh(["a", "b"], np.random.default_rng(3))
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("abc déß", k=n)) for n in (0, 1, 63, 64, 65, 200, 1000)]
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", 4)
    together = langid.labelled(network, pa.array([None, *texts]).slice(1))
    for text, found in zip(texts, together, strict=True):
        data, sums = text.encode(), np.zeros(2)
        for k in range(0, len(data), langid.PIECE):
            x, inside = langid.pieces_of([data[k : k + langid.PIECE]])
            sums += network.piece_sums(x, inside)[0]
        assert np.allclose(found, sums / max(1, len(data)), atol=1e-5)


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", F.length("text").alias("size"))
    found = queries.op13_language(spark, folder)
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_languages_of_odd_rows(spark, odd, empty):
    rows = {(r.doc_id, r.held_out): r for r in queries.op13_language(spark, odd).collect()}
    texts = {row[0]: row[1] for row in ODD_ROWS}
    learned = {
        row[2] for row in ODD_ROWS
        if row[2] and re.search(r"[^\W\d_]", row[1] or "") and zlib.crc32(str(row[0]).encode()) % 3 != 1
    }
    for (doc_id, held_out), row in rows.items():
        assert held_out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1)
        if re.search(r"[^\W\d_]", texts[doc_id] or ""):
            assert row.lang_pred in learned
        else:
            assert (row.lang_pred, row.score) == ("und", 0.0)
    assert queries.op13_language(spark, odd).count() == len(ODD_ROWS)
    assert queries.op13_language(spark, empty).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(0, "some words", None), (1, None, "en")], "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.train(docs)).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * 2
    one = spark.createDataFrame([(k, "some words", "en") for k in range(6)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(one, langid.train(one)).collect()} == {("en", 1.0)}
