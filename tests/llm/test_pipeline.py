"""Line dedup and the pipeline against plain Python."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from offerlake.llm import lines, queries, toxicity
from test_near import brute_fingerprint, roots
from test_scans import brute_contamination

SF = "/root/testdata/sf0.001"


def shingle_set(line):
    return {line[k : k + 9] for k in range(max(1, len(line) - 8))}


def brute_lines(rows):
    """Texts that are left of (id, text) rows with distinct ids, by all pairs of lines."""
    places = []
    for i, text in sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0])):
        for k, line in enumerate(text.split("\n")):
            line = line.strip().lower()
            if any(c.isalnum() for c in line):
                places.append((i, k, line))
    distinct = sorted({p[2] for p in places})
    sets = [shingle_set(x) for x in distinct]
    pairs = []
    for a in range(len(distinct)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
                common = len(x & y)
                if common >= 0.8 * (len(x) + len(y) - common):
                    pairs.append((a, b))
    root = dict(zip(distinct, roots(len(distinct), pairs), strict=True))
    seen, gone = set(), set()
    for i, k, line in places:
        if root[line] in seen:
            gone.add((i, k))
        seen.add(root[line])
    return [
        (i, t if not t else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone))
        for i, t in rows
    ]


def test_lines_of_tangled_texts(spark):
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("tor", "mel", "zug", "pin", "rad", "kos") for b in ("alin", "umbo", "etki", "osva")]

    def line(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    bases = [line(40) for _ in range(25)]
    rows = []
    for k in range(120):
        text = [line(rnd.randrange(1, 30)) for _ in range(rnd.randrange(3))]
        for _ in range(rnd.randrange(4)):
            changed = rnd.choice(bases).split()
            if rnd.random() < 0.5:
                changed[rnd.randrange(40)] = "changed"
            text.append(rnd.choice(["", " "]) + " ".join(changed))
        rows.append((k, "\n".join([*text, rnd.choice(["", "Short.", "***", "***", "short."])])))
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, bases[0]), (503, "x" * 60_000), (504, "x" * 60_000)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, mark string")
    got = {(r.doc_id, r.text, r.mark) for r in lines.keep_one_of_each(frame.repartition(4)).collect()}
    expected = {(*r, "m") for r in brute_lines(rows)}
    assert len(got ^ expected) <= 2, got ^ expected  # a pair may share no band


def test_line_query(spark, tmp_path):
    rnd = random.Random(8)
    bases = ["".join(rnd.choices("abcdefgh ", k=80)) for _ in range(12)]
    rows = []
    for k in range(60):
        text = [rnd.choice(["", " "]) + rnd.choice(bases) + rnd.choice(["", "", "x"]) for _ in range(rnd.randrange(6))]
        rows.append((k, "\n".join([*text, f"own line {k} " * 9, "***"])))
    rows += [(100, None), (101, ""), (102, "\n"), (None, bases[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for (i, text), (_, kept) in zip(sorted(rows, key=str), sorted(brute_lines(rows), key=lambda r: str((r[0],))), strict=True):
        assert i == _
        n, left = (len(t.split("\n")) if t else 0 for t in (text, kept))
        # A text without any line left has one fewer than its parts say.
        gone = n if text and not kept and n - left == n - 1 and text.strip() else n - left
        expected.append((i, n, gone, hashlib.sha256((kept or "").encode()).hexdigest()))
    got = [tuple(r) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_repeated_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "one line\none line")] * 2, "doc_id long, text string")
    assert [r.text for r in lines.keep_one_of_each(frame).collect()] == ["one line"] * 2
    assert lines.keep_one_of_each(frame.limit(0)).count() == 0
    found = lines.without_repeated_lines(frame).collect()
    assert [(r.n_lines, r.n_removed) for r in found] == [(2, 1)] * 2


def test_band_keys_have_the_promised_recall():
    rnd = random.Random(5)
    met = total = 0
    for _ in range(300):
        line = "".join(rnd.choice("abcdefgh ijklmnop") for _ in range(rnd.randrange(40, 300)))
        other = list(line)
        for _ in range(rnd.randrange(1, 4)):
            other[rnd.randrange(len(other))] = "z"
        other = "".join(other)
        if lines.similarity(line, other) >= 0.8:
            total += 1
            keys = lines.band_keys([line, other])
            met += bool(set(keys[0].tolist()) & set(keys[1].tolist()))
    assert total > 100 and met >= 0.98 * total


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], SF).write.parquet(f"{folder}/{k}")
        found.append(spark.read.parquet(f"{folder}/{k}"))
    return found


def pairs_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("block", [2000, 3])
def test_short_lines_of_one_bucket_are_all_compared(spark, monkeypatch, block):
    """Every pair that shares a bucket and is similar is in one component, also where few
    shingles leave most bins empty, and where a bucket is dealt out in blocks."""
    monkeypatch.setattr(lines, "BUCKET_BLOCK", block)
    rnd = random.Random(12)
    texts = set()
    for _ in range(250):
        base = "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(14, 22)))
        texts |= {base, base + "y", "z" + base, base[2:], base[:-2], base[3:] + "q", "q" + base[:-3]}
    texts = sorted(texts)
    buckets = {}
    for k, keys in enumerate(lines.band_keys(texts).tolist()):
        for key in keys:
            buckets.setdefault(key, set()).add(k)
    pairs = {(a, b) for members in buckets.values() for a in members for b in members if a < b}
    links = [(a, b) for a, b in pairs if lines.similarity(texts[a], texts[b]) >= 0.8]
    root = roots(len(texts), links)
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    docs = frame.selectExpr("doc_id id", "xxhash64(text) mark", "text")
    found = {r.line: r.component for r in lines.line_components(docs).collect()}
    key_of = [int(lines.signed(np.array([lines.line_key(x)], np.uint64))[0]) for x in texts]
    assert {(a, b) for a, b in links if found[key_of[a]] != found[key_of[b]]} == set()
    mine = [found.get(key, key) for key in key_of]
    assert len(set(zip(mine, root, strict=True))) == len(set(mine)) == len(set(root))


def test_links_of_a_bucket_are_a_forest(spark):
    """A bucket of lines that are all alike sends one link for each, not one for each pair."""
    base = " ".join(f"word{k}" for k in range(40))
    texts = [f"{base} {k:03d}" for k in range(150)] + [f"{k:03d} {base[::-1]}" for k in range(50)]
    placed = [(k, k, [7], text, 7, parts) for parts in (1, 2) for k, text in enumerate(texts)]
    columns = "line long, component long, keys array<long>, text string, key long, parts int"
    for parts in (1, 2):
        rows = spark.createDataFrame([r for r in placed if r[-1] == parts], columns)
        found = lines.crossing_links(lines.with_counts(rows)).collect()
        assert len(found) < parts * (parts + 1) // 2 * len(texts)
        assert roots(len(texts), [(r.a, r.b) for r in found]) == [0] * 150 + [150] * 50


def test_keys_of_lines_travel_in_blocks(spark):
    """A batch sends one row for each cell of keys, not one for each key, and none is lost."""
    texts = [f"line number {k} of {k * k}" for k in range(600)]
    docs = spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")
    found = lines.bands_of(docs).collect()
    assert len({r.cell for r in found}) == len(found) < len(texts) * lines.BANDS / 2
    got = []
    for r in found:
        keys, own = (np.frombuffer(x, np.uint64) for x in (r["keys"], r["lines"]))
        assert set((keys % np.uint64(lines.KEY_CELLS)).tolist()) == {r.cell}
        got += zip(keys.tolist(), own.tolist(), strict=True)
    keys = lines.band_keys(texts).tolist()
    wanted = [(key, lines.line_key(x)) for x, row in zip(texts, keys, strict=True) for key in row]
    assert sorted(got) == sorted(wanted)


def test_counts_bound_what_lines_have_in_common():
    rnd = random.Random(3)
    for size in (1, 8, 30, 2000, 60_000):
        one = "".join(rnd.choice("abcdefgh") for _ in range(size))
        two = one[: size // 2] + "-" + one[size // 2 :]
        (x, n), (y, m) = map(lines.shingle_counts, (one, two))
        assert (n, m) == (len(shingle_set(one)), len(shingle_set(two)))
        beyond = min(n - int(x.sum(dtype=int)), m - int(y.sum(dtype=int)))
        assert np.minimum(x, y).sum(dtype=int) + beyond >= len(shingle_set(one) & shingle_set(two))


def test_stages_keep_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert all(r.n_chars == len(r.text) for r in df.collect() if r.text is not None)


def test_toxic_documents_go(spark, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(stages[0], model).collect()}
    assert pairs_of(stages[1]) == [p for p in pairs_of(stages[0]) if scores[p[0]] < 0.3]
    assert 0 < stages[1].count() < stages[0].count()


def test_repeated_lines_go(stages):
    expected = sorted(brute_lines(pairs_of(stages[1])))
    got = pairs_of(stages[2])
    assert sum(a != b for a, b in zip(got, expected, strict=True)) <= 1
    assert got != pairs_of(stages[1])


def test_near_copies_go(stages):
    rows = pairs_of(stages[2])
    fps = [brute_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = roots(len(rows), links)
    assert pairs_of(stages[3]) == [r for k, r in enumerate(rows) if root[k] == k]


def test_benchmark_passages_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = pairs_of(stages[3]), pairs_of(stages[4])
    hits = {r[0]: r for r in brute_contamination(before, items)}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert [d for d, _ in before] == [d for d, _ in after]
    for (doc, old), (_, new) in zip(before, after, strict=True):
        _, n_words, n_hit, *_ = hits[str(doc)]
        low = re.sub("[A-Z]", lambda m: m.group().lower(), new or "")
        assert n_hit > 0 or old == new
        assert abs(len(word.findall(low)) - (n_words - n_hit)) <= 0


def test_tokens_of_what_is_left(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for doc, text in pairs_of(stages[4]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text or "")]
        expected.append((doc, len(ids), *digests))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[5].collect())
    assert got == expected


def test_run_is_the_stages(spark, stages):
    assert "pipeline" not in queries.QUERIES
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stages[5].collect()))
