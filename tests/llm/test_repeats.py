"""Repeated bytes and words against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from offerlake.llm import queries, repeats, token_windows, windows
from offerlake.llm.suffixes import suffix_ranks

SF = "/root/testdata/sf0.001"


def brute_bytes(rows, window):
    raws = [(t or "").encode() for _, t in rows]
    counts = Counter(r[k : k + window] for r in raws for k in range(len(r) - window + 1))
    result = []
    for (i, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - window + 1):
            if counts[raw[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        result.append((str(i), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result)


def brute_words(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), words in zip(rows, split, strict=True):
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    result = []
    for (i, _), words in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and least[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        result.append((str(i), len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(result)


def got(df, *columns):
    return sorted((str(r.doc_id), *(r[c] for c in columns)) for r in df.collect())


BYTES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("n_words", "n_removed", "kept_sha256")


def tangled(seed):
    """Texts that share passages at all places, edges that differ, periods and odd rows."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(300)]

    def text(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    common = [text(rnd.choice([12, 13, 14, 40, 130, 200])) for _ in range(8)]
    rows = []
    for k in range(150):
        words = text(rnd.randrange(30))
        for _ in range(rnd.randrange(4)):
            passage = list(rnd.choice(common))
            if rnd.random() < 0.5:
                passage[rnd.randrange(len(passage))] = "changed"
            cut = rnd.randrange(4)
            words += passage[cut : len(passage) - rnd.randrange(4)] + text(rnd.randrange(5))
        rows.append((k, rnd.choice([" ", "  ", "\n"]).join(words)))
    rows += [(200 + k, "ab" * 400) for k in range(2)] + [(210, "a" * 900), (211, "x y " * 300), (212, "q" * 399)]
    rows += [(220, None), (221, ""), (None, rows[0][1]), (5, rows[5][1]), (5, rows[6][1]), (222, "periodic " * 200 + "end")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell_runs", [1000, 3])
def test_repeated_bytes_of_tangled_texts(spark, monkeypatch, tmp_path, cell_runs):
    monkeypatch.setattr(repeats, "CELL_RUNS", cell_runs)
    rows = tangled(cell_runs)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, mark int")
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op6_repeated_bytes(spark, str(tmp_path)), *BYTES) == brute_bytes(rows, 400)


def test_repeated_words_of_tangled_texts(spark, tmp_path):
    rows = tangled(9)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, mark int")
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op7_repeated_words(spark, str(tmp_path)), *WORDS) == brute_words(rows, 13)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute_words(rows, 13)
    assert got(queries.op7_repeated_words(spark, SF), *WORDS) == expected
    assert any(r[2] for r in expected)
    expected = brute_bytes(rows, 400)
    assert got(queries.op6_repeated_bytes(spark, SF), *BYTES) == expected
    assert any(r[2] for r in expected)


def test_tables_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op6_repeated_bytes(spark, str(tmp_path)).count() == 0
    assert queries.op7_repeated_words(spark, str(tmp_path)).count() == 0


def test_suffix_order():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        text = rnd.integers(0, 3, n)
        order = np.argsort(suffix_ranks(text))
        assert order.tolist() == sorted(range(n), key=lambda k: text[k:].tolist())


def test_matching_statistics():
    rnd = random.Random(1)
    base = bytes(rnd.choice(b"abc") for _ in range(150))
    passages = [base, base[20:120], b"z" + base[50:], bytes(rnd.choice(b"ab") for _ in range(90))]
    text = np.frombuffer(b"".join(p + b"\xff" for p in passages), np.uint8)
    index = repeats.RunIndex(text)
    assert index.lengths.sum() == len(text) and len(index.heads) < len(text)
    smaller, larger = index.matching_statistics()
    raw = text.tobytes()
    for k in range(len(raw)):
        longest = 0
        while k + longest < len(raw):
            piece = raw[k : k + longest + 1]
            first = raw.find(piece)
            if first == k and raw.find(piece, k + 1) < 0:
                break
            longest += 1
        assert max(smaller[k], larger[k]) == longest


def test_runs_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(windows, "PIECE", 50)
    symbols = np.random.default_rng(2).integers(0, 5, 333)
    starts, counts, anchors, _ = windows.anchored_runs(symbols, 20, 4)
    assert starts.tolist() == [0, *np.cumsum(counts)[:-1]] and counts.sum() == 333 - 19
    by_words = {}
    for a, n, h in zip(starts, counts, anchors, strict=True):
        for k in range(a, a + n):
            assert by_words.setdefault(tuple(symbols[k : k + 20]), h) == h


def test_edges_of_short_windows(spark):
    rows = [(k, " ".join(random.Random(k).choice("ab") for _ in range(25))) for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = token_windows.without_seen(frame, window=6)
    expected = brute_words(rows, 6)
    result = sorted(
        (str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept.encode()).hexdigest())
        for r in found.collect()
    )
    assert result == expected
