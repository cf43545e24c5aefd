"""Licence scans, secret scans, decontamination and tokens against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import bpe, decontaminate, licenses, queries, secrets
from offerlake.llm.fm_index import FMIndex

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


ODD_TEXTS = [
    (1, None, "x"),
    (2, "", "x"),
    (3, "MIT License and the Apache  License; mit LICENSE", "x"),
    (3, "MIT License and the Apache  License; mit LICENSE", "x"),
    (4, "é " * 50_000 + "GNU General Public License", "x"),
    (None, "no id, general-public-license", None),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    # The extra columns bear names that the operators give to their own results.
    rows = [(i, t, s, "n", 1) for i, t, s in ODD_TEXTS]
    write(spark, folder, "documents", rows, "doc_id long, text string, spans string, ids string, n_words int")
    write(spark, folder, "benchmark", [], "item_id long, text string")
    return folder


def phrase_places(text):
    words = WORD.findall(ascii_lower(text))
    places = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        places += [
            (label, i) for i in range(len(words)) if words[i : i + len(parts)] == parts
        ]
    return len(words), places


@pytest.mark.parametrize("where", ["given", "odd"])
def test_license_phrases(spark, odd, where):
    folder = SF if where == "given" else odd
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(
        (
            str(r.doc_id),
            n,
            len(p),
            str(min((i for _, i in p), default=None)),
            str(max((i for _, i in p), default=None)),
            ",".join(sorted({label for label, _ in p})),
        )
        for r in texts
        for n, p in [phrase_places(r.text)]
    )
    rows = queries.op1_license_scan(spark, folder).collect()
    got = sorted(
        (str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels)
        for r in rows
    )
    assert got == expected
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_wording_with_changes():
    scanner = licenses.Automaton.of(licenses.PHRASES, licenses.TEMPLATES)
    words = WORD.findall(ascii_lower(dict(licenses.TEMPLATES[:1])["mit"]))
    words[20] = "changed"
    del words[40:43]
    text = ["some", "code", *words, "more"]
    _, spans = scanner.scan([w.encode() for w in text])
    label, start, end, coverage = max(spans, key=lambda s: s[3])
    assert (label, start, end) == ("mit", 2, len(text) - 1)
    assert 0.9 < coverage < 1


def brute_secrets(text):
    """Patterns as the contract states them: match first, drop afterwards."""
    key = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = rf"({key}|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m.group(2)) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secret_patterns():
    rnd = random.Random(3)
    parts = ["password", "API_KEY", "token", "Secret", ":", "=", " ", "'", '"', "AKIA", "abc", "é",
             "ſecret", "0123456789abcdef", "QWERTYUIOP12345", "deadbeef", "\n", "/x.y=", "api"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        got = [x[:3] for x in secrets.find_secrets(text) if x[0] != "guess"]
        assert got == brute_secrets(text), text


def test_secret_query(spark, odd):
    for folder in (SF, odd):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        expected = sorted(
            (str(r.doc_id), sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute_secrets(r.text or ""))))
            for r in texts
        )
        rows = queries.op3_secret_scan(spark, folder).collect()
        assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == expected


def test_guess_cost_orders_values():
    cheap = ["password", "P4ssword1", "qwertyuiop", "aaaaaaaaaaaa", "abcdefgh", "19991231", "summer2019"]
    dear = ["x7Kq!9vLp2", "zj3kq8wv1m", "Tr0ub4dor&3xq"]
    assert max(map(secrets.guess_cost, cheap)) < secrets.MIN_COST
    assert min(map(secrets.guess_cost, dear)) > secrets.MIN_COST
    assert secrets.guess_cost("ab" * 100_000) > 0


def piece_cost(value, start, end):
    """The cheapest single piece that is this part of the value, infinite if there is none."""
    part, size = value[start:end], end - start
    low = part.lower()
    capitals = sum(a != b for a, b in zip(part, low, strict=True))
    costs = [sum(map(secrets._alphabet, low)) + secrets.UPPER * capitals]
    for text, more in ((low, 0), (low.translate(secrets.LEET), secrets.LEETED)):
        if size >= 3 and text in secrets.WORDS:
            costs.append(secrets.WORDS[text] + more + secrets.UPPER * min(2, capitals))
    if size >= 3:
        jumps = {ord(b) - ord(a) for a, b in zip(low, low[1:], strict=False)}
        run = secrets.THREE + secrets.LONGER * (size - 3)
        if jumps == {0}:
            costs.append(secrets._alphabet(low[0]) + run)
        if jumps in ({1}, {-1}):
            costs.append(secrets.RUN + run)
        if all(b in secrets.NEAR.get(a, ()) for a, b in zip(low, low[1:], strict=False)):
            costs.append(secrets.WALK + secrets.KEY * size)
    if secrets.DATE.fullmatch(part):
        costs.append(secrets.DATES)
    return min(costs)


def exhaustive_cost(value):
    """The minimum over all ways to cut the value, by all pairs of places."""
    best = [0.0] + [float("inf")] * len(value)
    for end in range(1, len(value) + 1):
        for start in range(end):
            more = secrets.PIECE if start else 0
            best[end] = min(best[end], best[start] + more + piece_cost(value, start, end))
    return best[-1]


def test_guess_cost_is_the_cheapest_cut():
    """Pieces that overlap: runs that go on into words, dates and walks."""
    rnd = random.Random(5)
    parts = ["a", "b", "s", "l", "1", "2", "9", "A", "@", "admin", "secret", "love", "pass", "2019", "qwe", "abc", "zyx"]
    values = ["".join(rnd.choices(parts, k=rnd.randint(1, 9))) for _ in range(600)]
    values += ["".join(rnd.choices("aAbs", k=rnd.randint(1, 14))) for _ in range(300)]
    values += ["aaaadmin", "sssssecret", "lllllove", "20191231", "1.2.2019", "qwertyyyuiop", "ab" * 20]
    for value in values:
        assert abs(secrets.guess_cost(value) - exhaustive_cost(value)) < 1e-9, value
    assert secrets.guess_cost("sssssecret") < secrets.MIN_COST
    # A letter whose lower case has two.
    assert secrets.guess_cost("\u0130x") > 0


def test_values_a_span_only_touches_are_scored_whole():
    spans = secrets.find_secrets("secret=Xy!0123456789abcdef0123-zz")
    assert [s[:3] for s in spans] == [("guess", 7, 33), ("hex", 10, 30)]
    inside = secrets.find_secrets("token=0123456789abcdef0123 and password: q7Zp+x9LmW2vK4==")
    assert [s[0] for s in inside] == ["assign", "hex", "assign"]


def test_guesses_are_added_and_common_words_are_not():
    spans = secrets.find_secrets("pwd: x7Kq!9vL2z and password=sunshine and secret: love")
    assert [s[0] for s in spans] == ["guess"]


def brute_contamination(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = WORD.findall(ascii_lower(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    result = []
    for doc, text in docs:
        words = WORD.findall(ascii_lower(text))
        hit, names = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                owners = windows.get(tuple(words[i : i + size]))
                if owners is not None:
                    hit.update(range(i, i + size))
                    names |= {str(o) for o in owners if o is not None}
        result.append((str(doc), len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return sorted(result)


def contamination_rows(df):
    return sorted(
        (str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
        for r in df.collect()
    )


def test_decontamination_of_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    expected = brute_contamination(docs, items)
    assert any(r[-1] for r in expected)
    assert contamination_rows(queries.op4_decontaminate(spark, SF)) == expected


@pytest.mark.parametrize("block_words", [10_000, 30])
def test_decontamination_of_tangled_texts(spark, block_words):
    rnd = random.Random(7)

    def text(n):
        return " ".join(rnd.choice("ab") for _ in range(n))

    items = [(k, text(rnd.choice([3, 9, 10, 11, 16]))) for k in range(12)]
    items += [(None, text(10)), (50, None), (51, ""), (52, "a"), (3, text(12))]
    docs = [(k, f"{text(rnd.randrange(60))} C {text(30)}") for k in range(80)]
    docs += [(None, "a b"), (100, None), (101, ""), (7, "a a a"), (7, "a a a")]
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        block_words=block_words,
    )
    rows = [
        (str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]),
         sha(",".join(sorted(r["items"]))), bool(r.spans))
        for r in found.collect()
    ]
    assert sorted(rows) == brute_contamination(docs, items)


def test_decontamination_without_items_and_cut_texts(spark, odd):
    rows = queries.op4_decontaminate(spark, odd).collect()
    assert len(rows) == len(ODD_TEXTS) and not any(r.contaminated for r in rows)
    words = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"Keep, this. {words.upper()}! And this.", 5), (2, "é", 6)], "doc_id long, text string, spans int")
    bench = spark.createDataFrame([(1, words)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.spans) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: ("Keep, this. ! And this.", 5), 2: ("é", 6)}


def test_fm_index_finds_every_place():
    import numpy as np

    rnd = np.random.default_rng(1)
    for _ in range(30):
        text = rnd.integers(0, 4, 200)
        text[-1] = 0
        index = FMIndex(text, 3)
        for pattern in ([1], [2, 1], [3, 3, 1], [1, 2, 3, 1]):
            low, high = index.search(np.array([pattern]), np.array([len(pattern)]))
            places = sorted(index.locate(np.arange(low[0], high[0])))
            expected = [i for i in range(200) if list(text[i : i + len(pattern)]) == pattern]
            assert places == expected


def test_bpe_is_the_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for folder in (SF, odd):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        expected = []
        for r in texts:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            expected.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids))), sha(decoded)))
        rows = queries.op5_bpe(spark, folder).collect()
        got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows]
        assert sorted(got) == sorted(expected)


def test_bpe_of_any_characters():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    vocabulary = bpe.Vocabulary(bpe.tokenizer_file())
    splitter = bpe.Splitter(vocabulary)
    rnd = random.Random(1)

    def char():
        return chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(32, 0x900), rnd.randrange(0xE000, 0x110000)]))

    texts = ["a" * 900, "abcde" * 300, "<|endoftext|> x<|endoftext|>", "it's  \n\n x", "\x1c \x85a", "՘a"]
    texts += ["".join(char() for _ in range(rnd.randrange(120))) for _ in range(1500)]
    for text in texts:
        ids = []
        for part in splitter.parts(text):
            ids += [part] if isinstance(part, int) else [i for w in part for i in vocabulary.merge(w.encode())]
        assert ids == library.encode(text, add_special_tokens=False).ids
    words = [w.encode() for t in texts for part in splitter.parts(t) if not isinstance(part, int) for w in part]
    order, sizes, ids = vocabulary.merge_all(words)
    ends = np.cumsum(sizes).tolist()
    merged = {k: tuple(ids[end - n : end].tolist()) for k, n, end in zip(order.tolist(), sizes.tolist(), ends, strict=True)}
    assert merged == {k: vocabulary.merge(w) for k, w in enumerate(words)}


def test_bpe_a_few_words_at_a_time(monkeypatch):
    """The memo is forgotten, texts end, and long texts go on, in the middle of a batch."""
    for name, value in (("PUT_TOGETHER", 7), ("LONG_TEXT", 40), ("GATHERED", 3), ("MEMO_WORDS", 20)):
        monkeypatch.setattr(bpe, name, value)
    file = bpe.tokenizer_file()
    vocabulary = bpe.Vocabulary(file)
    splitter, memo = bpe.Splitter(vocabulary), bpe.Memo(vocabulary)
    lexicon = bpe.Lexicon(bpe.build_lexicon([b" the", b" gate", b"s"], file))
    rnd = random.Random(9)
    words = [" the", " gate", "s", " unseen", "<|endoftext|>", "\n", " é漢", " 12"]
    texts = [None, "", *("".join(rnd.choices(words, k=rnd.randrange(60))) for _ in range(80)), ""]
    for _ in range(2):
        ids, bounds = bpe.ids_of(texts, splitter, memo, lexicon)
        assert len(bounds) == len(texts) + 1
        for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
            wanted = []
            for part in splitter.parts(text or ""):
                wanted += [part] if isinstance(part, int) else [i for w in part for i in vocabulary.merge(w.encode())]
            assert ids[a:b].tolist() == wanted
    table = bpe.TokenBytes(vocabulary)
    data, ends = bpe.gathered(table.bytes, table.starts[ids], table.sizes[ids])
    assert data.tobytes().decode() == "".join(t or "" for t in texts)
    assert bpe.gathered(table.bytes, np.zeros(0, np.int64), np.zeros(0, np.int64))[0].size == 0


def test_decoding_any_ids(spark):
    rows = [(1, [15496, 50256, None, 99999, 222]), (2, None), (3, []), (4, [15496])]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(frame, bpe.tokenizer_file()).collect()}
    assert got == {1: "Hello<|endoftext|>\ufffd", 2: "", 3: "", 4: "Hello"}


def test_lexicon_holds_its_words_only():
    rnd = random.Random(2)
    words = {bytes(rnd.choices(b"abc\xc3", k=rnd.randrange(1, 9))): [rnd.randrange(9)] * rnd.randrange(1, 4) for _ in range(500)}
    known = bpe.Lexicon(bpe.compile_lexicon(words))
    for word, ids in words.items():
        assert known.get(word) == tuple(ids)
        assert known.get(word + b"z") is None
    assert known.get(b"zz") is None and known.get(b"") is None
    # Side by side, with words that are not there, too long, empty or the start of another.
    asked = [*words, b"", b"zz", b"a" * 30, *(w[:-1] for w in words), *(w + b"b" for w in words)]
    numbers = known.numbers(asked, 8)
    starts, sizes = known.spans(numbers[numbers >= 0])
    found = {w: known.all_ids[a : a + n].tolist() for w, a, n in zip([w for w, k in zip(asked, numbers, strict=True) if k >= 0], starts, sizes, strict=True)}
    assert found == {w: list(known.get(w)) for w in asked if len(w) <= 8 and known.get(w) is not None}
    assert bpe.Lexicon(bpe.compile_lexicon({})).numbers([b"a"], 8).tolist() == [-1]
    tails = bpe.compile_lexicon({p + b"common-ending": [1] for p in (b"a", b"b", b"c", b"d")})
    assert bpe.Lexicon(tails).states < 20


def test_words_of_the_basic_plane_are_cut_as_by_the_pattern():
    """The classes that are written out hold the same characters as those by property."""
    splitter = bpe.Splitter(bpe.Vocabulary(bpe.tokenizer_file()))
    rnd = random.Random(8)
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [x for c in every for x in (f"{c}a{c}1 {c}", f"a{c} '{c}s")]
    common = [" ", "  ", "\n", "'", "s", "'re", "'ll", "'v", "e", "7", "\x1c", "\x85", "\u3000"]
    texts += ["".join(rnd.choice([*common, rnd.choice(every)]) for _ in range(60)) for _ in range(2000)]
    for text in texts:
        assert splitter.pattern(text) is splitter.basic_words
        assert splitter.basic_words.findall(text) == splitter.words.findall(text)
    assert splitter.pattern("a \U0001f600 b") is splitter.words
