"""Byte-pair encoding and decoding of texts with a public byte-level vocabulary.

Frequent words of the corpus are compiled into a minimal acyclic automaton that gives their
ids; all other words are merged pair by pair. The automaton only saves time: any set of words
gives the same ids.

Defined results: a null text is an empty one, without ids; ids outside the vocabulary and null
lists decode to nothing; rows are kept one by one, repeated ones too; other columns are dropped.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import map_arrow
from offerlake.llm.lexicon import Lexicon, compile_lexicon
from offerlake.session import discard, materialize

#: Fixed: the pattern byte-level vocabularies of this kind split words by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 40_000
LEXICON_BYTES = 24
#: Words a Python worker remembers beside the automaton.
MEMO_WORDS = 250_000
#: Distinct words that a task counts before it hands its counts over.
COUNTED_WORDS = 100_000

#: Words of a task that are turned into ids at a time, and characters from which the words of a
#: text come in several lists.
PUT_TOGETHER, LONG_TEXT = 1 << 17, 1 << 20
#: Words or tokens whose ids or bytes are put together at a time.
GATHERED = 1 << 17
#: Widths in bytes of words that are merged side by side; longer ones go alone.
MERGED_TOGETHER = (4, 8, 12, 16, 24, 40)
NO_MERGE, ID_MASK = 1 << 62, (1 << 20) - 1


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special texts of one tokenizer file (its content as text)."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        letters = byte_letters()
        self.content = content
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in names.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.byte_ids[b[0]] = i
        # Both ids of a pair in one number; rank and new id in another, so that the smaller
        # number is the merge that comes first.
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = names[left] << 20 | names[right]
            self.merges[key] = rank << 20 | names[left + right]

        self.byte_table = np.array(self.byte_ids, np.int64)
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.best = np.array([self.merges[p] for p in self.pairs.tolist()], np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What ``merges`` has of pairs of ids; an id below 0 is none."""
        pairs = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        known = (self.pairs[at] == pairs) & (left >= 0) & (right >= 0)
        return np.where(known, self.best[at], NO_MERGE)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``merge`` of many words, one step of all words of like length at a time.

        Gives the words' places in the order they were merged in, how many ids each has, and
        all ids side by side.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        none = np.zeros(0, np.int64)
        order, counts, ids, low = [none], [none], [none], -1
        for width in MERGED_TOGETHER:
            group = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                rows = self._merge_rows([words[k] for k in part.tolist()], sizes[part], width)
                order.append(part)
                counts.append((rows >= 0).sum(1))
                ids.append(rows[rows >= 0])
        for k in np.flatnonzero(sizes > low).tolist():
            own = self.merge(words[k])
            order.append(np.array([k], np.int64))
            counts.append(np.array([len(own)], np.int64))
            ids.append(np.array(own, np.int64))
        return np.concatenate(order), np.concatenate(counts), np.concatenate(ids)

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
        """A row of ids a word, those in use first, then -1."""
        raw = b"".join([w.ljust(width, b"\0") for w in words])
        ids = self.byte_table[np.frombuffer(raw, np.uint8)].reshape(-1, width)
        columns = np.arange(width)
        ids = np.where(columns < sizes[:, None], ids, -1)
        done = np.full((len(ids), width), -1, np.int64)
        found = np.full((len(ids), width), NO_MERGE, np.int64)
        found[:, :-1] = self._found(ids[:, :-1], ids[:, 1:])
        which = np.arange(len(ids))
        while len(which):
            place = found.argmin(1)
            rows = np.arange(len(which))
            best = found[rows, place]
            ended = best == NO_MERGE
            if ended.any():
                done[which[ended]] = ids[ended]
                on = ~ended
                which, ids, found, place, best = (x[on] for x in (which, ids, found, place, best))
                rows = np.arange(len(which))
                if not len(which):
                    break
            # Everything behind the merged pair moves one to the left.
            moved = np.minimum(columns + (columns > place[:, None]), width - 1)
            ids, found = (np.take_along_axis(x, moved, 1) for x in (ids, found))
            ids[:, -1], found[:, -1] = -1, NO_MERGE
            ids[rows, place] = new = best & ID_MASK
            after = np.where(place + 1 < width, ids[rows, np.minimum(place + 1, width - 1)], -1)
            before = np.where(place > 0, ids[rows, place - 1], -1)
            found[rows, place] = self._found(new, after)
            inner = place > 0
            found[rows[inner], place[inner] - 1] = self._found(before[inner], new[inner])
        return done

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word: the lowest-ranked pair is merged first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        get = self.merges.get
        if len(ids) < 200:
            found = [get(x << 20 | y, NO_MERGE) for x, y in zip(ids, ids[1:], strict=False)]
            while found and (best := min(found)) < NO_MERGE:
                k = found.index(best)
                ids[k] = new = best & ID_MASK
                del ids[k + 1], found[k]
                if k:
                    found[k - 1] = get(ids[k - 1] << 20 | new, NO_MERGE)
                if k < len(found):
                    found[k] = get(new << 20 | ids[k + 1], NO_MERGE)
            return tuple(ids)
        # Long words: a queue of pairs and links between the tokens that are left.
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                pair = ids[k] << 20 | ids[after[k]]
                if (best := get(pair)) is not None:
                    heapq.heappush(queue, (best, k, pair))

        for k in range(n - 1):
            offer(k)
        while queue:
            best, k, pair = heapq.heappop(queue)
            if ids[k] < 0 or after[k] >= n or ids[k] << 20 | ids[after[k]] != pair:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = best & ID_MASK, -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return tuple(i for i in ids if i >= 0)


def basic_words(characters: str) -> str:
    """``WORDS`` for texts of ``characters``, which ascend, without classes by property.

    Letters come first, as they are the most; no two kinds of words begin alike but the last two.
    """

    def ranges(kind: str) -> str:
        codes = np.fromiter(map(ord, regex.findall(kind, characters)), np.int64)
        parts = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
        return "".join(f"\\u{part[0]:04x}-\\u{part[-1]:04x}" for part in parts)

    letters, digits, spaces = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    return (
        f" ?[{letters}]++|'(?:[stmd]|re|ve|ll)| ?[{digits}]++| ?[^{spaces}{letters}{digits}]++"
        f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


class Splitter:
    """Cuts a text into special texts (ids) and words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.words = regex.compile(WORDS)
        self.special = vocabulary.special
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))) if names else None
        # Letters and digits newer than this Python's Unicode tables: whether the tokenizers
        # library takes them as letters is asked from itself.
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        letters = regex.findall(r"[\p{L}\p{N}]", every)
        self.unsure = {c for c in letters if unicodedata.category(c) == "Cn"}
        self.old = re.compile(f"[\0-{chr(min(map(ord, self.unsure), default=0x110000) - 1)}]*")
        self.library = None
        # The same pattern with its classes written out, which Python's own engine matches faster.
        # It looks up characters of the basic plane in a table; texts with others go the old way.
        self.basic = re.compile("[\0-\uffff]*")
        self.basic_words = re.compile(basic_words(every[: 0x10000 - 0x800]))

    def pattern(self, text: str):
        return self.basic_words if self.basic.fullmatch(text) else self.words

    def pieces(self, text: str) -> list[str]:
        if self.old.fullmatch(text) or self.unsure.isdisjoint(text):
            return self.pattern(text).findall(text)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def lists(self, text: str):
        """The words of a text, those of a long one in several lists."""
        if len(text) <= LONG_TEXT or not self.unsure.isdisjoint(text):
            yield self.pieces(text)
            return
        words = (found.group() for found in self.pattern(text).finditer(text))
        while some := list(islice(words, PUT_TOGETHER)):
            yield some

    def parts(self, text: str):
        """Lists of words and, between them, ids of special texts."""
        at = 0
        if self.cut:
            for found in self.cut.finditer(text):
                if found.start() > at:
                    yield from self.lists(text[at : found.start()])
                yield self.special[found.group()]
                at = found.end()
        if at < len(text):
            yield from self.lists(text[at:] if at else text)


def gathered(
    values: np.ndarray, starts: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``values`` one after the other, and where each of them ends."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    for low in range(0, len(starts), GATHERED):
        size, end = sizes[low : low + GATHERED], ends[low : low + GATHERED]
        first = int(end[0] - size[0])
        at = np.repeat(starts[low : low + GATHERED] - (end - size - first), size)
        at += np.arange(len(at))
        out[first : first + len(at)] = values[at]
    return out, ends


def texts_of(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Strings from their bytes; what is no UTF-8 is replaced."""
    raw = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        len(bounds) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)],
    )
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


class TokenBytes:
    """Bytes of all ids side by side; the last entry stands for ids that there are not."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        every = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of, default=-1) + 2)]
        self.bytes = np.frombuffer(b"".join(every), np.uint8)
        self.sizes = np.array([len(x) for x in every], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes


class Memo:
    """Words a Python worker has met, numbered, and their ids side by side."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[str | int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def add(self, words: list[str | int], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def learn(self, words: list[str], lexicon: Lexicon) -> None:
        """The automaton's words get their ids from it, the others are merged."""
        raw = [w.encode() for w in words]
        known = lexicon.numbers(raw, LEXICON_BYTES)
        there = np.flatnonzero(known >= 0)
        starts, sizes = lexicon.spans(known[there])
        self.add([words[k] for k in there.tolist()], sizes, gathered(lexicon.all_ids, starts, sizes)[0])
        rest = np.flatnonzero(known < 0).tolist()
        order, sizes, ids = self.vocabulary.merge_all([raw[k] for k in rest])
        self.add([words[rest[k]] for k in order.tolist()], sizes, ids)

    def numbers(self, pieces: list[str | int], lexicon: Lexicon) -> np.ndarray:
        """Numbers of words and of the ids of special texts; new ones are learned first."""
        if len(self.number) > MEMO_WORDS:
            self.clear()
        found = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [pieces[k] for k in missing.tolist()]
            fresh = set(new)
            special = [x for x in fresh if isinstance(x, int)]
            self.add(special, np.ones(len(special), np.int64), np.array(special, np.int64))
            self.learn(list(fresh.difference(special)), lexicon)
            found[missing] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        return found


_kept: dict[str, object] = {}


def _once(kind: str, key: str, make):
    """One of each kind per Python worker; a new key replaces it."""
    if _kept.get(kind, (None,))[0] != key:
        _kept[kind] = (key, make())
    return _kept[kind][1]


def word_counts(docs: DataFrame, vocabulary_file: str, text_col: str = "text") -> DataFrame:
    """(word, count) over all texts, of words of up to ``LEXICON_BYTES`` bytes.

    A task counts on its own and hands over what it has whenever it holds ``COUNTED_WORDS``
    distinct words.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary_file)

    def run(batches):
        vocabulary = _once("vocabulary", content.value, lambda: Vocabulary(content.value))
        splitter = _once("splitter", content.value, lambda: Splitter(vocabulary))
        counts: Counter[str] = Counter()

        def hand_over():
            kept = [(raw, n) for w, n in counts.items() if len(raw := w.encode()) <= LEXICON_BYTES]
            counts.clear()
            return pa.RecordBatch.from_pydict(
                {
                    "word": pa.array([w for w, _ in kept], pa.binary()),
                    "count": pa.array([n for _, n in kept], pa.int64()),
                }
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in splitter.parts(text) if text else ():
                    if not isinstance(part, int):
                        counts.update(part)
                if len(counts) >= COUNTED_WORDS:
                    yield hand_over()
        yield hand_over()

    found = docs.select(text_col).mapInArrow(run, "word binary, count bigint")
    return found.groupBy("word").agg(F.sum("count").alias("count"))


def frequent_words(docs: DataFrame, vocabulary_file: str, text_col: str = "text") -> list[bytes]:
    """The ``LEXICON_WORDS`` most frequent words: what the automaton is to hold, at most."""
    counts = materialize(word_counts(docs, vocabulary_file, text_col), "word-counts")
    # At most 63 rows: how many words there are of each order of magnitude of two. Only words
    # of an order that can matter are ranked, so tasks do not send as many words each.
    size = F.floor(F.log2("count")).cast("int")
    orders = counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect()
    least, words = 0, 0
    for row in orders:
        least, words = row["size"], words + row["count"]
        if words >= LEXICON_WORDS:
            break
    top = counts.where(size >= least).orderBy(F.desc("count"), "word").limit(LEXICON_WORDS)
    found = [bytes(r.word) for r in top.select("word").collect()]
    discard(counts)
    return found


def build_lexicon(words: list[bytes], vocabulary_file: str) -> bytes:
    vocabulary = Vocabulary(vocabulary_file)
    return compile_lexicon({w: list(vocabulary.merge(w)) for w in words if w})


def ids_of(
    texts: list[str | None], splitter: Splitter, memo: Memo, lexicon: Lexicon
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts side by side, and the bounds of each text's ids in them."""
    pieces: list[str | int] = []
    marks: list[int] = []  # where texts end in ``pieces``
    parts, ends, done = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0

    def put_together():
        nonlocal done
        numbers = memo.numbers(pieces, lexicon)
        ids, piece_ends = gathered(memo.ids, memo.starts[numbers], memo.sizes[numbers])
        ends.append(done + np.concatenate([[0], piece_ends])[marks].astype(np.int64))
        parts.append(ids)
        done += len(ids)
        pieces.clear()
        marks.clear()

    for text in texts:
        for part in splitter.parts(text) if text else ():
            if isinstance(part, int):
                pieces.append(part)
            else:
                pieces += part
            if len(pieces) >= PUT_TOGETHER:
                put_together()
        marks.append(len(pieces))
    put_together()
    return np.concatenate(parts), np.concatenate(ends)


def _encoding(docs: DataFrame, vocabulary_file: str, lexicon: bytes, id_col: str):
    """A step from a batch (id, text) to one (id, ids)."""
    context = docs.sparkSession.sparkContext
    content, block = context.broadcast(vocabulary_file), context.broadcast(lexicon)

    def step(batch):
        vocabulary = _once("vocabulary", content.value, lambda: Vocabulary(content.value))
        splitter = _once("splitter", content.value, lambda: Splitter(vocabulary))
        known = _once("lexicon", block.value, lambda: Lexicon(block.value))
        memo = _once("memo", content.value, lambda: Memo(vocabulary))
        ids, offsets = ids_of(batch.column(1).to_pylist(), splitter, memo, known)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return step


def _decoding(docs: DataFrame, vocabulary_file: str, id_col: str):
    """A step from a batch (id, ids) to one (id, ids, decoded)."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary_file)

    def step(batch):
        vocabulary = _once("vocabulary", content.value, lambda: Vocabulary(content.value))
        table = _once("table", content.value, lambda: TokenBytes(vocabulary))
        ids = batch.column(1)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0))]).astype(np.int64)
        flat = pc.fill_null(ids.flatten(), -1).to_numpy().astype(np.int64)
        known = np.where((flat >= 0) & (flat < len(table.sizes) - 1), flat, len(table.sizes) - 1)
        data, byte_ends = gathered(table.bytes, table.starts[known], table.sizes[known])
        bounds = np.concatenate([[0], byte_ends])[ends]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), ids, texts_of(data, bounds)], names=[id_col, "ids", "decoded"]
        )

    return step


def encode(
    docs: DataFrame,
    vocabulary_file: str,
    lexicon: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, ids array<int>) of every row; ``lexicon`` as ``build_lexicon`` gives it."""
    kind = docs.schema[id_col].dataType.simpleString()
    step = _encoding(docs, vocabulary_file, lexicon, id_col)
    return map_arrow(docs.select(id_col, text_col), step, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary_file: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): bytes of the ids put together and read as UTF-8.

    Bytes that are no UTF-8 become U+FFFD, as other lists of ids than a text's may give.
    """
    kind = encoded.schema[id_col].dataType.simpleString()
    step = _decoding(encoded, vocabulary_file, id_col)
    schema = f"`{id_col}` {kind}, ids array<int>, decoded string"
    return map_arrow(encoded.select(id_col, "ids"), step, schema)


def round_trip(
    docs: DataFrame,
    vocabulary_file: str,
    lexicon: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``decode`` of ``encode`` in one Python worker, which needs the vocabulary once."""
    kind = docs.schema[id_col].dataType.simpleString()
    encoding = _encoding(docs, vocabulary_file, lexicon, id_col)
    decoding = _decoding(docs, vocabulary_file, id_col)

    def step(batch):
        for encoded in encoding(batch):
            yield from decoding(encoded)

    schema = f"`{id_col}` {kind}, ids array<int>, decoded string"
    return map_arrow(docs.select(id_col, text_col), step, schema)


def tokenizer_file(path: str | None = None) -> str:
    """Content of a tokenizer file; without a path, the installed byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()
