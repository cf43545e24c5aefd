"""Secret scans: fixed patterns, and values whose cheapest guess is dear.

A value that stands where credentials stand is cut into words, dates, repeats, sequences,
keyboard walks and spans of single characters so that guessing it piece by piece costs least;
dear values are secrets. Values that lie wholly inside a span of a pattern are reported once;
one that a span only touches is scored as a whole as well.

Defined results: a null or empty text has no spans; places count code points, ends are
exclusive; rows are scanned one by one and nothing is shuffled.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from offerlake.llm.common import map_arrow

KINDS = ("assign", "access", "hex", "guess")

# The patterns of the contract. Matches are cut off where a run ends, so a
# length in the pattern finds the same as dropping short runs afterwards; not so for
# assignments, where a short value uses up text.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("passw", "secret", "token", "api")

#: Where credentials stand; the value ends at white space, a quote, a bracket or a comma.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|auth|bearer|(?:api|access|private)"
    r"[_-]?key)[\"']?\x20*[:=]\x20*[\"']?([^\s\"'<>(),;]{6,})",
    re.IGNORECASE | re.ASCII,
)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")
#: Powers of ten of the guesses from which a value is a secret.
MIN_COST = 8.0

# Words that guessers try first, most frequent first.
COMMON = """password love admin welcome monkey dragon master sunshine princess football baseball
shadow michael letmein login hello freedom whatever trust superman batman charlie jordan secret
summer winter spring autumn flower ginger cookie pepper cheese banana orange purple silver golden
killer hunter soccer hockey yankee ranger tigger buster daniel thomas robert george joshua andrew
jessica ashley amanda nicole matrix merlin diamond computer internet server system access default
changeme example test user guest root pass word token value none null true false your here this
that with from the and for not are key api name string secretkey database production staging local
host public private account service client""".split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
WORDS = {w: math.log10(k + 2) for k, w in enumerate(COMMON)}
LONGEST_WORD = max(map(len, WORDS))
LEET = str.maketrans("@4301!$5+7", "aaeoiisstt")
DATE = re.compile(
    r"(?:19|20)\d\d[-/.]?[01]?\d[-/.]?[0-3]?\d|[0-3]?\d[-/.][01]?\d[-/.](?:19|20)?\d\d|(?:19|20)\d\d"
)
LONGEST_DATE = 10
#: Powers of ten: each further piece, a capital, a word in figures, a date.
PIECE, UPPER, LEETED, DATES = 1.0, 0.3, 0.6, math.log10(36500)
#: A run of equal characters or neighbours in the alphabet: where it begins, its first three
#: characters, each further one. A keyboard walk: where it begins, each key.
RUN, THREE, LONGER = 1.0, math.log10(3), 0.03
WALK, KEY = 1.5, 0.5


def _alphabet(char: str) -> float:
    if char.isdigit():
        return math.log10(10)
    if char.isascii() and char.isalpha():
        return math.log10(26)
    return math.log10(33)


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for c, key in enumerate(row):
            near[key] = {
                KEY_ROWS[y][x]
                for y in (r - 1, r, r + 1)
                if 0 <= y < len(KEY_ROWS)
                for x in (c - 1, c, c + 1)
                if 0 <= x < len(KEY_ROWS[y]) and (y, x) != (r, c)
            }
    return near


NEAR = _neighbours()


def _longer(short: float, long: float, step: float) -> float:
    """Cost of a piece of three characters or more, from the same one character shorter."""
    return min(short, long + step)


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest way to put ``value`` together.

    Every word, date, run of three or more equal characters, neighbours in the alphabet or
    neighbours on the keyboard, wherever it begins and ends, may be a piece, and so may any
    span of single characters. Words and dates have a longest length; the cost of a run grows
    by the same amount with each character, so an open run is one number that is carried on
    from place to place. That makes the exact minimum linear in the length.
    """
    n, infinite = len(value), math.inf
    low = value.lower()
    if len(low) != n:  # a letter whose lower case has two
        low = value
    plain = low.translate(LEET)
    upper = [c != d for c, d in zip(value, low, strict=True)]
    best = [0.0] + [infinite] * n  # cost up to a place, a piece ending there
    single = infinite  # the same, with a span of single characters open
    # Open runs of one, two and more characters: equal ones, up and down the alphabet, keys.
    equal1 = equal2 = equal = infinite
    up1 = up2 = up = down2 = down = infinite
    walk1 = walk2 = walk = infinite
    for i in range(n):
        char, each = low[i], _alphabet(low[i])
        start = min(best[i], single) + (PIECE if i else 0)
        jump = ord(char) - ord(low[i - 1]) if i else 0
        if i and jump == 0:
            equal, equal2 = _longer(equal2, equal, LONGER), equal1
        else:
            equal = equal2 = infinite
        up, up2 = (_longer(up2, up, LONGER), up1) if jump == 1 else (infinite, infinite)
        down, down2 = (_longer(down2, down, LONGER), up1) if jump == -1 else (infinite, infinite)
        if i and char in NEAR.get(low[i - 1], ()):
            walk, walk2 = min(walk2, walk) + KEY, walk1 + KEY
        else:
            walk = walk2 = infinite
        equal1, up1, walk1 = start + each + THREE, start + RUN + THREE, start + WALK + KEY
        single = min(single, start) + each + UPPER * upper[i]
        best[i + 1] = min(best[i + 1], equal, up, down, walk)
        for end in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = min(WORDS.get(low[i:end], 99.0), WORDS.get(plain[i:end], 99.0) + LEETED)
            if rank < 99:
                best[end] = min(best[end], start + rank + UPPER * min(2, sum(upper[i:end])))
        if char.isdigit():
            for end in range(i + 4, min(n, i + LONGEST_DATE) + 1):
                if DATE.fullmatch(value, i, end):
                    best[end] = min(best[end], start + DATES)
    return min(best[n], single)


def find_secrets(text: str) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost) of one text, by start, then kind."""
    found: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    values: dict[tuple[int, int], float] = {}
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_VALUE:
                values[m.span(2)] = guess_cost(m.group(2))
                found.append(("assign", *m.span(), values[m.span(2)]))
    found += [("access", *m.span(), None) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        taken = sorted((a, b) for _, a, b, _ in found)
        at, reach = 0, 0
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            # How far the spans go that begin at the value or before it.
            while at < len(taken) and taken[at][0] <= start:
                reach = max(reach, taken[at][1])
                at += 1
            if end <= reach:
                continue
            cost = guess_cost(m.group(1))
            if cost >= MIN_COST:
                found.append(("guess", start, end, cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, cost>>) per row; cost is null for kinds
    that are recognised by their form alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(
        pa.struct(
            [
                ("kind", pa.string()),
                ("start", pa.int64()),
                ("end", pa.int64()),
                ("cost", pa.float64()),
            ]
        )
    )

    def step(batch):
        rows = [
            [
                {"kind": k, "start": a, "end": b, "cost": c}
                for k, a, b, c in (find_secrets(text) if text else ())
            ]
            for text in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, span)], names=[id_col, "spans"]
        )

    return map_arrow(
        docs.select(id_col, text_col),
        step,
        f"`{id_col}` {kind}, "
        "spans array<struct<kind:string,start:bigint,end:bigint,cost:double>>",
    )
