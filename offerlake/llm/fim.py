"""Fill-in-the-middle: texts cut in three and put together again in another order.

All texts of an Arrow batch lie side by side as bytes. A scan marks where their units begin, two
cuts a text are found in it, and every part of a text gets a displacement: how far its bytes move
in the output. The displacements are kept as differences at the parts' first bytes, whose running
sum is the shift of every byte, and one scatter writes the output. The way back reads the output
and its form alone: the sentinels in it give the parts, and a gather by the opposite shifts gives
the text.

Memory is that of the batch and its output and a byte of marks a byte, whatever the texts'
lengths; shifts are made for ``STRETCH`` bytes at a time.

Defined results: a null text is an empty one, and empty texts stay as they are (form ``plain``),
like texts that hold a sentinel; a null id draws as an empty one does; repeated rows give equal
rows; the other columns are not looked at and not kept, so they may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import map_arrow

#: The sentinels, and the order of the parts in either form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Places of the three parts of a text (0 prefix, 1 middle, 2 suffix) in the output.
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
#: Shares in hundredths: texts that are cut, and suffix-first ones among them.
CUT, SUFFIX_FIRST = 90, 20

#: Bytes whose shifts are made at a time, and bytes of a block of the unit scan.
STRETCH, BLOCK = 1 << 20, 1 << 13
_SIZE = 3
_LETTERS = {0: ord("P"), 1: ord("M"), 2: ord("S")}


def draws(id_col: Column) -> list[Column]:
    """Four numbers of 32 bits that depend on the id alone."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def form_of(text: Column, third: Column, fourth: Column) -> Column:
    held = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return (
        F.when((text == "") | held | (third % 100 >= CUT), PLAIN)
        .when(fourth % 100 < SUFFIX_FIRST, SPM)
        .otherwise(PSM)
    )


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array side by side, and the bounds of the texts in them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    made = pa.LargeStringArray.from_buffers(
        len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)
    )
    return made.cast(pa.string())


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks the first byte of every unit: a run of ASCII letters, or any other character."""
    letter = ((data | 0x20) - np.uint8(97)) < 26
    starts = (data & 0xC0) != 0x80
    follows = letter[1:] & letter[:-1]
    starts[1:] &= ~follows
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[firsts] = True
    return starts


def ranks(marks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of marks before each place."""
    known = np.unique(np.append(places, 0))
    inner = known[known < len(marks)]
    sums = np.add.reduceat(marks, inner, dtype=np.int64) if len(inner) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(sums)])
    return before[np.searchsorted(known, places)]


def select(marks: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Place of the mark that has ``which`` marks before it; the end where there is none."""
    edges = np.arange(0, len(marks) + BLOCK, BLOCK)
    before = ranks(marks, np.minimum(edges, len(marks)))
    block = np.searchsorted(before, which, side="right") - 1
    places = np.full(len(which), len(marks), np.int64)
    for k in np.flatnonzero(which < before[-1]):
        low = int(edges[block[k]])
        places[k] = low + np.flatnonzero(marks[low : low + BLOCK])[which[k] - before[block[k]]]
    return places


def shifts(starts: np.ndarray, moves: np.ndarray, low: int, high: int) -> np.ndarray:
    """Shift of each byte in [low, high): the move of the last part that starts at or before it.

    The moves lie as differences at the parts' first bytes; empty parts put theirs on the byte
    of the next one, where they add up.
    """
    first = np.searchsorted(starts, low, side="right") - 1
    last = np.searchsorted(starts, high, side="left")
    differences = np.zeros(high - low, np.int64)
    differences[0] = moves[first]
    inner = np.arange(first + 1, last)
    np.add.at(differences, starts[inner] - low, moves[inner] - moves[inner - 1])
    return np.cumsum(differences, out=differences)


def scatter(data: np.ndarray, starts: np.ndarray, moves: np.ndarray, out: np.ndarray) -> None:
    """Write every byte to its place plus its shift."""
    for low in range(0, len(data), STRETCH):
        high = min(low + STRETCH, len(data))
        to = shifts(starts, moves, low, high)
        to += np.arange(low, high)
        out[to] = data[low:high]


def gather(out: np.ndarray, starts: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """The bytes at every place plus its shift."""
    data = np.empty(size, np.uint8)
    for low in range(0, size, STRETCH):
        high = min(low + STRETCH, size)
        at = shifts(starts, moves, low, high)
        at += np.arange(low, high)
        data[low:high] = out[at]
    return data


def part_places(sizes: np.ndarray, forms: list[str], bases: np.ndarray) -> np.ndarray:
    """Where the parts (texts, 3) begin in the output whose texts begin at ``bases``."""
    places = np.repeat(bases[:, None], 3, 1)
    places[:, 1] += sizes[:, 0]
    places[:, 2] += sizes[:, 0] + sizes[:, 1]
    names = np.array(forms, dtype=object)
    for form, order in ORDER.items():
        rows = np.flatnonzero(names == form)
        at = bases[rows].copy()
        for part in order:
            at += _SIZE
            places[rows, part] = at
            at += sizes[rows, part]
    return places


def rearranged(texts: pa.Array, forms: list[str], one: np.ndarray, two: np.ndarray):
    """Output of each text, its units, and the characters of its prefix and its middle.

    ``one`` and ``two`` are the numbers the cuts are drawn from.
    """
    data, bounds = flat(texts)
    begin, end = bounds[:-1], bounds[1:]
    marks = unit_starts(data, bounds)
    before = ranks(marks, bounds)
    units = np.diff(before)
    draws = np.sort(np.stack([one % (units + 1), two % (units + 1)]), 0)
    cuts = [
        np.where(k == units, end, np.minimum(select(marks, before[:-1] + k), end)) for k in draws
    ]
    del marks
    parts = np.stack([begin, *cuts, end], 1)
    characters = ranks((data & 0xC0) != 0x80, parts)
    sizes = np.diff(parts, axis=1)
    cut = np.array([f != PLAIN for f in forms], bool)
    ends = np.cumsum(end - begin + 3 * _SIZE * cut)
    bases = ends - (end - begin + 3 * _SIZE * cut)
    places = part_places(sizes, forms, bases)
    out = np.empty(int(ends[-1]), np.uint8)
    scatter(data, parts[:, :3].ravel(), (places - parts[:, :3]).ravel(), out)
    for part, letter in _LETTERS.items():
        at = places[cut, part] - _SIZE
        out[at], out[at + 1], out[at + 2] = ord("<"), letter, ord(">")
    made = strings(out, np.concatenate([[0], ends]))
    return made, units, np.diff(characters, axis=1)[:, :2]


def sentinel_places(data: np.ndarray) -> np.ndarray:
    found = []
    for low in range(0, len(data), STRETCH):
        window = data[low : low + STRETCH + 2]
        at = np.flatnonzero(window[: max(0, len(window) - 2)] == ord("<"))
        at = at[window[at + 2] == ord(">")]
        found.append(low + at[np.isin(window[at + 1], list(_LETTERS.values()))])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def restored(outputs: pa.Array, forms: list[str]) -> pa.Array:
    """The texts, from the outputs and their forms alone."""
    data, bounds = flat(outputs)
    begin, end = bounds[:-1], bounds[1:]
    found = sentinel_places(data)
    # A text that was cut holds no sentinel of its own, so its output has its three.
    first = np.searchsorted(found, begin)
    origins = np.repeat(begin[:, None], 3, 1)
    sizes = np.zeros((len(forms), 3), np.int64)
    sizes[:, 0] = end - begin
    names = np.array(forms, dtype=object)
    for form, order in ORDER.items():
        rows = np.flatnonzero(names == form)
        if not len(rows):
            continue
        marks = found[first[rows][:, None] + np.arange(3)]
        for k, part in enumerate(order):
            origins[rows, part] = marks[:, k] + _SIZE
            sizes[rows, part] = (marks[:, k + 1] if k < 2 else end[rows]) - marks[:, k] - _SIZE
    plain = names == PLAIN
    origins[plain, 1:] = end[plain, None]
    ends = np.cumsum(sizes.sum(1))
    starts = np.concatenate([[0], np.cumsum(sizes.ravel())[:-1]])
    size = int(ends[-1])
    text = gather(data, starts, origins.ravel() - starts, size)
    return strings(text, np.concatenate([[0], ends]))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row; no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one, two, three, four = draws(F.col(id_col))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        form_of(text, three, four).alias("form"),
        one.alias("one"),
        two.alias("two"),
    )

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts, forms, one, two = batch.columns
        names = forms.to_pylist()
        made, units, characters = rearranged(texts, names, one.to_numpy(), two.to_numpy())
        plain = np.array([f == PLAIN for f in names], bool)
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(units, pa.int64()),
                forms,
                *(pa.array(characters[:, k], pa.int64(), mask=plain) for k in range(2)),
                made,
            ],
            names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_arrow(rows, step, schema).withColumnRenamed("id", id_col)


def restore(
    transformed: DataFrame, form_col: str = "form", output_col: str = "output", name: str = "restored"
) -> DataFrame:
    """``transformed`` with the text, rebuilt from output and form; no shuffle."""
    columns = transformed.columns
    form_at, output_at = columns.index(form_col), columns.index(output_col)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = restored(batch.column(output_at), batch.column(form_at).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*columns, name])

    schema = type(transformed.schema)([*transformed.schema.fields]).add(name, "string")
    return map_arrow(transformed, step, schema)
