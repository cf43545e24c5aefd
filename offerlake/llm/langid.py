"""Language of texts by a bidirectional gated recurrent network over bytes.

A text is cut into pieces of ``PIECE`` bytes. Over each piece one network runs forwards and one
backwards; both states together label every byte with a probability per language, and the mean
over all bytes of the text decides. The network is trained here, in numpy, by backpropagation
through time over whole pieces. Gates and states are squashed by x / (1 + |x|), which costs a
fifth of an exponential.

Training takes a bounded sample: ``SAMPLE`` different texts of each language, in the order of a
hash of the text, and of each of them ``PIECES`` pieces spread over the whole text. Labelling
reads every byte of every text.

Defined results: a null text, and one without a letter, is ``und`` with score 0, and so is every
text where nothing can be learned. With one language known, every other text has it with score 1.
Rows with a null language, a null text or no letter are not learned from; a null id is not held
out; repeated rows are labelled one by one; other columns of the documents are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.common import map_arrow
from offerlake.session import materialize

UNKNOWN = "und"
#: Bytes of a piece, and states of either direction.
PIECE, STATES = 64, 8
#: Bounds of the training sample: texts of a language, and pieces of a text.
SAMPLE, PIECES = 400, 8
#: Groups that the marks of a language are dealt to.
DEALT = 64
EPOCHS, BATCH, RATE, SEED = 4, 256, 0.03, 7
#: Pieces that go through the network side by side; their states stay in a core's cache.
SIDE_BY_SIDE = 4096


def squash(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), between -1 and 1."""
    np.abs(x, out=out)
    out += 1
    np.divide(x, out, out=out)
    return out


@dataclass
class Network:
    """Weights of both directions, and of the labels.

    ``bytes_[d]`` (3 x states, 256) is what a byte gives to the update gate, the reset gate and
    the candidate; ``states[d]`` (3 x states, states) what the state gives; ``labels``
    (languages, 2 x states) and ``shift`` read both states.
    """

    languages: list[str]
    bytes_: list[np.ndarray]
    states: list[np.ndarray]
    labels: np.ndarray
    shift: np.ndarray

    @staticmethod
    def fresh(languages: list[str], rng: np.random.Generator, n: int = STATES) -> Network:
        return Network(
            languages,
            [rng.normal(0, 0.5, (3 * n, 256)).astype(np.float32) for _ in range(2)],
            [rng.normal(0, n**-0.5, (3 * n, n)).astype(np.float32) for _ in range(2)],
            rng.normal(0, 0.1, (len(languages), 2 * n)).astype(np.float32),
            np.zeros((len(languages), 1), np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [*self.bytes_, *self.states, self.labels, self.shift]

    def direction(self, d: int, x: np.ndarray, inside: np.ndarray | None, keep: bool = False):
        """States after each byte, (bytes, states, pieces), as one direction meets them.

        ``x`` is (bytes, pieces); ``inside`` marks the bytes of short pieces, outside of which
        the state stays 0. With ``keep`` also what backpropagation needs of every step.
        """
        n, (steps, size) = self.states[d].shape[1], x.shape
        kind = self.labels.dtype
        all_states = np.zeros((steps, n, size), kind)
        h = np.zeros((n, size), kind)
        a, g = np.empty((3 * n, size), kind), np.empty((3 * n, size), kind)
        s, c, t = np.empty((2 * n, size), kind), np.empty((n, size), kind), np.empty((n, size), kind)
        kept = []
        for step in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(self.bytes_[d], x[step], axis=1, out=a, mode="clip")
            np.matmul(self.states[d], h, out=g)
            a[: 2 * n] += g[: 2 * n]
            squash(a[: 2 * n], s)
            s += 1
            s *= 0.5
            np.multiply(s[n:], g[2 * n :], out=t)
            a[2 * n :] += t
            squash(a[2 * n :], c)
            if keep:
                kept.append((step, h.copy(), a.copy(), s.copy(), c.copy(), g[2 * n :].copy()))
            np.subtract(c, h, out=t)
            t *= s[:n]
            h += t
            if inside is not None:
                h *= inside[step]
            all_states[step] = h
        return (all_states, kept) if keep else all_states

    def probabilities(self, both: list[np.ndarray]) -> np.ndarray:
        """Of each language at each byte, (bytes, languages, pieces)."""
        n = both[0].shape[1]
        out = np.matmul(self.labels[:, :n], both[0])
        out += np.matmul(self.labels[:, n:], both[1])
        out += self.shift
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def piece_sums(self, x: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
        """Probabilities summed over the bytes of each piece, (pieces, languages)."""
        found = self.probabilities([self.direction(d, x, inside) for d in range(2)])
        if inside is not None:
            found *= inside[:, None]
        return found.sum(0, dtype=np.float64).T

    def gradients(self, x: np.ndarray, inside: np.ndarray, truth: np.ndarray):
        """Mean cross entropy over the bytes, and its gradient for each of ``arrays``."""
        runs = [self.direction(d, x, inside, keep=True) for d in range(2)]
        found = self.probabilities([r[0] for r in runs])
        total = inside.sum()
        right = np.take_along_axis(found, np.broadcast_to(truth, (len(x), 1, x.shape[1])), 1)[:, 0]
        loss = -(np.log(np.maximum(right, 1e-30)) * inside).sum() / total
        np.subtract(found, np.arange(len(self.languages))[:, None] == truth, out=found)
        found *= (inside / total)[:, None]
        n = self.states[0].shape[1]
        to_labels = np.concatenate(
            [np.matmul(found, r[0].transpose(0, 2, 1)).sum(0) for r in runs], 1
        )
        by_bytes, by_states = [], []
        for d, (_, kept) in enumerate(runs):
            b, s = self._through_time(d, x, inside, found, self.labels[:, d * n : (d + 1) * n], kept)
            by_bytes.append(b)
            by_states.append(s)
        return loss, [*by_bytes, *by_states, to_labels, found.sum((0, 2))[:, None]]

    def _through_time(self, d, x, inside, found, labels, kept):
        """Backpropagation through the steps of one direction, the last one first."""
        u = self.states[d]
        n = u.shape[1]
        by_bytes, by_states = np.zeros_like(self.bytes_[d]), np.zeros_like(u)
        dh = np.zeros((n, x.shape[1]), u.dtype)
        for step, h, a, s, c, candidate in reversed(kept):
            dh += labels.T @ found[step]
            dh *= inside[step]
            z, r = s[:n], s[n:]
            slope = 1 / (1 + np.abs(a)) ** 2
            dc = dh * z * slope[2 * n :]
            dz = dh * (c - h) * 0.5 * slope[:n]
            dr = dc * candidate * 0.5 * slope[n : 2 * n]
            through = np.concatenate([dz, dr, dc * r])
            by_states += through @ h.T
            one_hot = np.zeros((x.shape[1], 256), u.dtype)
            one_hot[np.arange(x.shape[1]), x[step]] = 1
            by_bytes += np.concatenate([dz, dr, dc]) @ one_hot
            dh = dh * (1 - z) + u.T @ through
        return by_bytes, by_states


def pieces_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (bytes, pieces) of texts of at most ``PIECE`` bytes, and which are inside."""
    x = np.zeros((PIECE, len(texts)), np.uint8)
    inside = np.zeros((PIECE, len(texts)), np.float32)
    for k, text in enumerate(texts):
        x[: len(text), k] = np.frombuffer(text, np.uint8)
        inside[: len(text), k] = 1
    return x, inside


def fit(pieces: list[bytes], labels: list[str]) -> Network | None:
    """A network for texts of at most ``PIECE`` bytes with a language each."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(SEED)
    network = Network.fresh(languages, rng)
    if len(languages) == 1:
        return network
    truth = np.searchsorted(languages, labels)
    # Every language counts alike, so the rarer ones are drawn more often.
    of = [np.flatnonzero(truth == k) for k in range(len(languages))]
    x, inside = pieces_of(pieces)
    each = max(map(len, of))
    steps = EPOCHS * max(1, len(languages) * each // BATCH)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.arrays()]
    for step in range(steps):
        k = rng.integers(0, len(languages), BATCH)
        at = np.array([of[i][rng.integers(0, len(of[i]))] for i in k])
        _, slopes = network.gradients(x[:, at], inside[:, at], truth[at])
        rate = RATE * (1 - step / steps)
        for w, g, (m, v) in zip(network.arrays(), slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return network


def held_out(id_col: str) -> Column:
    """Rows that are never learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def first_of(marks: DataFrame, *group: str) -> DataFrame:
    """The ``SAMPLE`` smallest marks of each group."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy("mark"))
    return marks.withColumn("place", place).where(F.col("place") <= SAMPLE).drop("place")


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, pieces): at most ``SAMPLE`` different texts of each language.

    The marks of a language are dealt to ``DEALT`` groups, each of which keeps its first
    ``SAMPLE``; so however many rows it has, at most ``SAMPLE * DEALT`` marks meet at the end.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    known = docs.where(lang.isNotNull() & has_letter(text) & ~held_out(id_col)).select(
        lang.alias("lang"), F.xxhash64(text).alias("mark"), text.alias("text")
    )
    marks = known.select("lang", "mark").distinct()
    dealt = marks.withColumn("group", F.pmod(F.hash("mark"), F.lit(DEALT)))
    chosen = materialize(
        first_of(first_of(dealt, "lang", "group"), "lang").drop("group"), "langid-sample"
    )
    stride = F.greatest(F.floor(F.length("text") / PIECES), F.lit(PIECE)).cast("int")
    starts = F.sequence(F.lit(1), F.length("text"), stride)
    cut = F.transform(F.slice(starts, 1, PIECES), lambda s: F.substring("text", s, F.lit(PIECE)))
    return (
        known.join(chosen, ["lang", "mark"], "left_semi")
        .groupBy("lang", "mark")
        .agg(F.max(cut).alias("pieces"))
    )


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Network | None:
    """The network for ``docs``; at most ``SAMPLE`` x ``PIECES`` pieces of a language are read."""
    rows = sample(docs, id_col, text_col, lang_col).orderBy("lang", "mark").collect()
    pieces, labels = [], []
    for row in rows:
        for piece in row.pieces:
            pieces.append(piece.encode()[:PIECE])
            labels.append(row.lang)
    return fit(pieces, labels)


def labelled(network: Network, texts: pa.Array) -> np.ndarray:
    """Mean probability of each language over the bytes of each text, (texts, languages)."""
    data, starts, sizes = flat(texts)
    sums = np.zeros((len(sizes), len(network.languages)))
    for owner, at, size in _blocks(starts, sizes):
        x = data[np.minimum(at[None, :] + np.arange(PIECE)[:, None], len(data) - 1)]
        inside = None
        if size.min() < PIECE:
            inside = (np.arange(PIECE)[:, None] < size[None, :]).astype(np.float32)
        np.add.at(sums, owner, network.piece_sums(x, inside))
    return sums / np.maximum(sizes, 1)[:, None]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string array, and start and size of each text; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, ends[:-1], np.diff(ends)


def _blocks(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, start and size of pieces, ``SIDE_BY_SIDE`` at a time, whole pieces first."""
    for parts, size in ((sizes // PIECE, None), ((sizes % PIECE > 0).astype(np.int64), sizes % PIECE)):
        ends = np.cumsum(parts)
        for low in range(0, int(ends[-1]) if len(ends) else 0, SIDE_BY_SIDE):
            piece = np.arange(low, min(low + SIDE_BY_SIDE, int(ends[-1])))
            owner = np.searchsorted(ends, piece, side="right")
            if size is None:
                at = starts[owner] + PIECE * (piece - ends[owner] + parts[owner])
                yield owner, at, np.full(len(piece), PIECE)
            else:
                yield owner, starts[owner] + sizes[owner] - size[owner], size[owner]


def identify(
    docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang_pred, score) per row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.when(has_letter(F.col(text_col)), F.col(text_col)).alias("text"),
    )
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        network, texts = sent.value, batch.column(1)
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if network is not None:
            means = labelled(network, texts)
            best = means.argmax(1)
            there = texts.is_valid().to_numpy(zero_copy_only=False)
            names = [network.languages[b] if t else UNKNOWN for b, t in zip(best, there, strict=True)]
            scores = np.where(there, means[np.arange(len(best)), best].round(6).clip(0, 1), 0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            names=["id", "lang_pred", "score"],
        )

    found = map_arrow(rows, step, f"id {kind}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)
