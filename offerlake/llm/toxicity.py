"""Toxicity: a support vector machine over a subsequence string kernel.

Landmarks are strings that toxic training documents have in common and clean ones lack. A
sentence is described by the greatest likeness of its words to each landmark, in Nyström
coordinates (times the inverse root of the landmarks' own kernel matrix). The machine is
trained on sentences: all that resemble a landmark of clean documents, and of each toxic
document the one that speaks most for its label, chosen anew after each training. A document
scores as its worst sentence does, turned into a probability on the training documents.

Training takes a bounded sample of the labelled rows: ``SAMPLE`` different texts of either label,
of at most ``SAMPLE_CHARS`` characters, in the order of a hash of their text. Scoring reads whole
texts of all rows.

Defined results: a null or empty text scores as one without evidence; without training rows of
both labels, or without a string that tells them apart, every score is 0; a null id is not
held out; label rows with nulls are no training rows, and of several labels of one id the
greatest counts; repeated documents are scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import bound_batches
from offerlake.llm.string_kernel import Landmarks, cosine, letters
from offerlake.session import materialize

SAMPLE, SAMPLE_CHARS = 1500, 6000
LANDMARKS = 64
#: Lengths of landmark strings.
SHORTEST, LONGEST = 4, 8
#: A landmark is in at least so many toxic training documents that call for more.
SUPPORT = 3
#: Landmarks in a document after which it calls for no more, and likeness of two landmarks
#: that is too much.
COVERS, ALIKE = 4, 0.6
#: Times more frequent in toxic documents a shortest piece must be for longer ones with it to
#: be looked at, and words whose kernel values are computed together.
TELLING, WORDS_AT_ONCE = 1.5, 20_000
DECISION = 0.3
#: Single letters in a row that are read as one word.
SPELLED = 4
#: Words a Python worker remembers.
MEMO_WORDS = 300_000

SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n+")


def held_out(id_col: str) -> Column:
    return F.coalesce(
        F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)
    )


def sentence_words(sentence: str) -> list[str]:
    """Words of a sentence as letters; single letters in a row are put together."""
    words, spelled = [], []
    for token in [*sentence.split(), ""]:
        word = letters(token)
        if len(word) == 1:
            spelled.append(word)
            continue
        if len(spelled) >= SPELLED:
            words.append("".join(spelled))
        if word or not token:
            spelled = []
        if len(word) > 2:
            words.append(word)
    return words


@dataclass
class Model:
    """Landmarks, the machine in kernel values (coordinates folded in), and the two numbers
    that turn its output into a probability."""

    strings: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, output: np.ndarray | float) -> np.ndarray | float:
        return 1 / (1 + np.exp(-np.clip(self.slope * output + self.shift, -40, 40)))


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """Strings inside words that cover the toxic documents and stay out of the clean ones.

    One after the other, the string in most documents not covered ``COVERS`` times yet, each
    clean document it is in counting against three; of equals the longer, then the last in
    order. Strings like one chosen before are passed over.
    """

    def starts(words: set[str]) -> set[str]:
        return {w[a : a + SHORTEST] for w in words for a in range(len(w) - SHORTEST + 1)}

    def pieces(words: set[str]) -> set[str]:
        """Pieces that hold one of the telling shortest ones."""
        found = set()
        for w in words:
            at = [a for a in range(len(w) - SHORTEST + 1) if w[a : a + SHORTEST] in telling]
            for n in range(SHORTEST, LONGEST + 1) if at else ():
                for a in range(len(w) - n + 1):
                    if any(a <= k <= a + n - SHORTEST for k in at):
                        found.add(w[a : a + n])
        return found

    per_clean = len(toxic) / max(1, len(clean))
    first = Counter(p for words in toxic for p in starts(words))
    second = Counter(p for words in clean for p in starts(words))
    telling = {p for p, n in first.items() if n >= SUPPORT and n > TELLING * second[p] * per_clean}
    in_toxic = Counter(p for words in toxic for p in pieces(words))
    common = {p for p, n in in_toxic.items() if n >= SUPPORT}
    in_clean: Counter[str] = Counter()
    for words in clean:
        in_clean.update(pieces(words) & common)
    useful = {p for p in common if in_toxic[p] > 3 * in_clean[p] * per_clean}
    best = sorted(useful, key=lambda p: (3 * in_clean[p] - in_toxic[p], -len(p), p))[:4000]
    owners = {p: set() for p in best}
    for k, words in enumerate(toxic):
        for p in pieces(words) & owners.keys():
            owners[p].add(k)
    chosen: list[str] = []
    times = Counter()
    while len(chosen) < LANDMARKS and owners:
        top = max(owners, key=lambda p: (len(owners[p]) - 3 * in_clean[p], len(p), p))
        if len(owners[top]) - 3 * in_clean[top] < SUPPORT:
            break
        covered = owners.pop(top)
        if any(cosine(top, other) >= ALIKE for other in chosen):
            continue
        chosen.append(top)
        times.update(covered)
        full = {k for k in covered if times[k] == COVERS}
        for p in list(owners):
            owners[p] -= full
    return sorted(chosen)


def sentence_values(marks: Landmarks, texts: list[list[list[str]]]) -> list[np.ndarray]:
    """Per text, given as words of its sentences, the kernel values of the sentences that
    are like a landmark."""
    every = sorted({w for text in texts for words in text for w in words})
    like: dict[str, np.ndarray] = {}
    for at in range(0, len(every), WORDS_AT_ONCE):
        part = every[at : at + WORDS_AT_ONCE]
        like.update((part[k], v) for k, v in marks.likeness(part).items())
    found = []
    for text in texts:
        rows = [[like[w] for w in words if w in like] for words in text]
        values = [np.max(r, axis=0) for r in rows if r]
        found.append(np.array(values, np.float64).reshape(-1, len(marks.strings)))
    return found


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Linear support vector machine by averaged subgradient steps; the last column is 1."""
    w, total, decay = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1e-4
    for t in range(1, rounds + 1):
        wrong = y * (x @ w) < 1
        gradient = decay * w - ((weight * y * wrong) @ x) / weight.sum()
        gradient[-1] -= decay * w[-1]
        w = w - gradient * 8.0 / np.sqrt(t)
        if t > rounds // 2:
            total += w
    return total / (rounds - rounds // 2)


def logistic(output: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn outputs into probabilities: Newton steps on smoothed labels."""
    positive, negative = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([output, np.ones(len(output))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * theta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        theta = theta - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(texts: list[str], labels: list[int], toxic_share: float) -> Model | None:
    """Train on labelled texts; ``toxic_share`` is that of all labelled training rows."""
    order = sorted(range(len(texts)), key=lambda k: (labels[k], texts[k]))
    texts, labels = [texts[k] for k in order], [labels[k] for k in order]
    sentences = [[sentence_words(s) for s in SENTENCE_END.split(t)] for t in texts]
    words = [set().union(*text) for text in sentences]
    strings = choose_landmarks(
        [w for w, y in zip(words, labels, strict=True) if y],
        [w for w, y in zip(words, labels, strict=True) if not y],
    )
    if not strings or len(set(labels)) < 2:
        return None
    marks = Landmarks(strings)
    kernel = np.zeros((len(strings), len(strings)))
    for k, values in marks.likeness(strings).items():
        kernel[k] = values
    kernel = (kernel + kernel.T) / 2 + 1e-2 * np.eye(len(strings))
    eigen, basis = np.linalg.eigh(kernel)
    root = basis @ np.diag(1 / np.sqrt(np.maximum(eigen, 1e-2))) @ basis.T
    values = sentence_values(marks, sentences)
    none = np.zeros((1, len(strings)))
    rows = [np.concatenate([v, none]) if not y else v for v, y in zip(values, labels, strict=True)]
    w = np.concatenate([root.sum(1), [0.0]])
    y_doc = np.where(np.array(labels) > 0, 1.0, -1.0)
    share = float((y_doc > 0).mean())
    class_weight = np.where(y_doc > 0, toxic_share / share, (1 - toxic_share) / (1 - share))
    clean = np.concatenate([r for r, y in zip(rows, y_doc, strict=True) if y < 0])
    for _ in range(3):
        folded = root @ w[:-1]
        picks = [r[np.argmax(r @ folded)] for r, y in zip(rows, y_doc, strict=True) if y > 0 and len(r)]
        if not picks:
            return None
        x = np.concatenate([np.array(picks), clean]) @ root
        x = np.concatenate([x, np.ones((len(x), 1))], 1)
        y = np.concatenate([np.ones(len(picks)), -np.ones(len(clean))])
        each = np.where(y > 0, 1 / len(picks), 1 / len(clean))
        w = hinge(x, y, each)
    folded = root @ w[:-1]
    output = np.array([np.max(v @ folded, initial=0.0) + w[-1] for v in values])
    slope, shift = logistic(output, y_doc, class_weight)
    return Model(strings, folded, float(w[-1]), slope, shift)


def training_keys(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str
) -> DataFrame:
    """(id, mark, size, label) of the labelled rows that are not held out; ``mark`` is a hash
    of the text, which itself is not moved."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).alias("label"))
    )
    rows = docs.where(F.col(text_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("mark"),
        F.length(text_col).alias("size"),
    )
    return rows.join(known, rows["id"] == known["_id"]).drop("_id")


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model | None:
    keys = materialize(training_keys(docs, labels, id_col, text_col, label_col), "labelled")
    # Equal texts are one row before the sample is cut, so copies take no places in it.
    short = keys.where(F.col("size") <= SAMPLE_CHARS).groupBy("mark", "label").agg(F.min("id").alias("id"))
    samples = [
        short.where(F.col("label") == label).orderBy("mark").limit(SAMPLE)
        for label in (0, 1)
    ]
    # At most twice SAMPLE rows of three numbers, so they go to the texts.
    sample = F.broadcast(samples[0].union(samples[1]))
    texts = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")
    )
    rows = texts.join(sample, ["id", "mark"]).groupBy("mark", "label").agg(F.first("text").alias("text"))
    got = rows.select("text", "label").collect()
    if len({r.label for r in got}) < 2:
        return None
    share = keys.agg(F.avg("label")).first()[0]
    return fit([r.text for r in got], [r.label for r in got], share)


def score(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, score) per row."""
    kind = docs.schema[id_col].dataType.simpleString()
    scores = _scorer(docs, model)

    def run(batches):
        for batch, found in scores(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64())], names=[id_col, "score"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``DECISION``."""
    at = docs.columns.index(text_col)
    scores = _scorer(docs, model)

    def run(batches):
        for batch, found in scores(batches, at):
            yield batch.filter(pa.array([s < DECISION for s in found]))

    return docs.mapInArrow(run, docs.schema)


def _scorer(docs: DataFrame, model: Model | None):
    """A function that gives each batch with the scores of its texts (a column's place)."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches, at: int):
        model = sent.value
        marks = Landmarks(model.strings) if model else None
        memo: dict[str, float | None] = {}

        def learn(words: list[str]) -> None:
            """Remember the words that are like a landmark, and that the others are not."""
            memo.update(dict.fromkeys(words))
            clean = [letters(w) for w in words]
            memo.update(
                (words[k], "") for k, w in enumerate(clean) if len(w) == 1
            )
            known = [k for k, w in enumerate(clean) if len(w) > 2]
            if known:
                for k, values in marks.likeness([clean[k] for k in known]).items():
                    memo[words[known[k]]] = values

        def output(text: str) -> float:
            tokens = text.split()
            fresh = set(tokens).difference(memo)
            if fresh:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                    fresh = set(tokens)
                learn(sorted(fresh))
            suspects = [k for k, v in enumerate(map(memo.__getitem__, tokens)) if v is not None]
            if not suspects or not _evidence(tokens, suspects, memo):
                return model.bias
            best = 0.0
            for words in _sentences(text):
                spelled = _spelled(words, memo)
                values = [v for w in words if (v := memo.get(w)) is not None and not isinstance(v, str)]
                values += marks.likeness(spelled).values() if spelled else ()
                if values:
                    best = max(best, float(np.max(values, axis=0) @ model.weights))
            return best + model.bias

        for batch in batches:
            if not batch.num_rows:
                continue
            if model is None:
                yield batch, [0.0] * batch.num_rows
            else:
                outputs = np.array([output(t or "") for t in batch.column(at).to_pylist()])
                yield batch, model.probability(outputs).tolist()

    return run


def _sentences(text: str) -> Iterator[list[str]]:
    """Tokens of each sentence; a line ends one, and so does a token with an end mark."""
    for line in text.split("\n"):
        words: list[str] = []
        for token in line.split():
            words.append(token)
            if token[-1] in ".!?":
                yield words
                words = []
        if words:
            yield words


def _spelled(tokens: list[str], memo: dict) -> list[str]:
    """Words spelled out in single letters; marks between the letters do not end them."""
    words, run = [], []
    for token in [*tokens, None]:
        value = memo.get(token) if token is not None else None
        if isinstance(value, str):
            run.append(letters(token))
        elif token is None or letters(token):
            if len(run) >= SPELLED:
                words.append("".join(run))
            run = []
    return words


def _evidence(tokens: list[str], suspects: list[int], memo: dict) -> bool:
    """Whether a suspect is more than a single letter that stands alone."""
    row, last = 0, -2
    for k in suspects:
        if not isinstance(memo[tokens[k]], str):
            return True
        row = row + 1 if k - last <= 2 else 1
        last = k
        if row >= SPELLED:
            return True
    return False
