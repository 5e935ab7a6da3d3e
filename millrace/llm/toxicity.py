"""Toxicity classifier that does not mind which group a text mentions."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Memo, batches_of, binaries
from millrace.llm.common import materialize

#: Identity terms; the terms of one line take each other's place in counterfactual texts.
IDENTITY_TERMS = (
    ("women", "men", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "old", "young"),
)
_EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_/\\"


class Model(NamedTuple):
    """A weight for each feature and one for all texts."""

    weights: dict[str, float]
    bias: float


def word_features(word: bytes) -> tuple[str, ...]:
    """A word without case and outer signs, and its first four and five letters."""
    text = word.strip(_EDGE).decode().lower()
    if not text:
        return ()
    if len(text) <= 4:
        return (text,)
    return (text, text[:4] + "*", text[:5] + "*")


def text_features(words: Iterable[bytes], memo: Memo) -> set[str]:
    """The distinct features of the words of a text; ``memo`` is ``Memo(word_features)``."""
    return set().union(*map(memo.__getitem__, set(words)))


def swaps(words: set[str]) -> list[tuple[str, str]]:
    """Each identity term among the words with the two terms that take its place."""
    out = []
    for group in IDENTITY_TERMS:
        for k, term in enumerate(group):
            if term in words:
                out += [(term, group[(k + d) % len(group)]) for d in (1, 2)]
    return out


class _Rows:
    """Sparse rows of ones (and minus ones): products with a dense vector, both ways."""

    def __init__(self, rows: list[list[int]], signs: list[list[float]] | None, width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], np.int64)
        self.value = (
            np.ones(len(self.column))
            if signs is None
            else np.array([s for r in signs for s in r], float)
        )
        self.shape = (len(rows), width)

    def dot(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x[self.column] * self.value, self.shape[0])

    def transposed_dot(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, x[self.row] * self.value, self.shape[1])


def fit(
    rows: list[list[int]],
    labels: np.ndarray,
    pairs: list[tuple[list[int], list[float]]],
    width: int,
    penalty: float = 1.0,
    ridge: float = 1e-4,
    rounds: int = 200,
    rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Logistic regression whose score may not change when an identity term is swapped.

    ``pairs`` holds, for each counterfactual text, the features that it gains and loses. The
    loss is the mean log loss, plus ``ridge`` times the squared weights, plus ``penalty`` times
    the mean squared change of score (log odds) over the pairs. Minimized by Adam's steps over
    all rows, from zero, so equal inputs give equal weights.
    """
    x = _Rows(rows, None, width)
    d = _Rows([p[0] for p in pairs], [p[1] for p in pairs], width)
    y, n = labels.astype(float), max(1, len(rows))
    point, mean, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, rounds + 1):
        weights = point[:width]
        error = 1.0 / (1.0 + np.exp(-(x.dot(weights) + point[width]))) - y
        gradient = np.append(x.transposed_dot(error) / n + ridge * weights, error.mean())
        if pairs:
            gradient[:width] += 2.0 * penalty * d.transposed_dot(d.dot(weights)) / len(pairs)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        step = rate * (1.0 - (k - 1) / rounds)
        point = point - step * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    weights, bias = point[:width], float(point[width])
    return weights, bias


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 10_000,
    vocabulary: int = 4_096,
    least: int = 4,
    deviations: float = 4.0,
    penalty: float = 1.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Model:
    """Fit the classifier on a sample of labelled rows.

    ``sample`` bounds the labelled rows used, taken evenly by a hash of their id; only these
    reach the driver, as features. Of the features in at least ``least`` of them, whose shares
    in the classes differ by at least ``deviations`` of what chance makes, the ``vocabulary``
    ones that tell the classes apart best are kept, and those of the identity terms. Labels other than 0 and 1 and ids that are null or labelled both ways are left out;
    without labelled rows of both classes the model scores every text alike.
    """
    ids = (
        labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1))
        .groupBy(F.col(id_column).alias("doc_id"))
        .agg(F.min(label_column).cast("int").alias("y"), F.max(label_column).alias("_most"))
        .filter("y = _most")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .select("doc_id", "y")
    )

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_features)
        for batch in batches_of(batches, "text", 1 << 23):
            found = [sorted(text_features((t or b"").split(), memo))
                     for t in binaries(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(found, pa.list_(pa.string()))], names=["y", "words"]
            )

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    # At most `sample` rows of two numbers: their size is bounded, however many labels there are.
    rows = source.join(F.broadcast(ids), "doc_id").select("y", "text")
    rows = materialize(rows.mapInArrow(features, "y int, words array<string>"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for y, words in zip(batch.column("y").to_pylist(), batch.column("words").to_pylist()):
                total[y].update(words)
        words = list(set(total[0]) | set(total[1]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.string()),
                *(pa.array([c[w] for w in words], pa.int64()) for c in total),
            ],
            names=["word", "n0", "n1"],
        )

    size = {row["y"]: row["n"] for row in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        share = (size.get(1, 0) + 1) / (size.get(0, 0) + size.get(1, 0) + 2)
        return Model({}, float(np.log(share / (1 - share))) if size else 0.0)
    share = (F.col("n1") + F.col("n0")) / sum(size.values())
    apart = F.abs(F.col("n1") / size[1] - F.col("n0") / size[0]) / F.sqrt(
        share * (1 / size[1] + 1 / size[0])
    )
    best = (
        rows.mapInArrow(count, "word string, n0 long, n1 long")
        .groupBy("word")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .filter((F.col("n0") + F.col("n1") >= least) & (apart >= deviations))
        .orderBy(apart.desc(), "word")
        .limit(vocabulary)
    )
    names = [row["word"] for row in best.collect()]
    terms = {f for group in IDENTITY_TERMS for t in group for f in word_features(t.encode())}
    names += sorted(terms - set(names))
    column = {name: k for k, name in enumerate(names)}

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity = {t for group in IDENTITY_TERMS for t in group}
        for batch in batches:
            found = batch.column("words").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("y"),
                    pa.array([[column[w] for w in words if w in column] for words in found],
                             pa.list_(pa.int32())),
                    pa.array([[w for w in words if w in identity] for words in found],
                             pa.list_(pa.string())),
                ],
                names=["y", "columns", "identity"],
            )

    chosen = rows.mapInArrow(select, "y int, columns array<int>, identity array<string>")
    chosen = chosen.collect()
    # An order of their own, as the sums of a fit depend on it.
    chosen.sort(key=lambda row: (row["y"], row["columns"]))
    pairs = []
    for row in chosen:
        for term, other in swaps(set(row["identity"])):
            gained = [column[f] for f in word_features(other.encode())]
            lost = [column[f] for f in word_features(term.encode())]
            pairs.append((gained + lost, [1.0] * len(gained) + [-1.0] * len(lost)))
    weights, bias = fit(
        [row["columns"] for row in chosen],
        np.array([row["y"] for row in chosen]),
        pairs,
        len(names),
        penalty,
    )
    return Model({n: float(w) for n, w in zip(names, weights) if w}, float(bias))


def score(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The toxicity of every whole text: ``doc_id, score``, one row per row.

    A null text is empty. Ids, languages and sources have no part in it.
    """
    packed = pickle.dumps(tuple(model))

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = pickle.loads(packed)
        known = Memo(lambda word: tuple(f for f in word_features(word) if f in weights))
        for batch in batches_of(batches, "text", 1 << 23):
            odds = np.array(
                [
                    bias + sum(weights[f] for f in sorted(text_features((t or b"").split(), known)))
                    for t in binaries(batch.column("text"))
                ]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1.0 / (1.0 + np.exp(-odds)), pa.float64())],
                names=["doc_id", "score"],
            )

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(rate, f"doc_id {kind}, score double")


def drop_toxic(
    docs: DataFrame,
    model: Model,
    threshold: float = 0.5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows whose text scores below ``threshold``, with all their columns."""
    packed = pickle.dumps(tuple(model))
    names = docs.columns

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = pickle.loads(packed)
        known = Memo(lambda word: tuple(f for f in word_features(word) if f in weights))
        place = names.index(text_column)
        for batch in batches:
            odds = np.array(
                [
                    bias + sum(weights[f] for f in sorted(text_features((t or b"").split(), known)))
                    for t in binaries(batch.column(place))
                ]
            )
            yield batch.filter(pa.array(1.0 / (1.0 + np.exp(-odds)) < threshold, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
