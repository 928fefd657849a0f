"""Quality classifier: a factorisation machine over words, structure and size.

A text becomes a sparse vector: hashed words (length-normalised counts), statistics of its
structure, and metadata measured on the text itself (its size in characters, words and lines).
Each feature has a weight and a short latent vector; pairs of features interact through the
product of their vectors.  All pairs are summed in linear time,
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 (|sum v_i x_i|^2 - sum |v_i x_i|^2)``.

Training reads a bounded sample of labelled rows, in which each row stands for as many as its
label has rows per row drawn; scoring reads every whole text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from evistrata.llm.base import counted_sample, filter_texts, map_batches, texts, worker_state

STRUCTURE = (
    "upper", "digit", "symbol", "space", "other", "exclamation", "comma", "sentence_end", "bar",
    "word_length", "distinct_words", "top_word", "stutter", "repeated_pairs", "line_words", "dup_lines",
)
METADATA = ("log_chars", "log_words", "log_lines", "any_word")
DENSE = STRUCTURE + METADATA


@dataclass(frozen=True)
class Settings:
    """``per_label`` rows of each label train, at most ``sample_chars`` characters long; words
    fall into ``2**word_bits`` buckets; ``rank`` is the length of the latent vectors."""

    per_label: int = 4000
    sample_chars: int = 50_000
    word_bits: int = 15
    rank: int = 8
    epochs: int = 12
    batch: int = 128
    rate: float = 0.05
    decay: float = 1e-5
    threshold: float = 0.7


def _kinds() -> np.ndarray:
    """Kind of every code point of the basic plane: 0 letter, 1 capital, 2 digit, 3 symbol, 4 space, 5 other."""
    kinds = np.full(1 << 16, 5, np.uint8)
    for code in range(1 << 16):
        category = unicodedata.category(chr(code))
        if category == "Lu":
            kinds[code] = 1
        elif category[0] == "L":
            kinds[code] = 0
        elif category == "Nd":
            kinds[code] = 2
        elif category[0] == "Z":
            kinds[code] = 4
    kinds[[ord(c) for c in "\t\n\r\f\v"]] = 4
    kinds[[ord(c) for c in "#*$%&|<>=_~^\\{}[]@+"]] = 3
    return kinds


def _tools() -> tuple[np.ndarray, dict[str, int]]:
    state = worker_state("quality")
    if not state:
        state["kinds"], state["words"] = _kinds(), {}
    if len(state["words"]) > 600_000:
        state["words"].clear()
    return state["kinds"], state["words"]


def features(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their normalised counts, and the dense statistics of a text."""
    kinds, known = _tools()
    words = text.split()
    for word in set(words).difference(known):
        known[word] = xxh3_64_intdigest(word)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    buckets, counts = np.unique((hashes >> np.uint64(64 - settings.word_bits)).astype(np.int64), return_counts=True)
    weights = np.sqrt(counts)
    weights = weights / np.sqrt((weights * weights).sum()) if len(weights) else weights

    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = np.bincount(kinds[np.minimum(codes, 0xFFFF)], minlength=6)
    n, m = max(len(text), 1), max(len(words), 1)
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] if len(words) > 1 else hashes[:0]
    lines = [line for line in text.split("\n") if line.strip()]
    letters = max(int(kind[0] + kind[1]), 1)
    dense = np.array(
        [
            kind[1] / letters, kind[2] / n, kind[3] / m, kind[4] / n, kind[5] / n,
            text.count("!") / m, text.count(",") / m, text.count(".") / m, text.count("|") / m,
            letters / m / 10, len(np.unique(hashes)) / m, counts.max() / m if len(counts) else 0.0,
            (hashes[1:] == hashes[:-1]).sum() / m, 1 - len(np.unique(pairs)) / max(len(pairs), 1),
            min(m / max(len(lines), 1), 60) / 60, 1 - len(set(lines)) / max(len(lines), 1),
            np.log1p(len(text)) / 10, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, float(bool(words)),
        ]
    )
    return buckets, weights, dense


@dataclass
class Model:
    """Dense features are scaled by ``mean`` and ``deviation`` and follow the word buckets."""

    bias: float
    weights: np.ndarray
    latent: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.deviation, -4, 4) / np.sqrt(len(DENSE))

    def rows(self, vectors: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all rows end to end, and where each row starts."""
        first = len(self.weights) - len(DENSE)
        last = np.arange(first, first + len(DENSE))
        at = np.concatenate([np.concatenate([buckets, last]) for buckets, _, _ in vectors])
        value = np.concatenate([np.concatenate([weights, self.scaled(dense)]) for _, weights, dense in vectors])
        sizes = np.array([len(buckets) + len(DENSE) for buckets, _, _ in vectors])
        return at, value, np.cumsum(sizes) - sizes

    def margins(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margin per row, the latent terms and their sum per row."""
        terms = self.latent[at] * value[:, None]
        sums = np.add.reduceat(terms, starts)
        squares = np.add.reduceat((terms * terms).sum(axis=1), starts)
        linear = np.add.reduceat(self.weights[at] * value, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), terms, sums

    def score(self, vectors: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.rows(vectors))[0], -30, 30)))


def train(
    vectors: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int], settings: Settings, shares: list[float] | None = None
) -> Model:
    """Fit by stochastic gradient descent with per-feature rates (AdaGrad) on rows that count
    as much as ``shares`` says, or all the same.

    Without rows, or with one label only, the model gives the share of label 1 (no rows: 0.5).
    """
    size = (1 << settings.word_bits) + len(DENSE)
    draw = np.random.default_rng(7)
    target = np.array(labels, float)
    dense = np.array([row[2] for row in vectors]).reshape(-1, len(DENSE))
    share = np.ones(len(labels)) if shares is None else np.array(shares, float) / max(np.mean(shares), 1e-12)
    mean = np.average(dense, axis=0, weights=share) if len(dense) else np.zeros(len(DENSE))
    spread = np.sqrt(np.average((dense - mean) ** 2, axis=0, weights=share)) if len(dense) else np.ones(len(DENSE))
    deviation = np.maximum(spread, 1e-3)
    model = Model(0.0, np.zeros(size), draw.normal(0, 0.01, (size, settings.rank)), mean, deviation)
    if len(set(labels)) < 2:
        if labels:
            model.bias = 30.0 if labels[0] else -30.0
        model.latent[:] = 0
        return model
    rate, seen_bias = settings.rate, 1e-8
    seen, seen_latent = np.full(size, 1e-8), np.full((size, settings.rank), 1e-8)
    for _ in range(settings.epochs):
        order = draw.permutation(len(vectors))
        for begin in range(0, len(order), settings.batch):
            chosen = order[begin : begin + settings.batch]
            at, value, starts = model.rows([vectors[i] for i in chosen])
            margin, terms, sums = model.margins(at, value, starts)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target[chosen]) * share[chosen]
            row = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(at))))
            touched, inverse = np.unique(at, return_inverse=True)
            spread = slope[row] * value
            step = np.bincount(inverse, spread, len(touched)) + settings.decay * model.weights[touched]
            seen[touched] += step * step
            model.weights[touched] -= rate * step / np.sqrt(seen[touched])
            sorted_ = np.argsort(inverse, kind="stable")
            cuts = np.searchsorted(inverse[sorted_], np.arange(len(touched)))
            pull = spread[:, None] * (sums[row] - terms)
            step = np.add.reduceat(pull[sorted_], cuts) + settings.decay * model.latent[touched]
            seen_latent[touched] += step * step
            model.latent[touched] -= rate * step / np.sqrt(seen_latent[touched])
            step = slope.sum()
            seen_bias += step * step
            model.bias -= rate * step / np.sqrt(seen_bias)
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Model:
    """Fit on the rows of ``labels`` (``doc_id``, ``label`` 0 or 1) that have a document.

    The sample is drawn from the labels alone, by a hash of the id; the texts of the rows drawn
    are then looked up.  A row drawn counts as much as the rows of its label it stands for, so
    that the model learns the shares of the labels whatever the size of the sample.  Null labels,
    and rows without a document of at most ``sample_chars`` characters, teach nothing.  A document
    labelled twice counts twice; of several texts of one id the one with the least SHA-256 is taken.
    """
    spark = docs.sparkSession
    drawn, rows_of = counted_sample(labels.select("doc_id", label).filter(F.col(label).isin(0, 1)), label, settings.per_label)
    if not drawn:
        return train([], [], settings)
    kind = labels.schema["doc_id"].dataType.simpleString()
    ids = sorted({row["doc_id"] for row in drawn if row["doc_id"] is not None})
    wanted = spark.createDataFrame([(key,) for key in ids], f"doc_id {kind}")  # at most 2 * per_label ids
    found = texts(docs).join(F.broadcast(wanted), "doc_id").filter(F.length("text") <= settings.sample_chars)
    found = found.groupBy("doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))

    def make():
        def work(batch):
            rows = [features(text, settings) for text in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"),
                "buckets": [row[0] for row in rows],
                "weights": [row[1] for row in rows],
                "dense": [row[2] for row in rows],
            }

        return work

    kind = found.schema["doc_id"].dataType.simpleString()
    rows = map_batches(found, make, f"doc_id {kind}, buckets array<long>, weights array<double>, dense array<double>")
    vector = {
        row["doc_id"]: (np.array(row["buckets"], np.int64), np.array(row["weights"], float), np.array(row["dense"], float))
        for row in rows.collect()
    }
    used = [row for row in drawn if row["doc_id"] in vector]
    used_of = Counter(row[label] for row in used)
    pairs = sorted((row["doc_id"], int(row[label]), rows_of[row[label]] / used_of[row[label]]) for row in used)
    return train([vector[key] for key, _, _ in pairs], [value for _, value, _ in pairs], settings, [share for _, _, share in pairs])


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the threshold).

    Null and empty texts have no words; their score comes from the statistics alone.
    """
    rows = texts(docs)

    def make():
        def work(batch):
            scores = model.score([features(text, settings) for text in batch.column("text").to_pylist()])
            return {"doc_id": batch.column("doc_id"), "score": scores, "predicted": (scores >= settings.threshold).astype(np.int32)}

        return work

    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""

    def keep(rows: list[str]) -> list[bool]:
        return (model.score([features(text, settings) for text in rows]) >= settings.threshold).tolist()

    return filter_texts(docs, lambda: keep)
