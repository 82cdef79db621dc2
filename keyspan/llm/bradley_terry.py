"""Quality scores from preference pairs (Bradley-Terry).

A document has a strength s = w . x, where x are statistics of its whole text, and
the better of two is preferred with probability 1 / (1 + exp(s_worse - s_better)).
So w is fitted by logistic loss on differences of features over pairs of a good and a
bad labelled document (Newton steps, ridge penalty).  The threshold is the quantile
of the fitted rows' scores that separates their labels best; score = 1 / (1 +
exp(threshold - s)), so 0.5 is the threshold.

The fit uses at most ``Settings.rows`` labelled rows (those with the least hashes, half
of them of each label where both have as many) and ``Settings.pairs`` pairs, whatever
the size of the input; every document is scored.

Results for edge cases: null and empty texts have a score as any other (of zero
statistics); without both labels no pair exists and every score is 0.5, predicted 1;
repeated rows give repeated rows with equal scores; a null doc_id is scored, and held
out is false; null labels are left out; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import as_binary, map_arrow, pieces


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit."""

    rows: int = 20_000
    pairs: int = 60_000
    ridge: float = 1e-2
    steps: int = 30
    seed: int = 17


_MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)


def _distinct(codes: np.ndarray) -> int:
    ordered = np.sort(codes)
    return int((ordered[1:] != ordered[:-1]).sum()) + (len(ordered) > 0)


def features(text: bytes) -> np.ndarray:
    """Statistics of a whole text; the same length for every text."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    share = counts / max(n, 1)
    words = text.split()
    n_words = len(words)
    by_word = Counter(words)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    by_line = Counter(lines)
    letters = counts[_UPPER].sum() + counts[_LOWER].sum()
    lengths = np.fromiter(map(len, words), float, n_words) if n_words else np.zeros(1)
    sum_squares = sum([c * c for c in by_word.values()])
    endings = np.bincount(np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8), minlength=256)
    distinct = list(by_word)
    number = dict(zip(distinct, range(len(distinct))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n_words)
    twos = ids[:-1] * len(distinct) + ids[1:]
    threes = twos[:-1] * np.int64(1_000_003) + ids[2:]  # a hash: a rare clash moves a share by one word's
    capitals = sum(by_word[w] for w in distinct if w.isupper() and len(w) > 1)
    dense = [
        np.log1p(n_words),
        lengths.mean(),
        np.log1p(lengths.max()),
        lengths.std(),
        len(by_word) / max(n_words, 1),
        np.sqrt(sum_squares) / max(n_words, 1),
        1 - _distinct(twos) / max(len(twos), 1),
        1 - _distinct(threes) / max(len(threes), 1),
        1 - len(by_line) / max(len(lines), 1),
        len(lines) / max(n_words, 1),
        counts[_UPPER].sum() / max(letters, 1),
        counts[_DIGIT].sum() / max(n, 1),
        counts[128:].sum() / max(n, 1),
        capitals / max(n_words, 1),
        endings[_MARKS].sum() / max(n_words, 1),
        endings[ord(".")] / max(n_words, 1),
        endings[ord(",")] / max(n_words, 1),
    ]
    logs = np.log1p(1000 * share[_MARKS])
    return np.concatenate([dense, logs])


WIDTH = len(features(b""))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - self.centre) / self.spread).clip(-8, 8) @ self.weights
        return 1 / (1 + np.exp(np.clip(self.threshold - strength, -700, 700)))


def pairs(good: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The better and the worse row of each pair: both lists are gone through in shuffled rounds, so rows take part alike."""
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    draw, n = np.random.default_rng(settings.seed), min(settings.pairs, len(better) * len(worse))
    rounds = lambda rows: np.concatenate([draw.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]
    return rounds(better), rounds(worse)


def fit(x: np.ndarray, good: np.ndarray, settings: Settings = Settings()) -> Model:
    """Weights from pairs, and the quantile threshold. ``good``: 0 or 1 for each row of x."""
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(better) or not len(worse):
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), np.ones(WIDTH), 0.0)
    centre, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = ((x - centre) / spread).clip(-8, 8)
    first, second = pairs(good, settings)
    d, n = z[first] - z[second], len(first)
    w = np.zeros(WIDTH)
    for _ in range(settings.steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # of the wrong preference
        gradient = settings.ridge * w - d.T @ p / n
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + settings.ridge * np.eye(WIDTH)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    ranked, labels = s[order], good[order]
    # Quantile q: rows below are called bad. Balanced accuracy, so that a rare label counts.
    bad_below = np.concatenate([[0], np.cumsum(labels == 0)]) / len(worse)
    good_below = np.concatenate([[0], np.cumsum(labels == 1)]) / len(better)
    balance = bad_below - good_below
    best = np.flatnonzero(balance >= balance.max() - 1e-12)
    k = int(best[len(best) // 2])
    low, high = ranked[max(k - 1, 0)], ranked[min(k, len(ranked) - 1)]
    return Model(w, centre, spread, float((low + high) / 2))


def held_out(id_column: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """The model of the labelled rows that are not held out."""
    known = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("good"))
    known = known.where(F.col("id").isNotNull() & F.col("good").isin(0, 1)).where(~held_out("id"))
    least = lambda g: known.where(F.col("good") == g).orderBy(F.xxhash64("id"), "id").limit(settings.rows // 2)
    # At most ``settings.rows`` ids, so they may be broadcast whatever the input.
    sample = F.broadcast(least(0).unionByName(least(1)))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = texts.join(sample, "id").select("id", "good", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or b"").astype("<f4").tobytes() for t in as_binary(batch.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["id", "good", "x"])

    table = rows.mapInArrow(run, "id long, good int, x binary").toArrow().sort_by([("id", "ascending"), ("good", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(table["x"].to_pylist()), "<f4").astype(float).reshape(-1, WIDTH)
    return fit(x, table["good"].to_numpy(), settings)


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: bool = False) -> DataFrame:
    """id and score of every document (with ``keep``: ``own``, all its columns as one, and the score).

    Texts are scored in slices of bounded size, whatever an Arrow batch holds.
    """
    packed = tuple(np.asarray(v) for v in (model.weights, model.centre, model.spread)), model.threshold

    def score(texts: list[bytes | None]) -> np.ndarray:
        arrays, threshold = packed
        if not texts:
            return np.zeros(0)
        x = np.stack([features(t or b"").astype("<f4") for t in texts]).astype(float)
        return Model(*arrays, threshold).scores(x)

    if not keep:
        rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
        make = lambda: lambda batch: {"id": batch.column(0), "score": score(as_binary(batch.column(1)).to_pylist())}
        return map_arrow(rows, make, "id long, score double", "text").withColumnRenamed("id", id_column)

    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        found = [score(as_binary(part.column(0)).to_pylist()) for part in pieces([pa.RecordBatch.from_arrays([texts], names=["text"])], "text")]
        return pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    return docs.select(own, score_of(F.col(f"`{text_column}`").cast("string")).alias("score"))


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fitted(docs, labels, settings, id_column, text_column)
    return scored(docs, model, id_column, text_column).select(
        id_column, held_out(id_column).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
