"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are cut into bins; shallow trees boosted in turn on
one feature after the other add up to one lookup table for each feature, then
trees on the pairs that explain most of what is left add up to a small grid
for each of them. A score is the logistic function of the sum of the entries
that a text's bins point at.

The model is fitted on the driver from the features (not the texts) of at most
``SAMPLE`` labelled rows, those with the lowest hash of doc_id. Null texts
count as empty and get a score like any other. Without labels, or with one
class only, every text gets the share of good labels (0.5 without any).
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIRS, PAIR_ROUNDS = 150, 8, 60
RATE, LEAVES, LEAST_ROWS = 0.1, 3, 20
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "repeats_next", "distinct_lines", "line_words",
    "symbols", "exclamations", "bars", "upper", "digits", "stops", "other_ascii", "beyond_ascii", "ends_in_symbol",
)
_SYMBOLS, _STOPS = b"#*$%&<>@^~=_+{}[]\\`", b".,;:?"
_LETTERS = [*range(65, 91), *range(97, 123)]


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(counts[_LETTERS].sum()))
    tally = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    of = lambda chars: float(counts[list(chars)].sum())
    symbols, stops, bangs, bars = of(_SYMBOLS), of(_STOPS), of(b"!"), of(b"|")
    digits = of(b"0123456789")
    other = float(counts[33:127].sum()) - letters - symbols - stops - bangs - bars - digits
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / n, len(tally) / n,
        (max(tally.values()) if tally else 0) / n, sum(map(operator.eq, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        symbols / size, bangs / n, bars / n, float(counts[65:91].sum()) / letters, digits / size, stops / n, max(0.0, other) / size, float(counts[128:].sum()) / size,
        sum(w[-1:] in b"#*$%&!|" for w in words) / n,
    ]


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[at[:, j]]
        for i, j, grid in self.pairs:
            out += grid[self.coarse(i, at[:, i]), self.coarse(j, at[:, j])]
        return out

    def coarse(self, j: int, at: np.ndarray) -> np.ndarray:
        """Bins of a pair's grid: neighbouring bins of the feature together."""
        return at * PAIR_BINS // (len(self.cuts[j]) + 1) if len(self.cuts[j]) >= PAIR_BINS else at

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _steps(gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of a shallow tree over ordered bins: the best cut of the best part, LEAVES - 1 times."""
    parts = [(0, len(gradient))]
    gain_of = lambda g, h: g * g / (h + 1.0)
    for _ in range(LEAVES - 1):
        best = None
        for a, b in parts:
            g, h, n = gradient[a:b].cumsum(), hessian[a:b].cumsum(), rows[a:b].cumsum()
            for k in range(b - a - 1):
                if n[k] >= LEAST_ROWS and n[-1] - n[k] >= LEAST_ROWS:
                    gain = gain_of(g[k], h[k]) + gain_of(g[-1] - g[k], h[-1] - h[k]) - gain_of(g[-1], h[-1])
                    if best is None or gain > best[0]:
                        best = (gain, a, a + k + 1, b)
        if best is None or best[0] <= 1e-9:
            break
        _, a, m, b = best
        parts = sorted([p for p in parts if p != (a, b)] + [(a, m), (m, b)])
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (hessian[a:b].sum() + 1.0)
    return out


def _corners(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on either feature of a grid: (gain, its values)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, values = 0.0, np.zeros_like(g)
    total_g, total_h = cg[-1, -1], ch[-1, -1]
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            gs = np.array([cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], total_g - cg[i, -1] - cg[-1, j] + cg[i, j]])
            hs = np.array([ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], total_h - ch[i, -1] - ch[-1, j] + ch[i, j]])
            gain = float((gs * gs / (hs + 1.0)).sum() - total_g**2 / (total_h + 1.0))
            if gain > best:
                best, leaf = gain, gs / (hs + 1.0)
                values = np.empty_like(g)
                values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Model(30.0 if share == 1 else -30.0 if len(y) and share == 0 else 0.0)
    model = Model(float(np.log(share / (1 - share))))
    for j in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    at = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    raw = np.full(len(y), model.base)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-raw))), np.maximum(p * (1 - p), 1e-6))
    in_bin = [np.bincount(at[:, j], minlength=s) for j, s in enumerate(sizes)]
    for _ in range(ROUNDS):
        for j, s in enumerate(sizes):
            g, h = slope()
            step = RATE * _steps(np.bincount(at[:, j], g, s), np.bincount(at[:, j], h, s), in_bin[j])
            model.tables[j] += step
            raw += step[at[:, j]]
    coarse = [model.coarse(j, at[:, j]) for j in range(len(sizes))]
    wide = [int(c.max()) + 1 for c in coarse]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slope()
        cell = coarse[i] * wide[j] + coarse[j]
        return tuple(np.bincount(cell, v, wide[i] * wide[j]).reshape(wide[i], wide[j]) for v in (g, h))

    found = sorted(((-_corners(*grids(i, j))[0], i, j) for i in range(len(sizes)) for j in range(i)), key=lambda t: t)[:PAIRS]
    chosen = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for gain, i, j in found if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, grid in chosen:
            step = RATE * _corners(*grids(i, j))[1]
            grid[: wide[i], : wide[j]] += step
            raw += step[coarse[i], coarse[j]]
    model.pairs = chosen
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on ``labels`` (doc_id, quality) and the texts of ``docs``; at most ``sample`` rows, so the join is a broadcast of that bound."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = known.select(F.col("doc_id").alias("__doc"), "__quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__doc")).select("doc_id", "text", "__quality")

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                import pyarrow as pa

                x = pa.array([features(t) for t in part.column(1).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), x, part.column(2).cast(pa.int32())], names=["doc_id", "x", "quality"])

    found = rows.mapInArrow(work, "doc_id long, x array<double>, quality int").toPandas().sort_values(["doc_id", "quality"])
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array(found["x"].tolist()), found["quality"].to_numpy(float))


def score(model: Model, text: Column) -> Column:
    """The model's score of a text column."""

    @F.pandas_udf("double")
    def turn(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            part = texts.iloc[at : at + 256]
            out[at : at + len(part)] = model.score(np.array([features(t) for t in part]))
        return pd.Series(out)

    return turn(text)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted); held-out labels aren't looked at."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return docs.where(score(model, F.col("text")) >= threshold)
