"""Operator 6: quality classifier by random Fourier features, ridge and isotonic regression.

Statistics of a text are standardised, mapped by random cosines whose inner products
approximate a Gaussian kernel, and scored by ridge weights from normal equations summed
over partitions.  An isotonic step fitted on labelled rows of another fold turns the
scores into probabilities.

Defined cases: null text counts as empty; empty texts have defined statistics and get a
score like any other; rows without a label are not learned from, rows with several labels
count once each; with labels of one kind only every score is that label's rate; with
none it is 0.5; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.session import cut_lineage, spread

FEATURES = 256
RIDGE = 1e-3
BINS = 2000
THRESHOLD = 0.3
SEED = 11

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _COMMA, _MARK, _BYTE = range(9)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[128:] = _BYTE
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"0123456789", _DIGIT),
                      (b" \t\x0b\x0c\r", _SPACE), (b"\n", _LINE), (b".?", _STOP), (b",;:'\"()-", _COMMA)):
    _KIND[list(_chars)] = _kind


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9) / n
    counts = Counter(words)
    letters = max(1e-9, kinds[_UPPER] + kinds[_LOWER] + kinds[_BYTE])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    marked = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,?;:")
    bare = sum(c for w, c in counts.items() if len(w) < 3 and not w[:1].isalnum() and w[0] < 128)
    twice = len(lines) - len(set(lines))
    pairs = Counter(zip(words, words[1:]))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), float(lengths.mean()), float(lengths.std()),
        float(np.log1p(lengths.max())), *kinds.tolist(), kinds[_UPPER] / letters, len(counts) / m,
        np.log1p(len(counts)) / np.log1p(m), max(counts.values(), default=0) / m, sum(c for c in counts.values() if c == 1) / m,
        marked / m, bare / m, twice / k, sum(x.rstrip()[-1:] in (b".", b"?") for x in lines) / k,
        np.log1p(m / k), len(pairs) / m, max(pairs.values(), default=0) / m,
        sum(c for w, c in counts.items() if w[:1].isupper()) / m, sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / m]


N_STATISTICS = len(statistics(""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]  # raw scores and probabilities, both rising

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.cos(z @ self.turns + self.shifts) * np.sqrt(2 / len(self.shifts))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # The last millionth keeps the order of raw scores inside a flat step.
        return np.clip(np.interp(raw, *self.steps) * (1 - 1e-6) + 1e-6 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(at: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in rising order; block centres and their means."""
    blocks: list[list[float]] = []
    for x, n, k in zip(at, total, ones):
        blocks.append([x * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x array<double>)``."""
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    src = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return src.select("doc_id", stats("text").alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sum_rows(df: DataFrame, per_batch, width: int, rows: int, fan: int = 32) -> np.ndarray:
    """Sum of a ``rows x width`` matrix over all partitions: each partition gives one row per matrix
    row, which Spark adds up by row number in two steps, so that the driver gets one matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for b in batches:
            if b.num_rows:
                total += per_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(list(total))], names=["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), _matrix(b.column(1)) if b.num_rows else ()):
                sums[i] = sums[i] + v if i in sums else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))],
                                         names=["i", "v"])

    ddl = "i long, v array<double>"
    parts = df.mapInArrow(run, ddl)
    parts = parts.repartition(fan, F.col("i"), F.spark_partition_id() % fan).mapInArrow(add, ddl)
    parts = parts.repartition(fan, "i").mapInArrow(add, ddl)
    out = np.zeros((rows, width))
    for r in parts.collect():  # ``rows`` rows
        out[r["i"]] = r["v"]
    return out


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, bins: int = BINS, seed: int = SEED) -> Model:
    """Fit on ``labelled (fold int, y double, x array<double>)``: fold 0 calibrates, the others train."""
    rng = np.random.default_rng(seed)
    turns = rng.normal(size=(N_STATISTICS, features)) / np.sqrt(N_STATISTICS)
    shifts = rng.uniform(0, 2 * np.pi, features)
    train, check = labelled.where("fold <> 0"), labelled.where("fold = 0")

    def moments(b):
        x = _matrix(b.column(0))
        return np.stack([x.sum(axis=0), (x * x).sum(axis=0), np.full(x.shape[1], len(x), float)])

    s, sq, n = _sum_rows(train.select("x"), moments, N_STATISTICS, 3, 4)
    if not n[0]:
        y = check.agg(F.avg("y")).first()[0]
        flat = np.array([0.5 if y is None else y])
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), turns, shifts, np.zeros(features + 1), (np.zeros(1), flat))
    mean = s / n
    model = Model(mean, np.maximum(np.sqrt(np.maximum(sq / n - mean ** 2, 0)), 1e-6), turns, shifts, np.zeros(features + 1),
                  (np.zeros(1), np.zeros(1)))

    def normal(b):
        z = model.lift(_matrix(b.column(0)))
        return np.concatenate([z.T @ z, (z.T @ b.column(1).to_numpy())[:, None]], axis=1)

    total = _sum_rows(train.select("x", "y"), normal, features + 2, features + 1)
    gram, moment = total[:, :-1], total[:, -1]
    model.weights = np.linalg.solve(gram + ridge * n[0] / features * np.eye(features + 1), moment)

    raw = check.select("x", "y").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays(
        [pa.array(model.raw(_matrix(b.column(0))) if b.num_rows else [], pa.float64()), b.column(1)], names=["raw", "y"])
        for b in batches), "raw double, y double")
    held = raw.groupBy(F.round(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) * bins / 2).alias("bin")).agg(
        F.avg("raw").alias("at"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()
    if held:  # at most ``bins`` rows
        model.steps = isotonic(*(np.array([r[c] for r in held], float) for c in ("at", "n", "ones")))
    else:
        model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score(statistics_of: DataFrame, model: Model) -> DataFrame:
    """``statistics_of`` with a ``score`` in place of ``x``."""
    known = statistics_of.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(known.value.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return statistics_of.withColumn("score", run("x")).drop("x")


def classify(docs: DataFrame, labels: DataFrame, fold_of) -> DataFrame:
    """``(doc_id, score)`` of every row.  ``fold_of(id column)``: null for rows not to learn from."""
    x = cut_lineage(with_statistics(docs), "quality-statistics")
    marks = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("y IS NOT NULL")
    learn = marks.withColumn("fold", fold_of(F.col("doc_id"))).where("fold IS NOT NULL")
    labelled = cut_lineage(x.join(learn, "doc_id").select("fold", "y", "x"), "quality-labelled")
    return score(x, fit(labelled))
