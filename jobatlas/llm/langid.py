"""Operator 1: language identification by error-correcting output codes.

Each language has a codeword; each bit of it is a binary question (does the text belong to
one of *these* languages?) answered by a linear classifier over hashed byte n-grams, whose
weights are the log ratio of the two sides' n-gram rates.  Decoding weighs each bit by how
often it was right for the language on labelled rows and takes the codeword with the
smallest weighted loss; where the runner-up is nearly as close, the answer is ambiguous.

Fitting reads at most about ``FIT_ROWS`` labelled rows a language (chosen by a hash of the
id) for the rates, summed per partition, and about ``CHECK_ROWS`` in all for the bit weights.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without
a label or without an id are never learned from; with one learned language every text with
letters is of it; with none every text is ``und``; an empty table gives an empty result;
extra columns come back untouched from :func:`identify`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.session import spread

UND = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (2, 3, 4)
FIT_ROWS = 20_000
CHECK_ROWS = 20_000
#: Ambiguous: the winner's share of the two best languages' likelihood is below this.
AMBIGUOUS_BELOW = 0.6
SMOOTHING = 1e-6
#: Each text counts with weight one, as whole units of 1 / UNIT (integer sums do not depend on their order).
UNIT = 1 << 24

_NO_LETTER = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: str | None) -> np.ndarray | None:
    """Buckets of the n-grams of the lower-cased words (UTF-8 bytes, a space round each word); None if no letter."""
    if not text:
        return None
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_NO_LETTER)
    words = raw.split()
    if not words or (not any(w.isascii() for w in words) and not any(c.isalpha() for c in text)):
        return None
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    parts, g = [], x
    for n in range(2, max(ORDERS) + 1):
        g = g[:len(x) - n + 1] | (x[n - 1:] << np.uint32(8 * (n - 1))) if len(x) >= n else x[:0]
        if n in ORDERS:
            parts.append(((g + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(parts)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords of +1 / -1, one row each: all splits of up to five languages, else the most distant of
    some random codes of 10 log2 n bits."""
    if n <= 5:
        splits = [s for r in range(n) for s in combinations(range(1, n), r) if len(s) < n - 1]
        return np.array([[1 if i == 0 or i in s else -1 for s in splits] for i in range(n)]).reshape(n, len(splits))
    bits, rng, best, far = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, bits))
        code = code[:, abs(code.sum(axis=0)) < n]
        apart = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(n), 2))
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # bucket x bit
    trust: np.ndarray  # language x bit, each row sums to 1
    heat: float

    def margins(self, buckets: np.ndarray) -> np.ndarray:
        counts = np.bincount(buckets, minlength=BUCKETS).astype(np.float32)
        return (counts @ self.weights) / max(1, len(buckets))

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword (last axis: languages)."""
        each = np.log1p(np.exp(-self.heat * margins[..., None, :] * self.code))
        return (each * self.trust).sum(axis=-1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        buckets = grams(text)
        if buckets is None or not self.langs:
            return UND, 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = self.losses(self.margins(buckets)) * self.code.shape[1]
        p = np.exp(loss.min() - loss)
        best, second = np.argsort(loss, kind="stable")[:2]
        return self.langs[best], float(p[best] / p.sum()), bool(p[best] / (p[best] + p[second]) < AMBIGUOUS_BELOW)


def _rates(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), BUCKETS), np.int64)
        place = {x: i for i, x in enumerate(langs)}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = grams(text)
                if g is not None and lang in place:
                    sums[place[lang]] += np.bincount(g, minlength=BUCKETS) * UNIT // len(g)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], names=["lang", "bucket", "n"])
    return run


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, check_rows: int = CHECK_ROWS) -> Model:
    """Fit on ``labelled (doc_id, lang, text)``."""
    rows = labelled.select("doc_id", "lang", "text").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((BUCKETS, 0), np.float32), np.zeros((len(langs), 0)), 1.0)

    def some(seed: int, wanted: dict[str, float]) -> DataFrame:
        share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, wanted[k] / sizes[k])))])
        spot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(1 << 30)
        return spread(rows.where(spot < F.try_element_at(share, F.col("lang"))).select("lang", "text"))

    sums = np.zeros((len(langs), BUCKETS))
    counted = some(1, {k: float(fit_rows) for k in langs}).mapInArrow(_rates(langs), "lang long, bucket long, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS rows at most
    sums[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    rates = sums / np.maximum(1, sums.sum(axis=1, keepdims=True)) + SMOOTHING
    sides = [(rates[code[:, b] > 0].mean(axis=0), rates[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]
    weights = np.stack([np.log(yes / no) for yes, no in sides], axis=1).astype(np.float32)
    model = Model(langs, code, weights, np.full(code.shape, 1 / code.shape[1]), 1.0)

    known = labelled.sparkSession.sparkContext.broadcast(model)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang, known.value.margins(g).tolist()) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                     if (g := grams(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()),
                                              pa.array([x[1] for x in found], pa.list_(pa.float64()))], names=["lang", "m"])

    checked = some(2, {k: check_rows / len(langs) for k in langs}).mapInArrow(answers, "lang string, m array<double>").collect()
    if checked:
        truth = np.array([langs.index(r["lang"]) for r in checked])
        m = np.array([r["m"] for r in checked])
        right = m * code[truth] > 0
        hits = np.stack([right[truth == i].mean(axis=0) if (truth == i).any() else np.ones(code.shape[1])
                         for i in range(len(langs))])
        model.trust = (hits + 1e-3) / (hits + 1e-3).sum(axis=1, keepdims=True)

        def regret(heat: float) -> float:
            model.heat = heat
            loss = model.losses(m) * code.shape[1]
            p = np.exp(loss.min(axis=1, keepdims=True) - loss)
            return float(-np.log(p[np.arange(len(truth)), truth] / p.sum(axis=1) + 1e-9).mean())

        # The gentlest heat that loses next to nothing: separable rows would ask for an endless one.
        tried = {heat: regret(heat) for heat in (2.0 ** e for e in range(-2, 6))}
        model.heat = min(h for h, r in tried.items() if r <= min(tried.values()) + 0.01)
    return model


def predictor(docs: DataFrame, model: Model):
    """A column function: text -> struct(lang_pred, score, ambiguous)."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([known.value.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    def of(text: str | Column) -> Column:
        return predict(F.col(text) if isinstance(text, str) else text)
    return of


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def accepted(docs: DataFrame, fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """The rows of ``docs`` whose text has an unambiguous language; learned from the rows outside the fold."""
    known = docs.select("doc_id", "lang", "text")
    model = fit(known.where(~held_out(F.col("doc_id"), *fold)))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    answer = predictor(docs, model)(F.col(names[docs.columns.index("text")]).cast("string"))
    kept = plain.withColumn("answer", answer).where(f"answer.lang_pred <> '{UND}' AND NOT answer.ambiguous")
    return kept.drop("answer").toDF(*docs.columns)
