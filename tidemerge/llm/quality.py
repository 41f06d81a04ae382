"""Quality by ordinal cumulative-link regression on graded ratings.

A text is hashed to shares of token buckets, one weight vector turns them into one latent value, and ordered thresholds cut it
into grades: P(grade > k) = sigmoid(value - threshold[k]). The expected grade and the tail probabilities drive selection.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, held_out_fold, record_batch, slim

#: Documented bounds: rated rows that the fit looks at, and buckets.
SAMPLE_ROWS, BUCKETS = 8_000, 1 << 15
#: Shares are scaled by this before the fit.
SCALE = 20.0
_TOKEN = re.compile(r"\w+|[^\w\s]+")
CAPITALS, REPEATED = 0, 1  # buckets of their own: words all in capitals, and words like the one before


def tokens_of(text: str | None) -> list[str]:
    """Words and runs of signs, as they stand."""
    return _TOKEN.findall(text or "")


def buckets_of(token: str) -> tuple[int, ...]:
    own = 2 + zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % (BUCKETS - 2)
    return (own, CAPITALS) if len(token) > 1 and token.isupper() else (own,)


def shares_of(text: str | None) -> dict[int, float]:
    """Bucket -> its share of the text's tokens, scaled. Nothing for a text without tokens."""
    tokens, out = tokens_of(text), Counter()
    for token, n in Counter(tokens).items():
        for bucket in buckets_of(token):
            out[bucket] += n
    if repeats := sum(map(eq, tokens, tokens[1:])):
        out[REPEATED] += repeats
    return {b: SCALE * n / len(tokens) for b, n in sorted(out.items())}


@dataclass
class OrdinalModel:
    """weights by bucket; thresholds, ascending: one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    memo_tokens: int = 300_000
    grades: list[int] = field(default_factory=list)

    def tails(self, value: float) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(value - self.thresholds, -60, 60)))

    def valuer(self):
        """A function text -> latent value, None without tokens; with a bounded memo of tokens."""
        weights = self.weights

        class Memo(dict):
            def __missing__(self, token: str) -> float:
                value = self[token] = float(sum(weights[b] for b in buckets_of(token)))
                return value

        memo = Memo()

        def value(text: str | None) -> float | None:
            tokens = tokens_of(text)
            if not tokens:
                return None
            if len(memo) > self.memo_tokens:
                memo.clear()
            return SCALE * (sum(map(memo.__getitem__, tokens)) + weights[REPEATED] * sum(map(eq, tokens, tokens[1:]))) / len(tokens)

        return value


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, rounds: int = 300, ridge: float = 1e-4, rate: float = 0.05) -> OrdinalModel:
    """Likelihood of the cumulative-link model by Adam; thresholds stay ordered as a first one plus positive gaps."""
    lengths = np.array([len(b) for b, _ in rows])
    at = np.repeat(np.arange(len(rows)), lengths)
    bucket = np.concatenate([b for b, _ in rows]) if len(rows) else np.zeros(0, np.int64)
    share = np.concatenate([v for _, v in rows]) if len(rows) else np.zeros(0)
    above = np.array([(grades > k).mean() for k in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    params = np.concatenate([np.zeros(BUCKETS), start[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, theta = params[:BUCKETS], np.cumsum(np.concatenate([params[BUCKETS : BUCKETS + 1], np.exp(params[BUCKETS + 1 :])]))
        z = np.bincount(at, share * w[bucket], minlength=len(rows))
        tail = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None], -40, 40)))  # P(grade > k)
        full = np.hstack([np.ones((len(z), 1)), tail, np.zeros((len(z), 1))])
        i = np.arange(len(z))
        p = np.maximum(full[i, grades] - full[i, grades + 1], 1e-9)
        slope = full * (1 - full)
        dz = -(slope[i, grades] - slope[i, grades + 1]) / p
        dtheta = np.zeros(levels - 1)
        for k in range(levels - 1):
            dtheta[k] = (slope[:, k + 1] * ((grades == k + 1) / p - (grades == k) / p)).sum()
        g = np.zeros_like(params)
        g[:BUCKETS] = np.bincount(bucket, share * dz[at], minlength=BUCKETS) / len(rows) + ridge * w
        g[BUCKETS] = dtheta.sum() / len(rows)
        for k in range(1, levels - 1):
            g[BUCKETS + k] = dtheta[k:].sum() / len(rows) * np.exp(params[BUCKETS + k])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = np.cumsum(np.concatenate([params[BUCKETS : BUCKETS + 1], np.exp(params[BUCKETS + 1 :])]))
    return OrdinalModel(params[:BUCKETS], theta)


def fit(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel | None:
    """Fit on a bounded sample (about ``sample_rows``) of rated rows outside the held-out fold; whole texts.

    Grades are any integers; their order is what counts. Of several ratings of a document the lowest counts; null ratings count
    for nothing. None if there are fewer than two grades.
    """
    rows = slim(ratings, doc_id=id_col, grade=grade_col).select(F.col("doc_id").cast("long"), F.col("grade").cast("int"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull() & ~held_out_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    total = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * sample_rows / max(1, total))))  # about sample_rows ids
    texts = slim(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")
    schema = "doc_id long, grade int, buckets array<int>, shares array<float>"
    target = arrow_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shares_of(x.as_py()) for x in batch.column("text")]
            yield record_batch(target, {"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "buckets": [list(x) for x in found], "shares": [list(x.values()) for x in found]})

    seen = texts.mapInArrow(run, schema).toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    grades = sorted(set(seen.column("grade").to_pylist()))
    if len(grades) < 2:
        return None
    place = {g: k for k, g in enumerate(grades)}
    sparse = [(np.array(b.as_py(), np.int64), np.array(s.as_py(), np.float64)) for b, s in zip(seen.column("buckets"), seen.column("shares"), strict=True)]
    model = fit_ordinal(sparse, np.array([place[g] for g in seen.column("grade").to_pylist()]), len(grades))
    model.grades = grades
    return model


def grade(docs: DataFrame, model: OrdinalModel | None, *, id_col: str = "doc_id", text_col: str = "text", tail: int = 0, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_grade, tails (P(grade > k) for all grades but the last), selected (1 if tails[tail] >= least).

    The whole text decides, nothing else. Null, empty and blank texts get the lowest grade, tails of 0 and are not selected. Without
    a model (fewer than two grades rated) expected_grade is null, tails empty and every other document selected. Repeated rows are
    graded row by row; other columns are ignored.
    """
    rows = slim(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.array().cast("array<double>").alias("tails"), F.coalesce(F.col("text").rlike("\\S"), F.lit(False)).cast("int").alias("selected"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    schema = "doc_id long, expected_grade double, tails array<double>, selected int"
    target = arrow_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        value, steps = model.valuer(), np.diff(model.grades)
        for batch in batches:
            values = [value(x.as_py()) for x in batch.column("text")]
            tails = [np.zeros(len(steps)) if v is None else model.tails(v) for v in values]
            expected = [model.grades[0] + float(steps @ t) for t in tails]
            yield record_batch(target, {"doc_id": batch.column("doc_id"), "expected_grade": expected, "tails": [t.tolist() for t in tails], "selected": [int(v is not None and t[tail] >= least) for v, t in zip(values, tails, strict=True)]})

    return rows.mapInArrow(run, schema)
