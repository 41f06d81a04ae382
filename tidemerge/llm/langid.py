"""Language identification, words first.

A known word is scored by its log frequency in each language. An unknown word falls back to its character 5-grams, then
4-grams, and so on: the longest length of which the table knows any gram decides. A text's scores are the means over its words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_of, held_out_fold, kept_in_worker, parts, record_batch, slim

WORD = re.compile(r"[^\W\d_]+")
#: Documented bounds of the fit: labelled rows per language, words and grams of each length kept per language. With more languages
#: than MOST_LANGUAGES the fit fails: the column can't hold languages.
SAMPLE_ROWS, MOST_LANGUAGES, TOP_WORDS, TOP_GRAMS, LONGEST = 4_000, 2_000, 20_000, 8_000, 5
#: The means over a text's words count as so many independent words at most, however long the text: words of one text go together.
INDEPENDENT = 20


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies by language: ``tables[0]`` of words, ``tables[n]`` of character n-grams."""

    languages: list[str]
    tables: list[dict[str, np.ndarray]]
    memo_words: int = 300_000
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, word: str) -> np.ndarray:
        """Log frequency in each language, less the mean over languages."""
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for n in range(len(self.tables) - 1, 0, -1):
            found = [g for g in (self.tables[n].get(x) for x in grams_of(word, n)) if g is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages), np.float32)

    def predictor(self):
        """A function text -> (language, probability) with a bounded memo of words."""
        places = _Places(self.score, len(self.languages))

        def predict(text: str | None) -> tuple[str, float]:
            words = words_of(text)
            if not words or not self.languages or not any(map(str.isalpha, text)):
                return "und", 0.0
            if len(places) > self.memo_words:
                places.clear()
            at = np.array(list(map(places.__getitem__, words)))  # first, for new words may move the rows
            mean = places.rows[at].mean(0, dtype=np.float64)
            odds = np.exp((mean - mean.max()) * (len(words) / (1 + len(words) / INDEPENDENT)))
            best = int(mean.argmax())  # ties to the first in name order
            return self.languages[best], float(odds[best] / odds.sum())

        return predict


class _Places(dict):
    """Words and their row in a growing matrix of scores."""

    def __init__(self, score, languages: int):
        self.score, self.rows = score, np.zeros((1024, languages), np.float32)
        super().__init__()

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        if place >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[place] = self.score(word)
        return place


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on labelled rows outside the held-out fold: a hash sample of about ``sample_rows`` rows a language, whole texts.

    The number of labelled rows is counted over all documents; the sample is bounded, so the counts of words and grams that
    reach the driver are too (TOP_WORDS and TOP_GRAMS a language and length). More than MOST_LANGUAGES languages are an error.
    """
    rows = slim(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out_fold(F.col("doc_id")))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different values in the column of languages")
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return LanguageModel([], [{}])
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 30, int((1 << 30) * sample_rows / r["count"]))) for r in found], "lang string, share long")
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share")).select("lang", "text")
    target = arrow_of("lang string, n int, gram string, hits long")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang = lang.as_py()
                words.update((lang, word) for word in words_of(text.as_py()))
                if len(words) > 200_000:
                    yield from counts(words)
                    words.clear()
        yield from counts(words)

    def counts(words: Counter) -> Iterator[pa.RecordBatch]:
        """Words and their grams, in batches of bounded size however long a word is."""
        out: Counter = Counter()
        for (lang, word), hits in words.items():
            out[lang, 0, word] += hits
            for n in range(1, LONGEST + 1):
                for start in range(0, len(word) + 2, 100_000):
                    piece = f"<{word}>"[start : start + 100_000 + n - 1]
                    for i in range(len(piece) - n + 1):
                        out[lang, n, piece[i : i + n]] += hits
                    if len(out) > 1_000_000:
                        yield batch_of(out)
                        out.clear()
        yield batch_of(out)

    def batch_of(counted: Counter) -> pa.RecordBatch:
        keys = list(counted)
        return record_batch(target, {"lang": [k[0] for k in keys], "n": [k[1] for k in keys], "gram": [k[2] for k in keys], "hits": list(counted.values())})

    counted = sample.mapInArrow(count, "lang string, n int, gram string, hits long").groupBy("lang", "n", "gram").agg(F.sum("hits").alias("hits"))
    top = Window.partitionBy("lang", "n").orderBy(F.desc("hits"), "gram")
    kept = counted.withColumn("place", F.row_number().over(top)).where(F.col("place") <= F.when(F.col("n") == 0, TOP_WORDS).otherwise(TOP_GRAMS))
    known = kept.where((F.col("n") > 0) | (F.col("hits") > 1)).select("lang", "n", "gram", "hits").toArrow()  # bounded, see above
    at, hits = {x: i for i, x in enumerate(languages)}, [dict() for _ in range(LONGEST + 1)]
    for lang, n, gram, number in zip(*(known.column(c).to_pylist() for c in ("lang", "n", "gram", "hits")), strict=True):
        hits[n].setdefault(gram, np.zeros(len(languages)))[at[lang]] = number
    tables = []
    for table in hits:
        totals = sum(table.values(), np.ones(len(languages)))
        logs = {gram: np.log((x + 0.5) / totals) for gram, x in table.items()}
        tables.append({gram: (x - x.mean()).astype(np.float32) for gram, x in logs.items()})
    return LanguageModel(languages, tables)


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1), by the whole text alone.

    Null texts and texts without letters give ``und`` with score 0, as does any text if nothing was labelled. Ties go to the
    first language by name. Repeated rows are scored row by row; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit
    target = arrow_of("doc_id long, lang_pred string, score double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        predict = kept_in_worker(("languages", model.name), model.predictor)
        for batch in parts(batches, 2000):
            found = [predict(x.as_py()) for x in batch.column("text")]
            yield record_batch(target, {"doc_id": batch.column("doc_id"), "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    return slim(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
