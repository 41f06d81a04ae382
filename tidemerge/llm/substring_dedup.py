"""Substring deduplication by sliding sentence spans.

Every run of RUN consecutive sentences of a document is hashed. Runs are joined over all documents; a run that occurs again keeps
its first place (smallest id, then first in the text), and every sentence covered by a later one is removed. A sentence of over
LONGEST words counts as several, cut every LONGEST words, so that a passage of over RUN x LONGEST words always holds a whole run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, dropped, fresh_worker, named, parts, record_batch, saved, settled, slim

_WIDE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
#: Sentences end at ., !, ?, the ellipsis, danda and Arabic marks before white space, at full-width marks, at line ends, and before a
#: capital (a passage put into running text starts so).
_BETWEEN = re.compile("(?<=[.!?\u2026\u0964\u061f\u06d4])\\s+|(?<=[\u3002\uff01\uff1f\uff0e])\\s*|\\s*\\n\\s*|\\s+(?=[A-Z\u00c0-\u00d6\u00d8-\u00de])")
#: Words stand between white space; of scripts written without spaces each character is a word.
_HAS_WIDE, _WORD = re.compile(f"[{_WIDE}]"), re.compile(f"[{_WIDE}]|[^\\s{_WIDE}]+")
#: Sentences of a run, and words of a sentence. Runs in more places than most (HOT runs at most) are looked up without a shuffle.
RUN, LONGEST, HOT = 6, 8, 20_000
NO_ID = (1 << 63) - 1


def _whole_sentences(text: str) -> list[tuple[int, int]]:
    out, start = [], len(text) - len(text.lstrip())
    for gap in _BETWEEN.finditer(text):
        if gap.start() > start:
            out.append((start, gap.start()))
        start = max(start, gap.end())
    if text[start:].strip():
        out.append((start, len(text.rstrip())))
    return out


def sentences_of(text: str, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, end) of each sentence of at most ``longest`` words, without the white space around it."""
    out = []
    for a, b in _whole_sentences(text):
        words = [m.span() for m in _WORD.finditer(text, a, b)]
        out += [(words[k][0], words[min(k + longest, len(words)) - 1][1]) for k in range(0, len(words), longest)]
    return out


def runs_of(text: str, run: int = RUN, longest: int = LONGEST) -> np.ndarray:
    """The 128-bit hash (two signed integers) of the words of each run of ``run`` sentences, in order."""
    import xxhash

    split, digests = _WORD.findall if _HAS_WIDE.search(text) else str.split, []
    for a, b in _whole_sentences(text):
        words = split(text[a:b].lower())
        if len(words) <= longest:
            digests.append(xxhash.xxh3_128_digest(" ".join(words)))
        else:
            digests += [xxhash.xxh3_128_digest(" ".join(words[k : k + longest])) for k in range(0, len(words), longest)]
    found = [xxhash.xxh3_128_digest(b"".join(digests[k : k + run])) for k in range(len(digests) - run + 1)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _runs(docs: DataFrame, run: int, longest: int) -> DataFrame:
    """(id, key, h1, h2, again): the hashes of a document's runs; ``again`` marks those that it has had before."""
    schema = "id long, key long, h1 array<long>, h2 array<long>, again array<boolean>"
    target = arrow_of(schema)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in parts(batches):
            out: dict[str, list] = {"id": batch.column("id"), "key": batch.column("key"), "h1": [], "h2": [], "again": []}
            for text in batch.column("text"):
                found = runs_of(text.as_py() or "", run, longest)
                again = np.ones(len(found), bool)
                again[np.unique(found, axis=0, return_index=True)[1]] = False
                out["h1"].append(found[:, 0])
                out["h2"].append(found[:, 1])
                out["again"].append(again)
            yield record_batch(target, out)

    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key", "text").mapInArrow(hashed, schema)


def repeated_runs(docs: DataFrame, run: int = RUN, longest: int = LONGEST) -> DataFrame:
    """(id, key, covers): for each document (doc_id, key, text) with later places of repeated runs, the sentences at which these start."""
    spark, runs = docs.sparkSession, saved(_runs(docs, run, longest))
    numbered = runs.withColumn("n", F.monotonically_increasing_id())  # the table is saved, so that numbers stay
    each = numbered.select("n", "id", "key", F.posexplode(F.arrays_zip("h1", "h2", "again")).alias("start", "r")).select("n", "id", "key", "start", "r.h1", "r.h2", "r.again")
    # counts and first places are sums and minima, made map-side before the shuffle
    first = saved(each.groupBy("h1", "h2").agg(F.count("*").alias("places"), F.min("id").alias("first")).where("places > 1"))
    settled(spark)
    # runs in over ``cut`` places are HOT at most; of the others none has more than 2 / HOT of all places: no hot key of the join
    sizes = first.groupBy(F.ceil(F.log2("places")).cast("int").alias("power")).agg(F.count("*").alias("runs")).collect()  # a row a power of two
    above, cut = 0, 1
    for r in sorted(sizes, key=lambda r: -r.power):
        above += r.runs
        if above > HOT:
            cut = 1 << r.power
            break
    hot = each.join(F.broadcast(first.where(F.col("places") > cut)), ["h1", "h2"])
    placed = hot.unionByName(each.join(first.where(F.col("places") <= cut), ["h1", "h2"])) if cut > 1 else hot
    later = placed.where(F.col("again") | (F.col("id") > F.col("first"))).select("n", "start")
    # documents of one id, or of none, are told apart by their texts
    shared = saved(runs.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("id"))
    if not shared.isEmpty():
        twins = each.join(shared, "id")
        lowest = twins.groupBy("h1", "h2", "id").agg(F.min("key").alias("lowest"))
        later = later.unionByName(twins.join(lowest, ["h1", "h2", "id"]).where(F.col("key") > F.col("lowest")).select("n", "start"))
    covers = later.groupBy("n").agg(F.collect_list("start").alias("covers"))
    found = saved(covers.join(numbered.select("n", "id", "key"), "n").dropDuplicates(["id", "key"]).select("id", "key", "covers"))
    dropped(runs, first, shared)
    settled(spark)
    return found


def without_sentences(text: str, starts: list[int], run: int = RUN, longest: int = LONGEST) -> tuple[str, list[tuple[int, int]], int]:
    """The text without the sentences of the runs that start so and the white space after them, what was cut as character spans, and how many sentences."""
    spans = sentences_of(text, longest)
    covered = sorted({k for start in starts for k in range(start, start + run)})
    cut: list[tuple[int, int]] = []
    for k in covered:
        a, b = spans[k][0], spans[k + 1][0] if k + 1 < len(spans) else len(text)
        if cut and cut[-1][1] == a:
            cut[-1] = (cut[-1][0], b)
        else:
            cut.append((a, b))
    kept, at = [], 0
    for a, b in [*cut, (len(text), len(text))]:
        kept.append(text[at:a])
        at = b
    return "".join(kept).rstrip() if cut else text, cut, len(covered)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, longest: int = LONGEST) -> DataFrame:
    """One row per row: doc_id, text (without later places of repeated runs), removed (array of start, end in the old text), n_removed (sentences).

    A run is repeated if its words, without regard to case and white space, occur in another document or again in the same one.
    Null texts stay null and empty ones empty; texts shorter than a run are never changed. Rows that share an id, or have none,
    are told apart by their texts; repeated rows are one document, and each loses the same. A null id is never first where
    another id has the run. Other columns are ignored.
    """
    rows = slim(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    covers = repeated_runs(rows, run, longest).withColumnRenamed("key", "k")
    joined = rows.join(covers, (F.col("key") == F.col("k")) & (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("id")), "left").select("doc_id", "text", "covers")
    schema = "doc_id long, text string, removed array<struct<start:int,end:int>>, n_removed int"
    target = arrow_of(schema)

    def cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in parts(batches):
            texts, cuts, counts = [], [], []
            for text, cover in zip(batch.column("text"), batch.column("covers"), strict=True):
                kept, cut, n = without_sentences(text.as_py(), cover.as_py(), run, longest) if cover.is_valid else (text.as_py(), [], 0)
                texts.append(kept)
                cuts.append([{"start": a, "end": b} for a, b in cut])
                counts.append(n)
            yield record_batch(target, {"doc_id": batch.column("doc_id"), "text": texts, "removed": cuts, "n_removed": counts})

    return joined.mapInArrow(cleaned, schema)


def rewritten(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, with all their columns, in the texts of ``deduplicate``; those of which nothing is left go.

    Where there is a column of lengths, it holds the new text's characters in each row whose text has changed.
    """
    whole = docs.select(*(named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)), named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), F.xxhash64(named(text_col)).alias("key"))
    covers = repeated_runs(whole.select("doc_id", "text", "key")).withColumnRenamed("key", "k")
    joined = whole.join(covers, (F.col("key") == F.col("k")) & (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("id")), "left").drop("doc_id", "text", "key", "id", "k")
    at, columns = f"c{docs.columns.index(text_col)}", [f"c{k}" for k in range(len(docs.columns))]
    size = f"c{docs.columns.index(length_col)}" if length_col in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in parts(batches):
            texts, changed = batch.column(at).to_pylist(), {}
            for i, cover in enumerate(batch.column("covers")):
                if cover.is_valid:
                    changed[i] = without_sentences(texts[i], cover.as_py())[0]
            texts = [changed.get(i, text) for i, text in enumerate(texts)]
            arrays = []
            for c in columns:
                array = batch.column(c)
                if c == at:
                    array = pa.array(texts, array.type)
                elif c == size and changed:
                    array = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(array.to_pylist())], array.type)
                arrays.append(array)
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array([text != "" or i not in changed for i, text in enumerate(texts)], pa.bool_()))

    schema = joined.select(*columns).schema
    return joined.mapInArrow(run, schema).toDF(*docs.columns)
