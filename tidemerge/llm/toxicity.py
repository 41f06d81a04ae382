"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on ordinary and one on toxic windows. Every window of a document (a
few words in a row) is compressed with both; the toxic dictionary saves bytes on windows like its own. The histogram of bytes
saved, with calibrated thresholds, gives the document's probability of being labelled toxic.

A toxic document is mostly ordinary text, which would fill its dictionary too. So both dictionaries end with the same part, trained
on ordinary windows, and the part of its own that stands before is trained on what the shared part does not compress: the words of
toxic (or as many ordinary) documents that cost several bytes with it. Then the toxic part is trained again on those windows of toxic
documents that it saves more on than on ordinary ones. Of a few sizes and rounds, the one that predicts the calibration fold best stays.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, held_out_fold, kept_in_worker, record_batch, slim, unsigned_crc32

#: Documented bounds of the fit: labelled rows of each class, and bytes of their texts together.
TOXIC_ROWS, ORDINARY_ROWS, FIT_BYTES = 3_000, 6_000, 32 << 20
#: A window has WORDS words and starts every STEP words; words of over LONG bytes are read in overlapping pieces.
WORDS, STEP, LONG = 3, 2, 48
#: Compression level, most bytes counted, and the least cost in bytes of a word that the shared part doesn't know.
LEVEL, MOST_SAVED, COST = 5, 8, 5
#: Tried on the calibration fold: bytes of the shared part, bytes of the own part, shortest match; and rounds of training again.
SETTINGS, ROUNDS, TRIED = ((32_768, 1024, 6), (65_536, 2048, 5), (65_536, 1024, 6)), 2, 1_200
#: Ordinary words at either side of a window: zstandard looks for no match in the last bytes of what it compresses.
FRAME = b"the and that %b with this for"
_NOT_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, lower case; longer ones in overlapping pieces, so that any text is read whole."""
    words = _NOT_LETTERS.sub(b" ", (text or "").lower().encode()).split()
    if words and max(map(len, words)) > LONG:
        words = [w[k : k + LONG] for w in words for k in range(0, max(1, len(w) - LONG // 3), LONG - LONG // 3)]
    return words


def windows_of(words: list[bytes], step: int) -> list[bytes]:
    """WORDS words in a row, from every ``step``-th word on; each word is in a window."""
    return [b" ".join(words[k : k + WORDS]) for k in range(0, max(1, len(words) - WORDS + step), step)] if words else []


@dataclass
class ToxicityModel:
    """Two dictionaries, and the weights of the calibration. Without dictionaries every score is ``prior``."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    prior: float = 0.0
    shortest: int = 6

    def scorer(self):
        """A function text -> probability."""
        if not self.toxic:
            return lambda text: self.prior
        weights, savings = self.weights, self.savings()

        def score(text: str | None) -> float:
            return float(1 / (1 + math.exp(-max(-60.0, min(60.0, float(features(savings(windows_of(words_of(text), STEP))) @ weights))))))

        return score

    def savings(self):
        """A function windows -> bytes that the toxic dictionary saves, from -MOST_SAVED to MOST_SAVED -> how many windows."""
        ordinary, toxic = compressor(self.ordinary, self.shortest), compressor(self.toxic, self.shortest)

        def saved(windows: list[bytes]) -> Counter:
            counts = Counter([len(ordinary(w)) - len(toxic(w)) for w in map(FRAME.__mod__, windows)])
            out = Counter()
            for k, n in counts.items():
                out[min(MOST_SAVED, max(-MOST_SAVED, k))] += n
            return out

        return saved


def lengths(content: bytes, shortest: int):
    """A function window -> bytes that it takes, in its frame, with a dictionary of this content."""
    compress = compressor(content, shortest)
    return lambda window: len(compress(FRAME % window))


def compressor(content: bytes, shortest: int):
    import zstandard

    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=shortest, write_content_size=0, write_checksum=0, write_dict_id=0)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


def features(saved: Counter) -> np.ndarray:
    """Windows that save at least 1, 2, ... bytes, and that lose 2, 4, 6: their logs and their share of the root of all windows; a constant."""
    counts = np.zeros(2 * MOST_SAVED + 1)
    for k, n in saved.items():
        counts[MOST_SAVED + k] = n
    least, total = counts[::-1].cumsum()[::-1][MOST_SAVED + 1 :], counts.sum()
    most = counts.cumsum()[[MOST_SAVED - 2, MOST_SAVED - 4, MOST_SAVED - 6]]
    found = np.concatenate([least, most])
    return np.concatenate([np.log1p(found), found / math.sqrt(total + 1), [math.log(total + 1) / 10, 1.0]])


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary trained on samples; of too few to train on, the samples themselves.

    The header with entropy tables is left out: these would differ between two dictionaries and blur what matches save.
    """
    import zstandard

    header = 256
    size = min(size, sum(map(len, samples)) // 3)
    if len(samples) > 16 and size >= 512:
        try:
            return zstandard.train_dictionary(size + header, samples, k=16, d=8, f=20, level=LEVEL).as_bytes()[header:]
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-max(size, 512) :]


def without_near_copies(texts: list[list[bytes]]) -> list[list[bytes]]:
    """Texts of which none is much like an earlier one (the minima of four hashes alike, in one of four bands)."""
    import xxhash

    seen: set[tuple] = set()
    out = []
    odd = (2 * np.arange(16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B1)
    for text in texts:
        if words := set(text):
            hashes = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint64, len(words))
            low = [int(((hashes * m) % np.uint64(4294967291)).min()) for m in odd]
            bands = {(k, *low[k : k + 4]) for k in range(0, 16, 4)}
            if len(words) < 8 or not bands & seen:
                out.append(text)
            seen |= bands
    return out


def every(items: list, most: int) -> list:
    """At most ``most`` of the items, evenly spread."""
    return items if len(items) <= most else [items[k * len(items) // most] for k in range(most)]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], shared: int, own: int, shortest: int) -> Iterator[ToxicityModel]:
    """Models without weights, one a round, from the words of texts of either class."""
    plain = every([w for words in ordinary for w in windows_of(words, 1)], 60_000)
    base = b" " + trained([b" " + w + b" " for w in plain], shared)
    alone, cost = lengths(base, shortest), {}

    def unknown(words: list[bytes]) -> list[bytes]:
        for w in words:
            if w not in cost:
                cost[w] = alone(w) - alone(b"")
        return [w for w in dict.fromkeys(words) if cost[w] >= COST]

    def samples(texts: list[list[bytes]]) -> list[bytes]:
        return [b" %b " % b" ".join(words) for words in map(unknown, texts) if words]

    special, filler = trained(samples(toxic), own), trained(samples(every(ordinary, 2 * len(toxic))), own)
    windows = [windows_of(words, 1) for words in toxic]
    for turn in range(ROUNDS + 1):
        size = min(len(special), len(filler))
        if not size:
            return
        model = ToxicityModel(filler[-size:] + base, special[-size:] + base, np.zeros(0), 0.0, shortest)
        yield model
        if turn < ROUNDS:
            ordinarily, toxically = lengths(model.ordinary, shortest), lengths(model.toxic, shortest)
            gain = [[ordinarily(w) - toxically(w) for w in own_windows] for own_windows in windows]
            usual, here = np.array([ordinarily(w) - toxically(w) for w in plain]), np.array([x for g in gain for x in g])
            cut = next((c for c in range(2, MOST_SAVED) if (here >= c).mean() >= 4 * ((usual >= c).mean() + 1e-5)), MOST_SAVED)
            picked = [b" " + w + b" " for own_windows, g in zip(windows, gain, strict=True) for w in dict.fromkeys(w for w, x in zip(own_windows, g, strict=True) if x >= cut)]
            if len(picked) < 50:
                return
            special = trained(picked, own)


def regressed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    ridge[-1] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def tables(rows: list[tuple[list[bytes], int]], model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    saved = model.savings()
    return np.array([features(saved(windows_of(words, STEP))) for words, _ in rows]), np.array([label for _, label in rows], float)


def loss(x: np.ndarray, y: np.ndarray, parts: int = 4) -> float:
    """Mean log loss over rows left out in turn."""
    total, place = 0.0, np.arange(len(y)) % parts
    for k in range(parts):
        out = place == k
        if out.any() and not out.all():
            p = 1 / (1 + np.exp(-np.clip(x[out] @ regressed(x[~out], y[~out]), -30, 30)))
            total -= (y[out] * np.log(p + 1e-9) + (1 - y[out]) * np.log(1 - p + 1e-9)).sum()
    return total / max(1, len(y))


def fit_texts(read: list[tuple[int, list[bytes], int, int]], prior: float) -> ToxicityModel:
    """From (id, words, label, fold), sorted: folds other than 3 train the dictionaries, fold 3 calibrates and chooses."""
    toxic, ordinary = ([w for _, w, label, fold in read if label == wanted and fold != 3] for wanted in (1, 0))
    toxic, ordinary = without_near_copies(toxic), without_near_copies(ordinary)
    check = [(w, label) for _, w, label, fold in read if fold == 3]
    some = [(w, label) for label in (1, 0) for w, own in every([c for c in check if c[1] == label], TRIED // 2) if own == label]
    best = None
    if toxic and ordinary and check:
        for setting in SETTINGS:
            for model in dictionaries(toxic, ordinary, *setting):
                found = loss(*tables(some, model))
                if best is None or found < best[0]:
                    best = found, model
    if best is None:
        return ToxicityModel(b"", b"", np.zeros(0), prior)
    best[1].weights, best[1].prior = regressed(*tables(check, best[1])), prior
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, fit_bytes: int = FIT_BYTES) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold: about ``toxic_rows`` and ``ordinary_rows``, whole texts of about ``fit_bytes`` in all.

    Two of the three other folds make the dictionaries, the third calibrates. A document labelled more than once counts as toxic
    if any label says so; null labels count for nothing. If a class is missing, every score is the share of toxic labels.
    """
    rows = slim(labels, doc_id=id_col, label=label_col).select(F.col("doc_id").cast("long"), F.col("label").cast("int"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out_fold(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    counts = {r.label > 0: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return ToxicityModel(b"", b"", np.zeros(0), float(bool(counts.get(True))))
    share = {c: min(1.0, most / counts[c]) for c, most in ((True, toxic_rows), (False, ordinary_rows))}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = rows.where(place < F.when(F.col("label") > 0, int(share[True] * (1 << 30))).otherwise(int(share[False] * (1 << 30))))  # about toxic_rows + ordinary_rows ids
    texts = slim(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    fewer = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_bytes / max(1, size)))
    found = texts.where(fewer).select("doc_id", "text", "label", F.pmod(unsigned_crc32(F.col("doc_id").cast("string")), F.lit(4)).alias("fold"))
    known: dict[bytes, bytes] = {}  # equal words are one object
    read = []
    for batch in found.toArrow().to_batches():
        for i, text, label, fold in zip(*batch.columns, strict=True):
            read.append((i.as_py(), [known.setdefault(w, w) for w in words_of(text.as_py())], label.as_py(), fold.as_py()))
    read.sort(key=lambda x: (x[0], x[1]))
    model = fit_texts(read, counts[True] / sum(counts.values()))
    if model.toxic and share[True] != share[False]:  # the sample's odds to those of all labelled rows
        model.weights[-1] += math.log(share[False] / share[True])
    return model


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: likelier toxic), predicted (1 from ``threshold`` on).

    Only the whole text decides. Null and empty texts get a score too: that of no windows. Repeated rows are scored row by row;
    other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    target = arrow_of("doc_id long, score double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(sent.value)
        for batch in batches:
            yield record_batch(target, {"doc_id": batch.column("doc_id"), "score": [one(x.as_py()) for x in batch.column("text")]})

    scored = slim(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([one(x.as_py()) < threshold for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _scorer(model: ToxicityModel):
    return kept_in_worker(("toxicity", hash(model.toxic), hash(model.ordinary), model.weights.tobytes(), model.prior), model.scorer)
