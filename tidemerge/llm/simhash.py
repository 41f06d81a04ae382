"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into blocks so that fingerprints at most ``threshold`` bits apart differ by at most one bit in some block.
The codewords of a covering code are the anchors of a block: a Hamming code on the first 2^r - 1 bits (every pattern within
one bit of exactly one codeword), free bits behind. A fingerprint is at home at its nearest anchor (within the covering radius,
1) and is replicated to every anchor within radius plus threshold (2). Of two block values at most one bit apart, the one is
then always replicated to the other's home, so comparing homes with replicas anchor by anchor loses no link.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, record_batch, saved, slim
from .components import connected_components

CHUNK = 1 << 16


class Covering:
    """Anchors of blocks of ``width`` bits: a Hamming code of radius 1 on 2^r - 1 bits and ``width - 2^r + 1`` free bits."""

    def __init__(self, width: int):
        self.width = width
        r = (width + 1).bit_length() - 1
        self.n = (1 << r) - 1
        labels = range(1, self.n + 1)
        self.checks = [np.uint64(sum(1 << (j - 1) for j in labels if j >> k & 1)) for k in range(r)]
        pairs = [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in labels if i < i ^ s] for s in range(1, self.n + 1)]
        self.pairs = np.array([[0] * len(pairs[0]), *pairs], np.uint64)
        self.flips = [np.uint64(1 << j) for j in range(self.n, width)]

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        s = np.zeros(len(values), np.int64)
        for k, check in enumerate(self.checks):
            s |= (np.bitwise_count(values & check).astype(np.int64) & 1) << k
        return s

    def home(self, values: np.ndarray, s: np.ndarray | None = None) -> np.ndarray:
        """The anchor within one bit."""
        s = self.syndrome(values) if s is None else s
        return np.where(s > 0, values ^ (np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64)), values)

    def within_two(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``values``, and the anchors at most two bits from each."""
        s = self.syndrome(values)
        home, at = self.home(values, s), np.arange(len(values))
        rows, anchors = [at], [home]
        off = np.flatnonzero(s)
        rows.append(np.repeat(off, self.pairs.shape[1]))
        anchors.append((values[off, None] ^ self.pairs[s[off]]).ravel())
        for flip in self.flips:
            rows.append(at)
            anchors.append(home ^ flip)
        on = np.flatnonzero(s == 0)
        for k, flip in enumerate(self.flips):
            for other in self.flips[k + 1 :]:
                rows.append(on)
                anchors.append(home[on] ^ flip ^ other)
        return np.concatenate(rows), np.concatenate(anchors)


def blocks_of(bits: int, threshold: int) -> list[tuple[int, int]]:
    """(shift, width) of blocks, as few as leave at most one differing bit in some block."""
    count = max(1, threshold // 2 + 1)
    cuts = [bits * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; other letters stay as they are."""
    return (text or "").encode().lower().split()


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; a shorter text is one run; no words, none."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*(words[k:] for k in range(size)), strict=False)]


def majority(parts: Iterable[np.ndarray]) -> int:
    """The 64-bit number whose bits are those set in over half of all values (uint64 arrays); 0 without values."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def simhash64(words: list[bytes], size: int) -> int:
    """The majority of the XXH64 (seed 42) values of the shingles; 0 without words."""
    import xxhash

    shingles = shingles_of(words, size)
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles[k : k + CHUNK]), np.uint64, len(shingles[k : k + CHUNK])) for k in range(0, len(shingles), CHUNK))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row's whole text as a signed long. Null and wordless texts have 0."""
    target = arrow_of("doc_id long, fp long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((simhash64(words_of(x.as_py()), shingle_words) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield record_batch(target, {"doc_id": batch.column("doc_id"), "fp": values.view(np.int64)})

    return slim(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def anchored(values: DataFrame, blocks: list[tuple[int, int]], everywhere: bool) -> DataFrame:
    """(anchor, fp): each distinct ``fp`` at its home in each block, or at every anchor within two bits."""
    schema = "anchor long, fp long"
    target = arrow_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {width: Covering(width) for _, width in blocks}
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(whole), 4096):
                part = whole[start : start + 4096]
                for k, (shift, width) in enumerate(blocks):
                    value = (part >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    at, anchor = codes[width].within_two(value) if everywhere else (np.arange(len(part)), codes[width].home(value))
                    key = (anchor * np.uint64(len(blocks)) + np.uint64(k)) if width + len(blocks).bit_length() < 64 else anchor
                    yield record_batch(target, {"anchor": key.view(np.int64), "fp": part[at].view(np.int64)})

    return values.mapInArrow(run, schema)


def fingerprint_links(values: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints at most ``threshold`` bits apart, each once.

    values: a table of distinct ``fp``. It grows with the texts, and so is joined by anchor, never sent whole.
    """
    blocks = blocks_of(64, threshold)
    homes = anchored(values, blocks, False).withColumnRenamed("fp", "a")
    near = anchored(values, blocks, True).withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return homes.hint("merge").join(near, (homes.anchor == near.anchor) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, threshold: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id reachable over links (``threshold`` or fewer differing bits), its own included.
    n_links: other fingerprints linked to the row's own. Equal fingerprints meet before any linking, so thousands of copies
    count as one. Null and wordless texts have fingerprint 0, linked like any other. A null id is never a component's id
    unless no other is reachable. Repeated rows stay, each with the same component. Other columns are ignored. Empty input
    gives no rows.
    """
    prints = saved(fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words))
    values = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    links = saved(fingerprint_links(values.select("fp"), threshold))
    roots = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    placed = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    placed = saved(placed.select("fp", "low", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    digest = placed.join(lowest, "root").select("fp", "component_id", "n_links")
    return prints.join(digest, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
