"""Groups of near copies, by SimHash first, then by MinHash, decided by the similarity of word shingles.

The texts' SimHash fingerprints are linked by anchor-point covering (``simhash.fingerprint_links``). Two bits of 64 are what such
links can bridge at scale, which only the closest copies are within: at similarity 0.8 fingerprints differ in some ten bits, and
anchors for so many would be nearly all of them. The links in between are found by bands of minima.

A text's shingles give BANDS band hashes, each of ROWS minima. Two texts of similarity s agree in a band with probability s^ROWS,
whatever was changed and wherever: at 0.8 all bands fail for 5 in a million pairs, above for fewer. Texts of a band hash first meet
one hub, which takes as many comparisons as texts; those that are still in different groups after that are compared in blocks, a
text of a block being one row. The exact Jaccard similarity of the sets of word shingles decides everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, dropped, fresh_worker, parts, record_batch, saved, sent_if_small, slim
from .components import connected_components
from .simhash import fingerprint_links, majority, shingles_of, words_of

#: Bands of a signature, minima of a band, and the bytes of shingles of a block of texts that are compared with each other.
BANDS, ROWS, BLOCK_BYTES = 40, 6, 1 << 22
_KEYS = (F.xxhash64, lambda text: F.hash(text).cast("long") * F.lit(1 << 31) + F.coalesce(F.octet_length(text), F.lit(-1)))


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """With two more columns that equal texts share."""
    return docs.select(*docs.columns, _KEYS[0](F.col(text)).alias("_k1"), _KEYS[1](F.col(text)).alias("_k2"))


def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    """What the shingles' hashes are mixed with, and multiplied by, for each minimum."""
    rng = np.random.default_rng(29)
    seeds, factors = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return seeds, factors | np.uint64(1)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each shingle, repeats included."""
    import xxhash

    mixed = np.zeros(0, np.uint64)
    if words:
        if len(words) < size:
            mixed = np.array([xxhash.xxh64_intdigest(shingles_of(words, size)[0])], np.uint64)
        else:
            own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            mixed = np.zeros(len(words) - size + 1, np.uint64)
            for k in range(size):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(mixed)]
                mixed ^= mixed >> np.uint64(29)
            mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
    return mixed


def band_hashes(mixed: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> bytes:
    """BANDS 64-bit hashes, each of a band of ROWS minima over the shingles' hashes; without shingles the hashes of zeros."""
    import xxhash

    lows = np.zeros(BANDS * ROWS, np.uint64)
    if len(mixed):
        seeds, factors = functions
        lows = np.min([((mixed[k : k + 1024] ^ seeds) * factors).min(1) for k in range(0, len(mixed), 1024)], axis=0)
    return b"".join(xxhash.xxh64_digest(band.tobytes(), k) for k, band in enumerate(lows.reshape(BANDS, ROWS)))


def _distinct(docs: DataFrame, size: int) -> DataFrame:
    """(node, k1, k2, low, times, fp, sim), saved: each distinct text, its smallest id, rows with both, its band hashes and its SimHash."""
    schema = "doc_id long, k1 long, k2 long, fp binary, sim long"
    target = arrow_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        functions = _hash_functions()
        for batch in parts(batches, 2000):
            hashes = [shingle_hashes(words_of(x.as_py()), size) for x in batch.column("text")]
            sims = np.array([majority(h[k : k + (1 << 16)] for k in range(0, len(h), 1 << 16)) for h in hashes], np.uint64).view(np.int64)
            yield record_batch(target, {"doc_id": batch.column("doc_id"), "k1": batch.column("_k1"), "k2": batch.column("_k2"), "fp": [band_hashes(h, functions) for h in hashes], "sim": sims})

    marks = keyed(docs, "text").select("doc_id", "text", "_k1", "_k2").mapInArrow(run, schema)
    rows = marks.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("times"), F.first("fp").alias("fp"), F.first("sim").alias("sim"))
    once = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.min_by("times", F.coalesce("doc_id", F.lit(1 << 62))).alias("times"), F.first("fp").alias("fp"), F.first("sim").alias("sim"))
    return saved(once.withColumn("node", F.monotonically_increasing_id()))


def _banded(nodes: DataFrame) -> DataFrame:
    """(band, node): the band hashes of each text."""
    schema = "band long, node long"
    target = arrow_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in parts(batches, 4096):
            bands = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.int64)
            yield record_batch(target, {"band": bands, "node": np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)})

    return nodes.select("node", "fp").mapInArrow(run, schema)


def _shingles(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles), saved: sorted 32-bit hashes of the distinct shingles of the wanted texts."""
    schema = "node long, shingles binary"
    target = arrow_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        fresh_worker()
        for batch in parts(batches):
            out = []
            for text in batch.column("text"):
                found = shingles_of(words_of(text.as_py()), size)
                out.append(np.unique(np.fromiter((xxhash.xxh32_intdigest(x) for x in found), np.uint32, len(found))).tobytes())
            yield record_batch(target, {"node": batch.column("node"), "shingles": out})

    some = nodes.join(wanted, "node", "left_semi").select("node", F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "low")
    some = saved(some)
    texts = keyed(docs, "text").join(sent_if_small(some, some.count()), ["_k1", "_k2"]).where(F.col("doc_id").eqNullSafe(F.col("low"))).select("node", "text")
    return saved(texts.mapInArrow(run, schema).dropDuplicates(["node"]))


def _similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b, alike), saved: whether the shingle sets of each pair are at least ``least`` similar."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _shingles(docs, nodes, wanted, size)
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    schema = "a long, b long, alike boolean"
    target = arrow_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in parts(batches):
            out = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    out.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both >= least * (len(x) + len(y) - both))
            yield record_batch(target, {"a": batch.column("a"), "b": batch.column("b"), "alike": out})

    return saved(joined.select("a", "b", "x", "y").mapInArrow(run, schema))


def _alike_in_block(band: int, rows: list[dict], least: float) -> Iterator[tuple[int, int]]:
    """Pairs of a block's texts that are similar, of different groups, and have no earlier band in common; of two blocks, one of each."""
    sets = [np.frombuffer(r["shingles"], np.uint32) for r in rows]
    bands = np.frombuffer(b"".join(r["fp"] for r in rows), np.int64).reshape(-1, BANDS)
    place = int(np.flatnonzero(bands[0] == band)[0])
    sizes, roots, own, nodes = np.array([len(x) for x in sets]), np.array([r["root"] for r in rows]), np.array([r["own"] for r in rows]), np.array([r["node"] for r in rows])
    across = rows[0]["low"] != rows[0]["high"]
    for i in range(len(rows) - 1):
        later = slice(i + 1, None)
        some = (roots[later] != roots[i]) & ((own[later] != own[i]) | (not across))
        some &= np.minimum(sizes[later], sizes[i]) >= least * np.maximum(sizes[later], sizes[i])
        some = np.flatnonzero(some) + i + 1
        some = some[(bands[some, : place + 1] == bands[i, : place + 1]).argmax(1) == place]
        if not len(some):
            continue
        if not sizes[i]:  # no words: as many as it, none
            yield from ((int(nodes[i]), int(nodes[j])) for j in some)
            continue
        found = np.concatenate([sets[j] for j in some])
        at = np.minimum(np.searchsorted(sets[i], found), sizes[i] - 1)
        both = np.add.reduceat((sets[i][at] == found).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
        yield from ((int(nodes[i]), int(nodes[j])) for j in some[both >= least * (sizes[i] + sizes[some] - both)])


def _alike_in_blocks(left: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b), saved: similar pairs among texts of one band hash and different roots. left: (band, node, root).

    The texts of a band hash are dealt to blocks of about BLOCK_BYTES of shingles; each two blocks, and each by itself, meet in a
    task, where a text is one row however many it is compared with.
    """
    sets = _shingles(docs, nodes, left.select("node").distinct(), size)
    kept = left.join(sets.withColumn("size", F.octet_length("shingles")), "node")
    blocks = kept.groupBy("band").agg(F.ceil(F.sum(F.col("size") + BANDS * 8) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = left.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "node", "root", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    whole = dealt.join(sets, "node").join(nodes.select("node", "fp"), "node").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    schema = "a long, b long"
    target = arrow_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        block, rows = None, []

        def compared() -> pa.RecordBatch:
            pairs = list(_alike_in_block(block[0], rows, least)) if len(rows) > 1 else []
            return record_batch(target, {"a": [min(p) for p in pairs], "b": [max(p) for p in pairs]})

        for batch in batches:
            for part in parts([batch]):
                for row in part.to_pylist():
                    key = row["band"], row["low"], row["high"]
                    if key != block:
                        yield compared()
                        block, rows = key, []
                    rows.append(row)
        yield compared()

    return saved(whole.select("band", "low", "high", "own", "node", "root", "shingles", "fp").mapInArrow(run, schema))


def _linked_fingerprints(nodes: DataFrame, bits: int) -> DataFrame:
    """(a, b): texts whose SimHash fingerprints are at most ``bits`` apart, each text with one such of a smaller fingerprint, or of its own."""
    values = nodes.groupBy("sim").agg(F.min("node").alias("hub"))
    same = nodes.select("sim", "node").hint("merge").join(values, "sim").where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    least = fingerprint_links(values.select(F.col("sim").alias("fp")), bits).groupBy("b").agg(F.min("a").alias("a"))
    near = least.join(values.select(F.col("sim").alias("a"), F.col("hub").alias("x")), "a").join(values.select(F.col("sim").alias("b"), F.col("hub").alias("y")), "b")
    return same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _grouped(docs: DataFrame, shingle_words: int, similarity: float, bits: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots): the distinct texts, and the group of each that is in one."""
    nodes = _distinct(docs, shingle_words)
    banded = _banded(nodes).repartition("band")
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("band", "hub")
    members = saved(banded.join(hubs.hint("merge"), "band"))
    stars = members.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = saved(stars.unionByName(_linked_fingerprints(nodes, bits)).distinct())
    tested = _similar(stars, docs, nodes, shingle_words, similarity)
    roots = saved(connected_components(tested.where("alike").select("a", "b")))
    # what the hubs didn't join: texts of one band hash and of different groups
    labelled = members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("texts")).where("low <> high and texts > 2").select("band")
    left = saved(labelled.join(mixed, "band"))
    dropped(stars, tested, members)
    more = _alike_in_blocks(left, docs, nodes, shingle_words, similarity)
    if not more.isEmpty():
        joined = roots.where(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
        before, roots = roots, saved(connected_components(joined))
        dropped(before)
    dropped(left, more)
    return nodes, roots


def near_copy_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, group_id (the smallest doc_id of its group; its own if it has no copies).

    Texts are linked if the Jaccard similarity of their sets of word shingles (ASCII lower case, words between white space) is at
    least ``similarity``; groups are what links connect. Texts without words, null among them, are copies of each other; a text of
    fewer words than a shingle is one shingle. Repeated rows get the same group. Rows without id are a group's id only where it has
    no other. Other columns are ignored. Empty input gives no rows.
    """
    rows = slim(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    nodes, roots = _grouped(rows, shingle_words, similarity)
    placed = nodes.join(roots, "node", "left").select("k1", "k2", "low", F.coalesce("root", "node").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("group_id"))
    by_text = placed.join(lowest, "root").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "group_id")
    return keyed(rows, "text").select("doc_id", "_k1", "_k2").join(by_text, ["_k1", "_k2"]).select("doc_id", "group_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each group of near copies: that of the smallest id (one of them, if its row is repeated)."""
    rows = slim(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    nodes, roots = _grouped(rows, shingle_words, similarity)
    placed = nodes.join(roots, "node", "left").select("k1", "k2", "low", "times", F.coalesce("root", "node").alias("root"))
    first = F.struct(F.col("low").isNull().alias("last"), "low", "k1", "k2", "times")
    kept = saved(placed.groupBy("root").agg(F.min(first).alias("one")).select(F.col("one.low").alias("_low"), F.col("one.k1").alias("_k1"), F.col("one.k2").alias("_k2"), F.col("one.times").alias("_times")))
    columns = [f"c{k}" for k in range(len(docs.columns))]
    at, place = columns[docs.columns.index(text_col)], columns[docs.columns.index(id_col)]
    whole = docs.toDF(*columns)
    found = whole.select(*columns, _KEYS[0](F.col(at)).alias("_k1"), _KEYS[1](F.col(at)).alias("_k2")).join(sent_if_small(kept, kept.count()), ["_k1", "_k2"])
    found = found.where(F.col(place).cast("long").eqNullSafe(F.col("_low")))
    if not kept.where("_times > 1").isEmpty():
        repeated = found.where("_times > 1").dropDuplicates(["_k1", "_k2"])
        found = found.where("_times = 1").unionByName(repeated)
    return found.select(*columns).toDF(*docs.columns)
