"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over hashed words. A distributed randomised SVD of them (one pass over the data:
a Nystroem range sketch summed over tasks, then a small factorisation) gives a latent space. Sliding windows of the documents
whose latent vector has a high cosine with a benchmark item are candidates, and so are, exactly, those that have as many of the
item's words as the rule asks, common ones included. Longest common subsequences of words, and a check of the item's answer,
decide; so reworded copies are found as well as verbatim ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, fresh_worker, record_batch, saved, slim
from .word_hashes import hashed, slices

#: Buckets of words (latent space), its dimensions, the leading ones left out (they tell languages and much-copied texts
#: apart, not passages), words of a passage, and the buckets of a block of summed rows.
BUCKETS, RANK, LEADING, PASSAGE, BLOCK = 1 << 15, 96, 8, 64, 1024
#: Words in over this share of passages (and over COMMON_LEAST passages) are left out of the vectors, not of the common
#: subsequences. An item of such words alone has no vector; it is found by counting its words in each window, as every item is.
COMMON, COMMON_LEAST = 0.005, 50
#: Windows start every STEP words and have WINDOWS words; an item is looked for in the shortest windows that can hold it.
STEP, WINDOWS = 16, (32, 48, 64)
#: Parts of fewer words don't tell an item: shorter ones are found where all their words stand in a row. Items are sent to the
#: executors in blocks of about so many.
LEAST_WORDS, ITEM_BLOCK = 8, 1024
#: Words over this share of some texts' words are counted apart from others, and no more often than an item has such words.
FREQUENT = 0.001


def coded(docs: DataFrame) -> DataFrame:
    """(doc_id, words): each text's words as 32-bit hashes in one binary value."""
    target = arrow_of("doc_id long, words binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for part in slices(batch):
                h, counts = hashed(part.column("text"))
                data, ends = h.tobytes(), 4 * np.cumsum(counts)
                rows = [data[b - 4 * n : b] for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield record_batch(target, {"doc_id": part.column("doc_id"), "words": rows})

    return docs.mapInArrow(run, "doc_id long, words binary")


def groups_of(batches: Iterable[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their words one after another, words of each row), of about ``limit`` bytes."""
    fresh_worker()
    for batch in batches:
        for part in slices(batch, "words", limit):
            rows = part.column("words").to_pylist()
            yield part, np.frombuffer(b"".join(rows), np.uint32), np.array([len(r) // 4 for r in rows], np.int64)


def passages(counts: np.ndarray, size: int) -> np.ndarray:
    """The passage of each word: runs of ``size`` words that don't cross documents, numbered from 0."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = place % size == 0
    return np.cumsum(begins) - 1


def passage_frequencies(words: DataFrame) -> tuple[int, np.ndarray]:
    """The number of passages, and how many hold each bucket: over all documents, added up in the shuffle."""
    target = arrow_of("bucket int, hits long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hits = 0, np.zeros(BUCKETS, np.int64)
        for _, codes, counts in groups_of(batches):
            if len(codes):
                own = passages(counts, PASSAGE)
                total += int(own[-1]) + 1
                pairs = np.sort(own * BUCKETS + (codes & (BUCKETS - 1)))
                hits += np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(hits)
        yield record_batch(target, {"bucket": np.append(some, -1).astype(np.int32), "hits": np.append(hits[some], total)})

    rows = words.mapInArrow(run, "bucket int, hits long").groupBy("bucket").agg(F.sum("hits").alias("hits")).collect()  # BUCKETS + 1 rows at most
    hits = np.zeros(BUCKETS, np.int64)
    total = 0
    for bucket, n in rows:
        if bucket < 0:
            total = n
        else:
            hits[bucket] = n
    return total, hits


def weights_of(total: int, hits: np.ndarray) -> np.ndarray:
    """Inverse passage frequencies; 0 for common and for unknown buckets."""
    return np.where((hits > 0) & (hits <= max(COMMON * total, COMMON_LEAST)), np.log((total + 1) / (hits + 0.5)), 0).clip(0).astype(np.float32)


def test_matrix(seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, RANK)).astype(np.float32)


def latent_basis(words: DataFrame, weights: np.ndarray) -> np.ndarray:
    """(BUCKETS, RANK): what a word adds to a latent vector, by a randomised SVD of all passages.

    Each task sums its share of G = A'(A R) for a random R; its blocks of rows are added up in the shuffle. Then, on the driver,
    G (R'G)^-1 G' approximates A'A: its factors give the right singular vectors and the singular values, which whiten the space.
    """
    sent = words.sparkSession.sparkContext.broadcast(weights)
    schema = "block int, own int, part binary"
    target = arrow_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        random, total = np.ascontiguousarray((test_matrix() * w[:, None]).T), np.zeros((RANK, BUCKETS))
        for _, codes, counts in groups_of(batches):
            own, bucket = passages(counts, PASSAGE), codes & (BUCKETS - 1)
            kept = w[bucket] > 0
            own, bucket = own[kept], bucket[kept].astype(np.intp)
            if not len(own):
                continue
            begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            scale = 1 / np.add.reduceat(w[bucket] ** 2, begins)  # passages count alike
            at = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(own))))
            for k in range(RANK):
                y = np.add.reduceat(random[k].take(bucket), begins) * scale
                total[k] += np.bincount(bucket, y.take(at), minlength=BUCKETS)
        total = (total * w).T
        own = TaskContext.get().partitionId() % groups
        for k in range(0, BUCKETS, BLOCK):
            yield record_batch(target, {"block": [k // BLOCK], "own": [own], "part": [total[k : k + BLOCK].astype(np.float32).tobytes()]})

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, own, part in zip(batch.column("block").to_pylist(), batch.column("own").to_pylist(), batch.column("part"), strict=True):
                value = np.frombuffer(part.as_py(), np.float32)
                sums[block, own] = sums[block, own] + value if (block, own) in sums else value.astype(np.float64)
        for (block, own), value in sums.items():
            yield record_batch(target, {"block": [block], "own": [own], "part": [value.astype(np.float32).tobytes()]})

    cores = words.sparkSession.sparkContext.defaultParallelism
    tasks = max(2 * cores, words.rdd.getNumPartitions() // 8)
    groups = max(1, math.isqrt(tasks))  # sums of tasks are added up in groups first, and then the groups': no task adds up more than about the root of all
    sums = words.coalesce(tasks).mapInArrow(run, schema).repartition("block", "own").mapInArrow(added, schema)  # each task's sum has BUCKETS x RANK numbers, however small its share
    parts = sums.withColumn("own", F.lit(0)).repartition("block").mapInArrow(added, schema).toArrow()  # BUCKETS x RANK numbers
    g = np.zeros((BUCKETS, RANK))
    for block, part in zip(parts.column("block").to_pylist(), parts.column("part"), strict=True):
        g[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(part.as_py(), np.float32).reshape(-1, RANK)
    core = test_matrix().astype(np.float64).T @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((BUCKETS, RANK), np.float32)
    u, s, _ = np.linalg.svd(g @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    basis = np.zeros((BUCKETS, RANK), np.float32)
    basis[:, : len(s)] = weights[:, None] * u / np.maximum(s, s[0] * 1e-6)
    if len(s) > 2 * LEADING:
        basis[:, :LEADING] = 0
    # words count by their weight alone: those of much-copied texts would else outweigh all others
    return basis * (weights / np.maximum(np.sqrt((basis**2).sum(1)), 1e-30))[:, None]


@dataclass
class Items:
    """A block of benchmark items: ids, words, the place where the answer starts, and latent vectors; shorter ones after ``whole`` others.

    known: the words of all items, in order; member: a row for each of them behind a first one of zeros, 1 for the items that have it;
    places: the rows of each item's words, and how often it has each; holders: where the items of each row begin in a list, and that
    list, of items that aren't short."""

    ids: np.ndarray
    words: list[np.ndarray]
    answers: list[int]
    latent: np.ndarray
    times: list[Counter]
    known: np.ndarray
    maybe: np.ndarray
    member: np.ndarray
    whole: int
    places: list[tuple[np.ndarray, np.ndarray]]
    holders: tuple[np.ndarray, np.ndarray]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The row of each word, 0 for words of no item."""
        out = np.zeros(len(codes), np.int32)
        some = np.flatnonzero(self.maybe[codes & 0xFFFF])
        at = np.searchsorted(self.known, codes[some])
        at[at == len(self.known)] = 0
        hit = self.known[at] == codes[some] if len(self.known) else at > 0
        out[some[hit]] = at[hit] + 1
        return out


def common_subsequence(a: list[int], b: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the longest common subsequence, and which places of ``a`` one such has (bit-parallel over ``a``, then read back)."""
    masks: dict[int, int] = {}
    for i, word in enumerate(a):
        masks[word] = masks.get(word, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v, states = whole, []
    for word in b.tolist():
        u = v & masks.get(word, 0)
        v = ((v + u) | (v - u)) & whole
        states.append(v)
    length = len(a) - v.bit_count()
    used = np.zeros(len(a), bool)
    i, j = len(a) - 1, len(states) - 1
    words = b.tolist()
    while i >= 0 and j >= 0:
        before = states[j - 1] if j else whole
        if states[j] >> i & 1:
            i -= 1  # no gain at place i
        elif not before >> i & 1:
            j -= 1  # gained earlier
        elif a[i] == words[j]:
            used[i] = True
            i, j = i - 1, j - 1
        else:
            i -= 1
    return length, used


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = 0.65, least_common: float = 0.6, least_answer: float = 0.5) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer): documents that hold a benchmark item, one row for each such pair.

    cosine: that of the latent vectors of the item and the window it was found in (0 for an item of frequent words alone). Windows of at least ``cosine`` times the root of the share of the window that
    the item can fill are tried, and all that have ``least_common`` of the item's words, however low their cosine. common: words of the longest common subsequence of item and the text around
    the window, over the item's words, at least ``least_common``. answer: the share of the item's last quarter (4 words at least)
    within that subsequence, at least ``least_answer``.

    Null and empty texts hold nothing; items of under LEAST_WORDS words are found where all their words stand in a row; items without words never. Equal items are each reported; an empty
    table on either side gives no rows. Repeated document rows report once. Long texts are searched whole. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    out_schema = "doc_id long, item_id long, cosine double, common double, answer double"
    items = slim(benchmark, item_id=item_col, text=item_text_col).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    n_items = items.count()
    words = saved(coded(slim(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")))
    total, hits = passage_frequencies(words)
    if not n_items or not total:
        return spark.createDataFrame([], out_schema)
    basis = latent_basis(words, weights_of(total, hits))
    sent_basis = spark.sparkContext.broadcast(basis)  # BUCKETS x RANK numbers
    target, found = arrow_of(out_schema), None
    blocks = -(-n_items // ITEM_BLOCK)
    for turn in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == turn).toArrow()  # about ITEM_BLOCK items
        sent = spark.sparkContext.broadcast(_items(part, basis))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            by_dimension = np.ascontiguousarray(sent_basis.value.T)
            for rows, codes, counts in groups_of(batches):
                yield record_batch(target, _search(rows.column("doc_id").to_pylist(), codes, counts, by_dimension, sent.value, cosine, least_common, least_answer))

        block = words.mapInArrow(run, out_schema)
        found = block if found is None else found.unionByName(block)
    best = F.struct("common", "answer", "cosine")
    return found.groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select("doc_id", "item_id", "b.cosine", "b.common", "b.answer")


def _items(rows: pa.Table, basis: np.ndarray) -> Items:
    found = []
    if rows.num_rows:
        rows = rows.sort_by([("item_id", "ascending"), ("text", "ascending")])
        codes, counts = hashed(rows.column("text").combine_chunks())
        ends = np.cumsum(counts).tolist()
        found = [(item, codes[end - n : end]) for item, end, n in zip(rows.column("item_id").to_pylist(), ends, counts.tolist(), strict=True) if n]
        found.sort(key=lambda x: len(x[1]) < LEAST_WORDS)  # stable: longer ones first
    words = [own for _, own in found]
    latent = [basis[own & (BUCKETS - 1)].sum(0) for own in words]
    latent = [v / max(float(np.linalg.norm(v)), 1e-30) for v in latent]
    known = np.unique(np.concatenate([np.zeros(0, np.uint32), *words]))
    maybe = np.zeros(1 << 16, bool)
    maybe[known & 0xFFFF] = True
    member = np.zeros((len(known) + 1, len(words)), np.uint8)
    items = Items(np.array([i for i, _ in found], np.int64), words, [len(w) - min(len(w), max(4, len(w) // 4)) for w in words], np.array(latent, np.float32).reshape(-1, RANK), [Counter(w.tolist()) for w in words], known, maybe, member, sum(len(w) >= LEAST_WORDS for w in words), [], (np.zeros(0), np.zeros(0)))
    for i, own in enumerate(words):
        items.places.append(np.unique(items.rows(own), return_counts=True))
        member[items.places[i][0], i] = 1
    held, whose = np.nonzero(member[:, : items.whole])
    items.holders = np.searchsorted(held, np.arange(len(member) + 1)), whose
    return items


def _search(doc_ids: list, codes: np.ndarray, counts: np.ndarray, basis: np.ndarray, items: Items, cosine: float, least_common: float, least_answer: float) -> dict:
    """Leaks among some documents. Windows never cross documents; each is tried with the items that it is the right size for."""
    out: dict[str, list] = {"doc_id": [], "item_id": [], "cosine": [], "common": [], "answer": []}
    if not len(codes) or not len(items.ids):
        return out
    begin = np.cumsum(counts) - counts
    steps = np.cumsum(-(-counts // STEP))  # windows are made of steps; those of a document end at steps[document]
    step = passages(counts, STEP)
    starts = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
    sums = _sums(basis, codes, starts)
    doc_of = np.searchsorted(steps, np.arange(len(sums)), "right")
    sizes, best = np.array([len(w) for w in items.words[: items.whole]], np.int64), {}
    for k, size in enumerate(WINDOWS):
        last = k == len(WINDOWS) - 1
        mine = np.flatnonzero((sizes <= size) & (sizes > (WINDOWS[k - 1] if k else 0)) | last & (sizes > size))
        if not len(mine):
            continue
        window = sums.copy()
        for more in range(1, size // STEP):
            inside = np.flatnonzero(np.arange(len(sums)) + more < steps[doc_of])
            window[inside] += sums[inside + more]
        norm = np.sqrt((window**2).sum(1))
        window /= np.maximum(norm, 1e-30)[:, None]
        least = (cosine * np.sqrt(np.minimum(1, sizes[mine] / size))).astype(np.float32)
        for a in range(0, len(window), 8192):
            similar = window[a : a + 8192] @ items.latent[mine].T
            for w, i in zip(*np.nonzero(similar >= least), strict=True):
                _compare(int(a + w), int(mine[i]), float(similar[w, i]), size, codes, counts, begin, starts, doc_of, items, best, least_common, least_answer)
    for w, i, size in _counted(items, codes, starts, steps[doc_of], sizes, least_common):
        window = sums[w : min(w + size // STEP, int(steps[doc_of[w]]))].sum(0)
        value = float(window @ items.latent[i]) / max(float(np.linalg.norm(window)), 1e-30)
        _compare(w, i, value, size, codes, counts, begin, starts, doc_of, items, best, least_common, least_answer)
    for at, i in _in_a_row(items, codes, counts):
        bucket = codes[at : at + len(items.words[i])] & (BUCKETS - 1)
        window = basis[:, bucket].sum(1)
        best[int(np.searchsorted(begin + counts, at, "right")), i] = 1.0, 1.0, float(window @ items.latent[i]) / max(float(np.linalg.norm(window)), 1e-30)
    for (doc, i), (common, answer, value) in best.items():
        out["doc_id"].append(doc_ids[doc])
        out["item_id"].append(int(items.ids[i]))
        out["cosine"].append(value)
        out["common"].append(common)
        out["answer"].append(answer)
    return out


def _in_a_row(items: Items, codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, item) of items of under LEAST_WORDS words whose words all stand in a row there, within a document."""
    if items.whole == len(items.words):
        return
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(codes))  # words from here to the end of the document
    for i in range(items.whole, len(items.words)):
        own = items.words[i]
        at = np.flatnonzero((codes == own[0]) & (left >= len(own)))
        for k in range(1, len(own)):
            at = at[codes[at + k] == own[k]]
        yield from ((place, i) for place in at.tolist())


def _counted(items: Items, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, least_common: float) -> Iterator[tuple[int, int, int]]:
    """(window, item, words of the window) of windows in which at least ``least_common`` of an item's words can be.

    A copy of n words, with words put in or not, may take 2 n (WINDOWS[0] at least), and start anywhere in a window's first step.
    Frequent words count no more often than the item has such; where they can't be enough, rare words alone tell which windows
    to look at more closely.
    """
    if not len(sizes):
        return
    row = items.rows(codes)
    often = np.bincount(row, minlength=len(items.member)) > FREQUENT * len(codes)
    often[0] = False
    most = np.array([int(times[often[own]].sum()) for own, times in items.places[: items.whole]])  # frequent words of each item
    least = np.ceil(least_common * sizes - 1e-9).astype(np.int64)
    length = -(-np.maximum(WINDOWS[0], 2 * sizes) // STEP) + 1
    rare = _rare_sums(items, row, often, starts, len(sizes))
    bare = np.flatnonzero(most >= least)  # items that may be there without any rare word
    frequent = _frequent_sums(items.member[:, bare], row, often, starts) if len(bare) else None
    at, place, bounds = np.arange(len(starts)), np.zeros(len(items.member), np.int64), np.append(starts, len(codes))
    for n in np.unique(length):
        last = np.minimum(at + n, ends)
        for i in np.flatnonzero(length == n).tolist():
            held = rare[i][last] - rare[i][:-1]
            need = int(least[i] - most[i])
            if need <= 0:
                column = frequent[int(np.searchsorted(bare, i))]
                enough = np.minimum(column[last] - column[:-1], most[i]) + held >= least[i]
            else:
                enough = held >= need
            found = np.flatnonzero(enough)
            if not len(found):
                continue
            # a word counts as often as the item has it
            own, times = items.places[i]
            place[own] = np.arange(1, len(own) + 1)
            for k in range(0, len(found), 4096):
                some = found[k : k + 4096]
                inside = bounds[some, None] + np.arange(int(n) * STEP)
                words = np.where(inside < bounds[last[some], None], place[row[np.minimum(inside, len(codes) - 1)]], 0)
                words += np.arange(len(some))[:, None] * (len(own) + 1)
                counts = np.bincount(words.ravel(), minlength=len(some) * (len(own) + 1)).reshape(len(some), -1)[:, 1:]
                for w in some[np.minimum(counts, times).sum(1) >= least[i]]:
                    yield int(w), i, int(n) * STEP
            place[own] = 0


def _rare_sums(items: Items, row: np.ndarray, often: np.ndarray, starts: np.ndarray, n_items: int) -> np.ndarray:
    """For each item, its words that aren't frequent, added up over the steps from the first on."""
    kept = np.flatnonzero((row > 0) & ~often[row])
    first, whose = items.holders
    r = row[kept]
    sizes = first[r + 1] - first[r]
    step = np.repeat(np.searchsorted(starts, kept, "right") - 1, sizes)
    item = whose[np.repeat(first[r] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    width = len(starts) + 1
    total = np.bincount(item * width + step + 1, minlength=n_items * width).reshape(n_items, width)
    return np.cumsum(total, axis=1, dtype=np.int32)


def _frequent_sums(member: np.ndarray, row: np.ndarray, often: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """As ``_rare_sums``, of frequent words, for the items that are the columns of ``member``."""
    kept = np.flatnonzero(often[row])
    total = np.zeros((len(starts) + 1, member.shape[1]), np.int32)
    step = np.searchsorted(starts, kept, "right") - 1
    edges = np.flatnonzero(np.append(True, step[1:] != step[:-1])) if len(kept) else kept
    for a in range(0, len(edges), 512):
        some = edges[a : a + 512]
        words = row[kept[some[0] : edges[a + 512] if a + 512 < len(edges) else len(kept)]]
        total[step[some] + 1] = np.add.reduceat(member[words], some - some[0], axis=0, dtype=np.uint8)
    return np.ascontiguousarray(np.cumsum(total, axis=0, dtype=np.int32).T)


def _sums(basis: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The summed vectors of the words of each step. basis: a row for each dimension."""
    bucket = codes & (BUCKETS - 1)
    kept = np.flatnonzero(basis.any(0)[bucket])
    out = np.zeros((len(basis), len(starts)), np.float32)
    if len(kept):
        step, bucket = np.searchsorted(starts, kept, "right") - 1, bucket[kept].astype(np.intp)
        edges = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
        for k, row in enumerate(basis):
            out[k, step[edges]] = np.add.reduceat(row.take(bucket), edges)
    return np.ascontiguousarray(out.T)


def _compare(w: int, i: int, value: float, size: int, codes, counts, begin, starts, doc_of, items: Items, best: dict, least_common: float, least_answer: float) -> None:
    """Keep the pair if the text from a little before the window to a little behind it has enough of the item."""
    doc, item = int(doc_of[w]), items.words[i]
    n = len(item)
    low, high = max(begin[doc], starts[w] - max(n - STEP, STEP)), min(begin[doc] + counts[doc], starts[w] + max(size, n) + STEP)
    near = codes[low:high]
    times = items.times[i]
    if best.get((doc, i), (0.0,))[0] == 1 or sum(map(times.__getitem__, times.keys() & set(near.tolist()))) < least_common * n:
        return
    length, used = common_subsequence(item.tolist(), near)
    common, answer = length / n, float(used[items.answers[i] :].mean())
    if common >= least_common and answer >= least_answer:
        best[doc, i] = max(best.get((doc, i), (0.0, 0.0, 0.0)), (common, answer, value))
