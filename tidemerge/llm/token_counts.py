"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole, so that section borders change no token. Each token's character span is joined to the
sections it overlaps. A token across a border goes to one section by an explicit rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, kept_in_worker, record_batch, slim

#: Rules for a token that overlaps several sections: the one with most of its characters (ties: the first), that of its first character, or of its last.
RULES = ("most", "first", "last")
#: White space as word patterns have it (fixed values: Unicode's White_Space). A pattern's engine can't look behind runs of any length.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
_PARAGRAPH = re.compile(r"\n+")


def paragraphs_of(text: str) -> list[int]:
    """Where each section starts: lines, each with the line ends after it. An empty text has one empty section."""
    return [0, *(m.end() for m in _PARAGRAPH.finditer(text) if m.end() < len(text))]


def attributed(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int, rule: str) -> np.ndarray:
    """The section of each token: an interval join of spans [start, end) with sections from ``sections[k]`` to the next.

    Empty spans belong to the section in which they lie.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    low = np.searchsorted(sections, starts, "right") - 1
    high = np.maximum(low, np.searchsorted(sections, np.maximum(ends - 1, starts), "right") - 1)
    if rule == "first":
        return low
    if rule == "last":
        return high
    bounds, out = np.append(sections, length), low.copy()
    for t in np.flatnonzero(high > low):
        parts = [min(ends[t], bounds[k + 1]) - max(starts[t], bounds[k]) for k in range(low[t], high[t] + 1)]
        out[t] = low[t] + int(np.argmax(parts))
    return out


def char_spans(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of consecutive tokens of ``sizes`` bytes; a token holding a part of a character covers it all."""
    sofar = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
    ends = np.cumsum(sizes)
    return sofar[ends - sizes] - 1, sofar[ends - 1]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", rule: str = "most") -> DataFrame:
    """One row per section: doc_id, section (from 0), start, end (characters), n_tokens, crossing (its tokens that cross a border), doc_tokens.

    ranks_path, pattern: a byte-level BPE vocabulary (base64 bytes and rank, line by line) and its word pattern. The tokens of a
    document's sections add up to doc_tokens. Null and empty texts have one section without tokens. Texts are encoded whole,
    whatever their length (in long runs of blanks the pattern must end a word before the last blank, as those of byte-level BPE do);
    strings of special tokens are ordinary text. Rows with equal ids are counted row by row; other columns
    are ignored. The vocabulary is read by the driver and sent once (about a megabyte; its size is checked).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks_path, "rb") as file:
        content = file.read()
    if len(content) > 64 << 20:
        raise ValueError("the vocabulary is too large to be sent to every executor")
    sent = docs.sparkSession.sparkContext.broadcast((content, pattern))
    schema = "doc_id long, section int, start int, end int, n_tokens int, crossing int, doc_tokens long"
    target = arrow_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size_of = kept_in_worker(("ranks", hash(sent.value)), lambda: tokenizer_of(*sent.value))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                columns_of: list[list[np.ndarray]] = [[] for _ in range(6)]
                lengths = []
                for text in part.column("text"):
                    text = text.as_py() or ""
                    ids = np.array(encode(text), np.int64)
                    starts, ends = char_spans(text.encode(), size_of[ids]) if len(ids) else (ids, ids)
                    sections = np.array(paragraphs_of(text), np.int64)
                    place = attributed(starts, ends, sections, len(text), rule)
                    crosses = np.searchsorted(sections, np.maximum(ends - 1, starts), "right") > np.searchsorted(sections, starts, "right")
                    n = len(sections)
                    lengths.append(n)
                    columns = np.arange(n), sections, np.append(sections[1:], len(text)), np.bincount(place, minlength=n), np.bincount(place[crosses], minlength=n), np.full(n, len(ids))
                    for column, value in zip(columns_of, columns, strict=True):
                        column.append(value)
                ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), lengths)))
                yield record_batch(target, {"doc_id": ids} | {f.name: np.concatenate(c) for f, c in zip(list(target)[1:], columns_of, strict=True)})

    return slim(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def tokenizer_of(content: bytes, pattern: str) -> tuple:
    """(encoder of a text, bytes of each token)."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        """Ids. A long run of blanks is a word by itself, but for its last blank if more text follows: so the patterns have it."""
        if len(text) < 1000 or not (runs := [m.span() for m in _BLANKS.finditer(text)]):
            return encoding.encode_ordinary(text)
        ids, at = [], 0
        for start, end in runs:
            end -= end < len(text)
            ids += encoding.encode_ordinary(text[at:start])
            ids += encoding._encode_single_piece(text[start:end].encode())
            at = end
        return ids + encoding.encode_ordinary(text[at:])

    return encode, sizes
