"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

The encoder keeps, for each prefix of a unit, the one last piece that the prefix's encoding ends with. Candidates are the
pieces that an Aho-Corasick automaton finds ending there; a candidate is right if the piece before it (the table's entry
where the candidate starts) and the candidate are compatible, that is, if their joined text encodes to exactly these two.
Ids are then read off backwards. One pass, no priority queue, linear in the length of the text.

No piece holds the space mark after another character, so no merge crosses from a word to the next mark; nor does any
cross from a word to a comma, a stop and the like, or to a line's end. Text is therefore cut into such units, which are encoded
independently and remembered in a bounded memo.

Defined results: null and empty texts give no ids and the empty text; characters without a piece become byte pieces; texts
of any length are encoded whole. Rows with equal ids or texts are treated row by row. Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_of, kept_in_worker, record_batch, slim
from .word_hashes import slices

MARK = "▁"
LAST = float("inf")
#: Kinds of pieces in a SentencePiece model file (fixed values of the public format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PrefixTableBpe:
    """An encoder and decoder for one BPE model with byte fallback.

    model: the bytes of a ``.model`` file. memo_units: units remembered at most (each some 200 bytes), and half as many pairs of pieces.
    """

    def __init__(self, model: bytes, memo_units: int = 200_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normalisation with space marks before words is known here")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not known here")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.id_of, self.score, self.byte_id = {}, {}, [0] * 256
        self.bytes_of = [b""] * len(proto.pieces)
        self.is_byte, self.unknown = [False] * len(proto.pieces), proto.trainer_spec.unk_surface
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError("a piece holds a space mark after another character")
                self.id_of[p.piece], self.score[p.piece] = i, p.score
                self.bytes_of[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], self.is_byte[i], self.bytes_of[i] = i, True, bytes([value])
            elif p.type == UNKNOWN:
                self.bytes_of[i] = self.unknown.encode()
        scores = [p.score for p in proto.pieces if p.type == NORMAL and p.piece.strip(MARK)]
        if len(scores) != len({*scores}):
            raise ValueError("pieces other than runs of space marks share a score")
        self.controls = {i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        self.text_of_id = [str(i) for i in range(len(proto.pieces))]
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[str, ...]] = {}
        self.units = re.compile(_units_pattern(self.id_of))
        self.limit = memo_units
        self.memo = _Memo(self.encode_unit)

    def merged(self, text: str) -> tuple[list[str], tuple[str, ...]]:
        """A short text's pieces by the definition, and the last two that were joined.

        The definition: join the best-scoring, then leftmost, neighbours while any join is a piece.
        """
        symbols, score, joined = list(text), self.score, ()
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            joined = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols, joined

    def parts_of(self, piece: str) -> tuple[str, ...] | None:
        """The two pieces that a piece is joined from; none for one character; None if its own text doesn't encode to it."""
        try:
            return self.parts[piece]
        except KeyError:
            symbols, joined = self.merged(piece)
            self.parts[piece] = found = joined if len(symbols) == 1 else None
            return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether the joined text of two reachable pieces encodes to just these two.

        Going back in time from the finished pieces, the neighbours at the boundary are looked at in each state that lasted
        until a join of score ``until``: a piece across the boundary that scores better, or as well and stands further left, would have
        come first.
        """
        score = self.score
        if left not in score:
            return True
        if left[-1] == MARK and right[0] == MARK:  # runs of marks share one score, so only position decides
            return self.merged(left + right)[0] == [left, right]
        until, inside_right = -LAST, False
        while True:
            across = score.get(left + right)
            if across is not None and (across > until or across == until and inside_right):
                return False
            formed_left = score[left] if len(left) > 1 else LAST
            formed_right = score[right] if len(right) > 1 else LAST
            if formed_left == LAST == formed_right:
                return True
            if formed_left < formed_right:
                until, inside_right, left = formed_left, False, self.parts_of(left)[1]
            else:
                until, inside_right, right = formed_right, True, self.parts_of(right)[0]

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        pairs = self.pairs
        if 2 * len(pairs) > self.limit:
            pairs.clear()
        last = ["", *unit]  # a character without a piece stands for itself
        filled = -1
        for end, piece in self.automaton.iter(unit):  # by end, the longest first
            if end == filled:
                continue
            start = end + 1 - len(piece)
            if start:
                pair = (last[start], piece)
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.parts_of(piece) is not None and self.compatible(*pair)
            else:
                fits = self.parts_of(piece) is not None
            if fits:
                last[end + 1], filled = piece, end
        ids: list[int] = []
        i = len(unit)
        while i:
            piece = last[i]
            if (known := self.id_of.get(piece)) is not None:
                ids.append(known)
            else:
                ids += [self.byte_id[b] for b in reversed(piece.encode())]
            i -= len(piece)
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        units = self.units.findall(self.prefix + text.replace(" ", MARK))
        ids = list(chain.from_iterable(map(self.memo.__getitem__, units)))
        if 2 * len(self.memo) > self.limit:
            self.memo.age()
        return ids

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of the decoded text. A byte piece that is no part of a character becomes U+FFFD."""
        ids = list(ids)
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            data.decode()
            broken = not self.controls.isdisjoint(ids)
        except UnicodeDecodeError:
            broken = True
        if broken:
            data = self._repaired(ids)
        first = next((i for i in ids if self.bytes_of[i]), None)
        return data[1:] if self.prefix and first is not None and not self.is_byte[first] and data[:1] == b" " and self.bytes_of[first] != self.unknown.encode() else data

    def _repaired(self, ids: list[int]) -> bytes:
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            k = 0
            while k < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[k : k + n]).decode().encode() if k + n <= len(run) else b"\xef\xbf\xbd")
                    except UnicodeDecodeError:
                        continue
                    k += n if k + n <= len(run) else 1
                    break
                else:
                    out.append(b"\xef\xbf\xbd")
                    k += 1
            run.clear()
            if i >= 0:
                out.append(self.bytes_of[i])
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode()


def _units_pattern(pieces: Iterable[str]) -> str:
    """Cuts before marks, around ASCII characters of no piece, and between a letter and a sign that follows it in no piece. No join can cross such cuts."""
    letter, known = r"[^\W\d_]", {c for piece in pieces for c in piece}
    loose = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in known and not chr(i).isalnum() and chr(i) != "_")
    before: dict[str, set[str]] = {c: set() for c in known if not c.isalnum() and c not in MARK + "_"}
    for piece in pieces:
        for a, b in zip(piece, piece[1:], strict=False):
            if b in before and re.match(letter, a):
                before[b].add(a)
    after = "".join(re.escape(c) for c in sorted(before) if not before[c])
    cuts = [f"(?=[{after}])"] if after else []
    cuts += [f"(?<![{''.join(map(re.escape, sorted(letters)))}])(?={re.escape(c)})" for c, letters in sorted(before.items()) if letters]
    ends = [f"(?=[{MARK}{loose}])", r"\Z"]
    inside = [f"(?<={letter})(?:{'|'.join(cuts)})"] * bool(cuts) + [f"(?<=[{loose}])"] * bool(loose)
    return rf"{MARK}*{letter}+(?:{'|'.join(ends + cuts)})|{MARK}*[^{MARK}]+?(?:{'|'.join(ends + inside)})|{MARK}+"


class _Memo(dict):
    """Units and their ids, in two generations: what isn't met again while the younger fills is forgotten. Long units aren't kept."""

    def __init__(self, encode):
        self.encode = encode
        self.old: dict[str, tuple[int, ...]] = {}
        super().__init__()

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.encode(unit)
        if len(unit) <= 48:
            self[unit] = ids
        return ids

    def age(self) -> None:
        self.old = dict(self)
        self.clear()


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (array, null unless with_ids), decoded (null unless with_ids and with_text), ids_sha256, decoded_sha256.

    The model file is read by the driver and sent to the executors once (half a megabyte; its size is checked).
    """
    with open(model_path, "rb") as file:
        model = file.read()
    if len(model) > 64 << 20:
        raise ValueError("the model file is too large to be sent to every executor")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = "doc_id long, n_tokens long, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string"
    target = arrow_of(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept_in_worker(("pieces", hash(sent.value)), lambda: PrefixTableBpe(sent.value))
        gc.disable()  # millions of small tuples without cycles
        try:
            yield from encoded(table, batches)
        finally:
            gc.enable()

    def encoded(table: PrefixTableBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: dict[str, list] = {f.name: [] for f in target}
                out["doc_id"] = part.column("doc_id").to_pylist()  # a column would keep the whole batch
                for text in part.column("text"):
                    ids = table.encode(text.as_py())
                    data = table.decode_bytes(ids)
                    out["n_tokens"].append(len(ids))
                    out["ids"].append(ids if with_ids else None)
                    out["decoded"].append(data.decode() if with_ids and with_text else None)
                    out["ids_sha256"].append(hashlib.sha256(",".join(map(table.text_of_id.__getitem__, ids)).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
                yield record_batch(target, out)
            batch = part = text = None  # not held while the next batch is read

    return slim(docs, doc_id=id_col, text=text_col).mapInArrow(run, fields)
