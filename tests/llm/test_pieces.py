import hashlib
import random
import sys

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemerge.llm.sentencepiece_bpe import PrefixTableBpe, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
with open(PATH, "rb") as _file:
    TABLE = PrefixTableBpe(_file.read())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab  \n▁sS.,=-<0x41>é漢", max_size=60))
def test_ids_and_text_equal_the_library(text):
    ids = TABLE.encode(text)
    assert ids == LIBRARY.encode(text)
    assert TABLE.decode(ids) == LIBRARY.decode(ids)


def test_decoding_of_any_ids():
    rng = random.Random(0)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(0, 259), rng.randrange(32000), 29871]) for _ in range(rng.randrange(8))]
        assert TABLE.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "  a", " " * 40 + "x", "=" * 500, "s" * 300, "<s>a</s>", "a\x00b", "word " * 5000, "漢字" * 2000])
def test_edges(text):
    assert TABLE.encode(text) == LIBRARY.encode(text)


def test_memo_is_bounded():
    with open(PATH, "rb") as file:
        small = PrefixTableBpe(file.read(), memo_units=50)
    for k in range(300):
        text = f"word{k} other{k * 7} the"
        assert small.encode(text) == LIBRARY.encode(text)
        assert len(small.memo) <= 60 and len(small.pairs) <= 200


def test_memo_is_small():
    with open(PATH, "rb") as file:
        table = PrefixTableBpe(file.read())
    rng, syllables = random.Random(5), ["ba", "lo", "mi", "tu", "ren", "sol", "ka", "des", "tion", "er"]
    for _ in range(260):
        table.encode(" ".join("".join(rng.choices(syllables, k=6)) for _ in range(1000)))
    held = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (table.memo, table.memo.old, table.pairs))
    assert held < 40 << 20


def test_units_end_at_stops_and_lines():
    text = "Gone.\nHe said².\tx. Gone.\x00Gone\n\n\nv2.0 e.g. ²². a.b"
    units = TABLE.units.findall("▁" + text.replace(" ", "▁"))
    assert "".join(units) == "▁" + text.replace(" ", "▁")
    assert units[:4] == ["▁Gone", ".", "\n", "He"] and "Gone" in units
    assert TABLE.encode(text) == LIBRARY.encode(text)


def test_batches_are_not_held(spark, monkeypatch):
    import pyarrow as pa

    from tidemerge.llm import sentencepiece_bpe

    sent = {}
    monkeypatch.setattr(sentencepiece_bpe, "slim", lambda docs, **_: type("Docs", (), {"mapInArrow": lambda _, run, fields: sent.update(run=run)})())
    encode_documents(spark.range(1), PATH, with_text=False)
    before, held, sizes = pa.total_allocated_bytes(), [], []

    def batches():
        for _ in range(3):
            held.append(pa.total_allocated_bytes() - before)
            yield pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(["word " * 2000] * 400)], ["doc_id", "text"])

    for out in sent["run"](batches()):
        sizes.append(sum(out.column("n_tokens").to_pylist()))
        assert out.column("decoded").null_count == out.num_rows
        del out
    assert sum(sizes) == 3 * 400 * len(LIBRARY.encode("word " * 2000)) and max(sizes) < 1 << 20
    assert max(held) < 1 << 20


def test_documents(spark):
    docs = spark.createDataFrame([(1, "Hello wörld", 9), (2, None, 9), (3, "", 9), (1, "Hello wörld", 9), (None, "x\n", 9)], "doc_id long, text string, n_tokens int")
    out = encode_documents(docs, PATH).collect()
    assert len(out) == 5
    for row in out:
        text = {1: "Hello wörld", 2: "", 3: "", None: "x\n"}[row.doc_id]
        ids = LIBRARY.encode(text)
        assert row.ids == ids and row.n_tokens == len(ids) and row.decoded == LIBRARY.decode(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert encode_documents(docs.limit(0), PATH).count() == 0
