import random
import re
import string

import numpy as np
import pytest
import xxhash
from tables import rows

from tidemerge.llm.components import connected_components
from tidemerge.llm.near_copies import keep_one, near_copy_groups
from tidemerge.llm.sharding import SlotMap, shard_documents
from tidemerge.llm.simhash import Covering, blocks_of, fingerprint_links, near_duplicates, shingles_of, words_of
from tidemerge.llm.substring_dedup import deduplicate, rewritten, runs_of, sentences_of


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    """By the contract, plainly."""
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("width", [16, 21, 22, 32])
def test_covering_codes(width):
    code, rng = Covering(width), np.random.default_rng(1)
    x = rng.integers(0, 1 << width, 500, dtype=np.uint64)
    home = code.home(x)
    assert (np.bitwise_count(home ^ x) <= 1).all() and (code.syndrome(home) == 0).all()
    at, anchors = code.within_two(x)
    assert (np.bitwise_count(anchors ^ x[at]) <= 2).all() and len({*zip(at.tolist(), anchors.tolist(), strict=True)}) == len(at)
    near = {(i, a) for i, a in zip(at.tolist(), anchors.tolist(), strict=True)}
    for i in range(50):
        for j in range(width):
            other = x[i : i + 1] ^ np.uint64(1 << j)
            assert (i, int(code.home(other)[0])) in near


@pytest.mark.parametrize("threshold", [0, 1, 2, 3, 5])
def test_links_equal_brute_force(spark, threshold):
    rng = random.Random(threshold)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(0, threshold + 3)):
                v ^= 1 << b
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    assert all(b - a > 0 for a, b in zip([0, *[s + w for s, w in blocks_of(64, threshold)]], [s + w for s, w in blocks_of(64, threshold)], strict=False))
    expected = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= threshold]
    got = rows(fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), threshold))
    assert got == sorted(expected, key=repr)


def test_near_duplicates_equal_brute_force(spark, small, odd):
    docs = small[0].select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is not null").selectExpr("doc_id + 1000 AS doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: fingerprint(x) for i, x in texts.items()}
    groups = Union(prints)
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                groups.join(a, b)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {(i, f"{p:016x}", groups.find(i)) for i, p in prints.items()}


def test_odd_rows(spark, odd):
    out = near_duplicates(odd).collect()
    assert len(out) == 8 and {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {"0" * 16} and {r.component_id for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert near_duplicates(odd.limit(0)).count() == 0
    assert len(near_copy_groups(odd).collect()) == 8
    assert near_copy_groups(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    groups = Union(range(400))
    for a, b in pairs:
        groups.join(a, b)
    got = dict(rows(connected_components(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {x: groups.find(x) for p in pairs for x in p if p[0] != p[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(small):
    rng, out = random.Random(4), []
    for r in small[0].orderBy("doc_id").collect():
        out.append((r.doc_id, r.text))
        if r.doc_id % 10 == 0:
            words = r.text.split()
            words[rng.randrange(len(words))] = "changed"
            out += [(1000 + r.doc_id, r.text), (2000 + r.doc_id, " ".join(words))]
    return out


def test_near_copies_equal_brute_force(spark, small):
    docs = planted(small)
    sets = {i: frozenset(shingles_of(words_of(x), 5)) for i, x in docs}
    groups = Union(sets)
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                groups.join(a, b)
    table = spark.createDataFrame([(*d, "kept", 3) for d in docs], "doc_id long, text string, _k1 string, node int")
    assert dict(rows(near_copy_groups(table))) == {i: groups.find(i) for i in sets}
    kept = keep_one(table.select("doc_id", "text", "node"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({groups.find(i) for i in sets})


def test_near_copies_with_added_passages(spark):
    rng = random.Random(21)
    common = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    docs, least = [], {}
    for i in range(240):
        text, other = (rng.choices(common, k=n) for n in (300, 80))
        extra = other[: round(300 / (0.81, 0.85, 0.9, 0.95)[i % 4]) - 300]
        at = (300, 0, rng.randrange(20, 280))[i % 3]
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:at] + extra + text[at:]))]
        x, y = (set(shingles_of(words_of(t), 5)) for _, t in docs[-2:])
        least[2 * i + 1] = 2 * i if len(x & y) >= 0.8 * len(x | y) else 2 * i + 1
    assert sum(a != b for a, b in least.items()) > 200
    got = dict(rows(near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string"))))
    assert {i: got[i] for i in least} == least


@pytest.mark.parametrize("block_bytes", [1 << 22, 4000])
def test_near_copies_of_one_large_group_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr("tidemerge.llm.near_copies.BLOCK_BYTES", block_bytes)
    rng, docs = random.Random(23), []
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(120)]
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(120)] = f"w{rng.randrange(1000)}"
        docs.append((i, " ".join(words)))
    sets = {i: set(shingles_of(words_of(x), 5)) for i, x in docs}
    groups = Union(sets)
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                groups.join(a, b)
    assert dict(rows(near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string")))) == {i: groups.find(i) for i in sets}


def test_one_of_repeated_rows_stays(spark, odd):
    kept = keep_one(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "6", "None"] and len(kept[0]) == 4


def plain_removals(docs, run, longest):
    """Character spans of the sentences that a later place of a run covers, run by run."""
    seen, out = {}, {}
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        spans = sentences_of(text or "", longest)
        words = [tuple(re.findall("[\u3400-\u9fff]|[^\\s\u3400-\u9fff]+", text[a:b].lower())) for a, b in spans]
        covered = set()
        for k in range(len(words) - run + 1):
            if tuple(words[k : k + run]) in seen:
                covered |= set(range(k, k + run))
            seen.setdefault(tuple(words[k : k + run]), i)
        out[i] = [spans[k] for k in sorted(covered)]
    return out


def test_clashing_and_dotted_names(spark):
    rows_in = [(1, "a b c d e f g", 1, 2, "x"), (1, "a b c d e f g", 1, 2, "x"), (2, "a b c d e f g", 3, 4, "y"), (3, "own words of this one text", 5, 6, "z")]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string, _k1 int, _low int, `a.b` string").withColumnsRenamed({"_low": "_times"})
    out = keep_one(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows_in[0], rows_in[3]]
    assert sorted(map(tuple, rewritten(docs).collect())) == sorted(rows_in)


def test_copies_that_fingerprints_link(spark):
    from tidemerge.llm.near_copies import _distinct, _linked_fingerprints

    rng = random.Random(31)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    docs = [(0, " ".join(base)), (1, " ".join([*base[:1500], "changed", *base[1501:]])), (2, " ".join(base[::-1]))]
    nodes = _distinct(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text"), 5)
    of = {r.node: r.low for r in nodes.collect()}
    assert [{of[r.a], of[r.b]} for r in _linked_fingerprints(nodes, 2).collect()] == [{0, 1}]


def test_sentences_and_runs():
    assert [("A b. C d"[a:b]) for a, b in sentences_of("A b. C d")] == ["A b.", "C d"]
    assert sentences_of("") == [] and sentences_of(" \n ") == [] and len(runs_of("short. text.")) == 0
    text = "one two three four five six seven eight nine ten"
    assert [text[a:b] for a, b in sentences_of(text, 4)] == ["one two three four", "five six seven eight", "nine ten"]
    wide = "\u4f60\u597d\u5417\uff1f\u6211\u5f88\u597d\u3002\u518d\u89c1"
    assert [wide[a:b] for a, b in sentences_of(wide, 8)] == [wide[:4], wide[4:8], wide[8:]]
    assert len(runs_of("One. Two. Three. Four. " * 3)) == 7 and len(np.unique(runs_of("One. Two. Three. Four. " * 3), axis=0)) == 4


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_runs_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr("tidemerge.llm.substring_dedup.HOT", hot)
    rng = random.Random(9)

    def prose(n, letters="abcdefgh"):
        return " ".join("".join(rng.choices(letters, k=5)).capitalize() + ("." if rng.random() < 0.2 else "") if rng.random() < 0.2 else "".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(n))

    def wide(n):
        return "".join(chr(rng.randrange(0x4E00, 0x9FFF)) + ("\u3002" if rng.random() < 0.15 else "") for _ in range(n))

    passages, chinese = [prose(n) + "." for n in (55, 60, 90)], wide(120)
    docs = [(i, f"{prose(40)}. {passages[i % 3]} {prose(40)}" if i % 4 == 0 else prose(90)) for i in range(40)]
    docs += [(50, passages[0]), (51, None), (52, ""), (53, f"{wide(40)}\u3002{chinese}\u3002{wide(20)}"), (54, f"{wide(30)}\u3002{chinese}"), (55, f"{passages[1]} {passages[1]}"), (56, "So so. " * 30), (None, f"{prose(10)}. {passages[2]}")]
    out = {r.doc_id: r for r in deduplicate(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int")).collect()}
    expected = plain_removals(docs, 6, 8)
    assert sum(map(bool, expected.values())) > 10 and expected[54] and expected[None]
    for i, text in docs:
        assert out[i].n_removed == len(expected[i])
        inside = {c for s in out[i].removed for c in range(s.start, s.end) if not text[c].isspace()}
        assert inside == {c for a, b in expected[i] for c in range(a, b) if not text[c].isspace()}
        if not expected[i]:
            assert out[i].text == text
    for i in range(4, 40, 4):
        if i >= 12:
            assert passages[i % 3] not in out[i].text
    table = spark.createDataFrame([(i, x, len(x or "")) for i, x in docs], "doc_id long, text string, n_chars long")
    kept = {r.doc_id: r for r in rewritten(table).collect()}
    assert 50 not in kept and 51 in kept and 52 in kept and all(r.n_chars == len(r.text or "") for r in kept.values())
    assert {i: r.text for i, r in kept.items()} == {i: r.text for i, r in out.items() if r.text != "" or i == 52}
    assert deduplicate(table.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    passage = " ".join(f"Word{k} of it." for k in range(9))
    docs = [(1, f"Ab cd. {passage}"), (1, f"{passage} Ef gh."), (1, f"{passage} Ef gh."), (None, f"Xy. {passage}"), (None, f"Zz. {passage}")]
    out = deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out if r.doc_id) in ([(1, 0), (1, 0), (1, 9)], [(1, 0), (1, 9), (1, 9)])
    assert [r.n_removed for r in out if not r.doc_id] == [9, 9]


@pytest.mark.parametrize("sizes", [(32, 25), (25, 32), (10, 15, 30), (30, 15, 10), (51,), (52, 3), (3, 52), (12, 12, 30), (35, 8, 8, 31, 2), (120,)])
def test_every_sentence_of_a_repeated_span_is_cut(spark, sizes):
    rng = random.Random(5)

    def sentences(*counts):
        return " ".join(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n)).capitalize() + "." for n in counts)

    passage = sentences(*sizes)
    docs = [(1, f"{sentences(9, 14)} {passage} {sentences(11, 7)}"), (2, f"{sentences(16, 5)} {passage} {sentences(8, 19)}"), (3, f"{sentences(6)} {passage}"), (4, f"{passage} {sentences(7)}")]
    out = {r.doc_id: r for r in deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1].text == docs[0][1] and not out[1].removed
    for i, text in docs[1:]:
        assert [text[s.start : s.end].strip() for s in out[i].removed] == [passage] and out[i].n_removed == sum(-(-n // 8) for n in sizes)


def test_very_long_texts(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(100_000))
    out = {r.doc_id: r for r in deduplicate(spark.createDataFrame([(1, text), (2, f"Own words here. Then: X {text}"), (3, "x" * 500_000)], "doc_id long, text string")).collect()}
    assert not out[1].n_removed and not out[3].n_removed


def test_shards_are_even_and_gapless(spark, small, odd):
    docs = small[0].select("doc_id", "text").unionByName(small[0].selectExpr("doc_id + 500 AS doc_id", "'same text over and over again' AS text"))
    out = shard_documents(docs, shards=8, slots=256).toPandas()
    assert len(out) == 600 and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() <= 1.05 * sizes.mean() and sizes.min() >= 0.95 * sizes.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])
    again = shard_documents(docs.repartition(5), shards=8, slots=256).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert out[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()
    few = shard_documents(odd, shards=3, slots=16).collect()
    assert len(few) == 8 and {r["size"] for r in few if r.doc_id in (1, 2)} == {16} and [r for r in few if r.doc_id == 1][0].text_crc32 is None
    assert shard_documents(odd.limit(0), shards=3, slots=16).count() == 0


def test_equal_texts_stay_together_unless_they_are_too_many(spark, small):
    docs = small[0].select("doc_id", "text").unionByName(small[0].where("doc_id < 40").selectExpr("doc_id + 500 AS doc_id", "text"))
    out = shard_documents(docs, shards=6, slots=512).toPandas()
    assert (out.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_groups_up_to_a_share_stay_whole_and_slots_are_fixed(spark, tmp_path):
    rng = random.Random(12)
    docs = [(i, "".join(rng.choices("abcdef ", k=90))) for i in range(900)] + [(1000 + i, "one text that " * 5) for i in range(100)] + [(None, "another text " * 10)] * 400
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = shard_documents(table, shards=10, slots=2048, store=str(tmp_path)).toPandas()
    assert set(out["map_version"]) == {2} and len(out) == len(docs)
    assert out[out.doc_id.between(1000, 1099)]["shard"].nunique() == 1 and out[out.doc_id.isna()]["shard"].nunique() > 3
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.02 * sizes.mean() and sizes.min() >= 0.98 * sizes.mean()
    more = shard_documents(table.unionByName(table.where("doc_id < 50").selectExpr("doc_id + 5000 AS doc_id", "concat(text, 'x') AS text")), shards=10, slots=2048, store=str(tmp_path)).toPandas()
    assert set(more["map_version"]) == {3}
    both = out.dropna(subset=["doc_id"]).merge(more.dropna(subset=["doc_id"]), on="doc_id")
    assert (both.virtual_slot_x == both.virtual_slot_y).all() and (both.shard_x == both.shard_y).mean() > 0.8
    for frame in (out, more):
        assert all(sorted(s) == list(range(len(s))) for _, s in frame.groupby("shard")["slot"])


def test_slot_maps_have_versions(spark, tmp_path):
    rng = random.Random(6)
    sizes = [rng.randrange(50, 150) for _ in range(400)]
    first = SlotMap.balanced(sizes, 10)
    first.store(spark, str(tmp_path))
    grown = [s * (3 if i % 10 == 0 else 1) for i, s in enumerate(sizes)]
    second = SlotMap.load(spark, str(tmp_path)).rebalanced(grown, 11)
    second.store(spark, str(tmp_path))
    second.store(spark, str(tmp_path))
    back = SlotMap.load(spark, str(tmp_path))
    assert back == second and back.version == 2 and SlotMap.load(spark, str(tmp_path), 1) == first
    assert max(back.loads()) <= 1.1 * sum(grown) / 11
    assert sum(a != b for a, b in zip(first.shard_of, back.shard_of, strict=True)) < 150
