import random

import numpy as np
import public_tokenizers
import pytest
from tables import rows

from tidemerge.llm.ann import CentroidGraph, fit_centroids, nearest
from tidemerge.llm.decontamination import common_subsequence, find_leaks
from tidemerge.llm.token_counts import attributed, char_spans, count_tokens, paragraphs_of, tokenizer_of


def exact(table, modulus, k):
    fine = {i: np.array(v, np.float64) for i, v in table if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in fine.items():
        if q % modulus == 0:
            found = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in fine.items() if i != q)[:k]
            out[q] = found
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours(spark, clustered):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    x = (centres[rng.integers(0, 20, 3000)] * 2 if clustered else 0) + rng.standard_normal((3000, 16))
    table = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())] + [(5000 + i, x[7].astype(np.float32).tolist()) for i in range(900)]
    got = {}
    for r in nearest(spark.createDataFrame([(i, v, 1) for i, v in table], "vec_id long, embedding array<float>, rank int"), query_modulus=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    truth = exact(table, 50, 10)
    assert set(got) == set(truth)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [(s, i) for _, s, i in found] == sorted((s, i) for _, s, i in found)
        hits += len({i for _, _, i in found} & {i for _, i in truth[q]})
        if q >= 5000:
            assert [i for _, _, i in found] == [i for _, i in truth[q]]
    assert hits / (10 * len(truth)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [1.0]), (100, [0.5, 0.5])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    assert rows(nearest(df).select("query_id", "rank", "vec_id")) == [(0, 1, 100), (0, 2, 7), (0, 3, 8), (100, 1, 0), (100, 2, 7), (100, 3, 8)]
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("vec_id = 0")).count() == 0


def test_distances_of_doubles_and_of_other_lengths(spark):
    table = [(0, [16777217.0, 1.0]), (1, [16777216.0, 1.0]), (2, [16777218.5, 1.0]), (100, [1.0]), (3, [4.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    assert rows(nearest(df)) == [(0, 1, 1, 1.0), (0, 2, 2, 1.5), (100, 1, 3, 3.0)]


def test_ratio_prunes_lists_of_clustered_vectors():
    rng = np.random.default_rng(9)
    centres = 4 * rng.standard_normal((150, 32))
    x = (centres[rng.integers(0, 150, 20_000)] + rng.standard_normal((20_000, 32))).astype(np.float32)
    graph = CentroidGraph(fit_centroids(x, 156))
    probed = [len(graph.search(q, 1.3, 24)) for q in x[:300]]
    assert np.mean(probed) < len(graph.centroids) / 5


def test_graph_finds_nearest_centroids():
    rng = np.random.default_rng(2)
    c = fit_centroids(rng.standard_normal((4000, 8)), 300)
    graph = CentroidGraph(c)
    hits = 0
    for q in rng.standard_normal((200, 8)):
        d = ((c - q) ** 2).sum(1)
        hits += graph.search(q, 1.2, 24)[0] == d.argmin()
    assert hits >= 190


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(n))


def test_leaks(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 18 + 3 * i)) for i in range(12)]
    docs = [(i, prose(rng, 150)) for i in range(250)]
    expected = set()
    for k, (item, text) in enumerate(items):
        doc, words = docs[10 * k], text.split()
        if k % 2:  # reworded: every sixth word changed
            words = [w if j % 6 else "other" for j, w in enumerate(words)]
        docs[10 * k] = (doc[0], f"{doc[1][:200]} {' '.join(words).upper()} {doc[1][200:]}")
        expected.add((doc[0], item))
    docs += [(1000, None), (1001, ""), (1002, items[3][1]), (1003, " ".join(items[4][1].split()[:6]))]
    expected.add((1002, 3))
    bench = [*items, (50, None), (51, ""), (52, "too short")]
    table = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, cosine double")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = find_leaks(table, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    assert all(0.6 <= r.common <= 1 and 0.5 <= r.answer <= 1 for r in got)
    assert find_leaks(table, benchmark.limit(0)).count() == 0 and find_leaks(table.limit(0), benchmark).count() == 0


def test_an_item_in_very_many_documents_is_found(spark):
    rng = random.Random(4)
    item = prose(rng, 30)
    docs = [(i, f"{prose(rng, 40)} {item} {prose(rng, 20)}" if i % 3 == 0 else prose(rng, 90)) for i in range(900)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {i for i in range(900) if i % 3 == 0}


def test_short_items_are_found_in_a_row(spark):
    rng = random.Random(14)
    docs = [(i, prose(rng, 60)) for i in range(60)]
    docs[5], docs[6], docs[7] = (5, f"{docs[5][1]}, Seven words that are in a row!"), (6, f"seven words that are in a {docs[6][1]} row"), (7, "words that are seven words that are in a row")
    docs += [(8, "seven words that are in a row")] * 2 + [(None, "Seven words that are in a row")]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "seven words that are in a row"), (2, "seven words that are in a row"), (3, "row seven"), (4, "!")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (5, 7, 8, None) for i in (1, 2)} and len(got) == 8
    assert all(r.common == r.answer == 1 and 0 <= r.cosine <= 1.000001 for r in got)


def plain_leaks(docs, items, least=0.6, answer=0.5):
    """Pairs whose words have a common subsequence of the rule within some stretch of twice the item's words."""
    import re

    words = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in docs}
    out = set()
    for item, text in items:
        own = re.findall(r"[a-z0-9]+", text.lower())
        n = len(own)
        for i, all_words in words.items():
            for start in range(0, max(1, len(all_words) - n + 1), 4):
                part = all_words[start : start + 2 * n]
                if len(set(part) & set(own)) < 0.3 * len(set(own)):
                    continue
                number = {w: k for k, w in enumerate(sorted({*own, *part}))}
                length, used = common_subsequence([number[w] for w in own], np.array([number[w] for w in part]))
                if length >= least * n and used[n - min(n, max(4, n // 4)) :].mean() >= answer:
                    out.add((i, item))
                    break
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(15)
    items = [(i, prose(rng, rng.randrange(10, 60))) for i in range(25)]
    docs = [(i, prose(rng, rng.randrange(1, 200))) for i in range(200)]
    for k in range(60):
        words = rng.choice(items)[1].split()
        changed = [w if rng.random() > 0.04 * (k % 12) else prose(rng, 1) for w in words]
        i = rng.randrange(200)
        docs[i] = (i, f"{docs[i][1]} {' '.join(changed)} {prose(rng, 20)}")
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = plain_leaks(docs, items)
    assert expected <= got and len(expected) > 30 and len(got - expected) <= 1  # the text around a window may be a little longer


def test_copies_that_keep_only_common_words_are_found(spark):
    rng = random.Random(8)
    common = prose(rng, 150).split()
    rare = [f"rare{k}" for k in range(3000)]
    docs = [(i, [rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randrange(90, 150))]) for i in range(600)]
    items, expected = [], set()
    for i in range(40):
        n = rng.choice([24, 32, 40])
        words = [rng.choice(common) if j % 10 < 7 else rng.choice(rare) for j in range(n)]
        copy = [w if w in common or j % 30 == 9 else rng.choice(rare) for j, w in enumerate(words)]
        text = docs[13 * i][1]
        at = rng.randrange(len(text))
        text[at:at] = copy
        items.append((i, " ".join(words)))
        expected.add((13 * i, i))
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == expected


def test_common_subsequences():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        length, used = common_subsequence(a, np.array(b))
        assert length == table[-1, -1] == used.sum()


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_tokens_of_sections_add_up(spark, odd):
    texts = [(10, "First line.\n\nSecond line with wörds 漢字😀\nthird"), (11, "\n\n"), (12, "x" * 3000), (13, "<|endoftext|> is text")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    with open(RANKS, "rb") as file:
        encode, _ = tokenizer_of(file.read(), public_tokenizers.PATTERN)
    out = count_tokens(docs, RANKS, public_tokenizers.PATTERN).collect()
    for i, text in texts:
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.section)
        assert [r.start for r in mine] == paragraphs_of(text) and mine[-1].end == len(text)
        assert sum(r.n_tokens for r in mine) == len(encode(text)) == mine[0].doc_tokens
    assert [r.n_tokens for r in out if r.doc_id in (1, 2)] == [0, 0]
    assert count_tokens(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def plain_counts(text, spans, starts, rule):
    """Tokens and crossing tokens of each section, span by span."""
    ends, tokens, crossing = [*starts[1:], len(text)], [0] * len(starts), [0] * len(starts)
    for a, b in spans:
        inside = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
        held = [k for k, n in enumerate(inside) if n]
        own = {"most": max(held, key=lambda k: (inside[k], -k)), "first": held[0], "last": held[-1]}[rule]
        tokens[own] += 1
        crossing[own] += len(held) > 1
    return list(zip(tokens, crossing, strict=True))


@pytest.mark.parametrize("rule", ["most", "first", "last"])
def test_sections_equal_a_plain_loop(spark, rule):
    import base64

    with open(RANKS, "rb") as file:
        content = file.read()
    encode, _ = tokenizer_of(content, public_tokenizers.PATTERN)
    token = {int(n): base64.b64decode(t) for t, n in map(bytes.split, content.splitlines())}
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(["word ", "\n", "\n\n", " \n \n", "w\u00f6rd", "\U0001f600", "\u6f22", "x.\n", "  ", "\n  \n"]) for _ in range(60)) + ".") for i in range(40)]
    texts += [(90, " " * 1_000_000), (91, "a" + " " * 300_000 + "\n" + " " * 5000 + "b")]
    out = count_tokens(spark.createDataFrame(texts, "doc_id long, text string"), RANKS, public_tokenizers.PATTERN, rule=rule).collect()
    for i, text in texts:
        data, at, spans = text.encode(), 0, []
        for n in encode(text):
            end = at + len(token[n])
            spans.append((len(data[:at].decode(errors="ignore")), len(data[:end].decode(errors="replace"))) if i < 90 else (at, end))
            at = end
        assert at == len(data)
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.section)
        assert [(r.n_tokens, r.crossing) for r in mine] == plain_counts(text, spans, [r.start for r in mine], rule)


def test_border_rules():
    starts, ends, sections = np.array([0, 2, 4, 9]), np.array([2, 4, 9, 10]), np.array([0, 3, 8])
    assert attributed(starts, ends, sections, 10, "most").tolist() == [0, 0, 1, 2]
    assert attributed(starts, ends, sections, 10, "first").tolist() == [0, 0, 1, 2]
    assert attributed(starts, ends, sections, 10, "last").tolist() == [0, 1, 2, 2]
    with pytest.raises(ValueError):
        attributed(starts, ends, sections, 10, "any")


def test_parts_of_characters_cover_them():
    data = "aé漢".encode()
    starts, ends = char_spans(data, np.array([1, 1, 1, 2, 1]))
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 1), (1, 2), (1, 2), (2, 3), (2, 3)]
