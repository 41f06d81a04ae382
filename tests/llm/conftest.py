import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def small(spark):
    """A few hundred generated documents with planted copies, passages, toxic words and languages."""
    import random

    rng = random.Random(11)
    syllables = {"aa": ["ba", "lo", "mi", "tu", "ren", "sol"], "bb": ["xi", "qua", "zed", "wor", "kel", "ny"]}
    rows, labels = [], []

    def words(lang, n):
        return ["".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(n)]

    def prose(lang, n):
        out = words(lang, n)
        for k in range(0, n, 9):
            out[k] = out[k].capitalize()
            if k:
                out[k - 1] += "."
        return " ".join(out) + "."

    for i in range(300):
        lang = "aa" if i % 3 else "bb"
        text = prose(lang, rng.randrange(40, 160))
        toxic = i % 5 == 0
        if toxic:
            parts = text.split(" ")
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(["foulword", "nastyterm", "vilethings"]))
            text = " ".join(parts)
        if i % 7 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, int(i % 7 != 0), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty texts, repeated rows, a clashing column."""
    return spark.createDataFrame(
        [(1, None, None, 1), (2, "", "aa", 2), (None, "one two three four five six", None, 3), (3, " \n\t ", "", 4), (4, "a", "aa", 5), (4, "a", "aa", 5), (5, "12 34 !!", None, None), (6, "é" * 5000 + " x" * 5000, "aa", 6)],
        "doc_id long, text string, lang string, score int",
    ).cache()
