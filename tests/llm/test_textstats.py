import numpy as np

from ballotlens.llm.textstats import NAMES, classify, components, document_statistics, examples, fit_mixture, statistics

DOCS = "doc_id bigint, text string, doc_kind string, component int"
at = {n: i for i, n in enumerate(NAMES)}


def test_counts():
    s = statistics(["The cat sat. It ran!\n\n12 %%", "", " \n ", "naïve Straße"])
    one = s[0]
    assert one[at["n_chars"]] == 27 and one[at["n_words"]] == 6 and one[at["n_lines"]] == 3
    assert abs(one[at["mean_word_length"]] - 16 / 6) < 1e-9 and abs(one[at["symbol_ratio"]] - 2 / 20) < 1e-9 and one[at["punctuated_lines"]] == 0.5
    assert abs(one[at["common_words"]] - 2 / 6) < 1e-9
    assert s[1].tolist()[:3] == [0, 0, 0] and s[2][at["n_words"]] == 0 and s[3][at["n_words"]] == 2


def test_does_not_depend_on_neighbours():
    texts = [t for _, _, ts in examples() for t in ts] + ["", "x", "\n\n"]
    together = statistics(texts)
    alone = np.concatenate([statistics([t]) for t in texts])
    assert np.allclose(together, alone)


#: Held-out texts, none of whose sentences or things is among the examples.
SENTENCES = (
    "Two of the judges walked back to the harbour before the rain came.", "Our neighbours in the valley had never seen a ledger of that size.", "When the lamp went out they waited for an hour and then went home.",
    "She wrote that no one was to touch the shelf until the keys were found.", "Most of it was lost in the fire but the bell is still there.", "El alcalde no quiso firmar la carta que le dieron en la puerta.", "Les enfants du village ont vu le train avant la nuit.", "Der alte Mann und sein Hund gingen nicht mehr auf den Berg.",
)
GOODS = ("rope", "two tin cups", "a spare wheel", "candles", "salt fish", "copper wire", "one map", "the green coat")


def held_out():
    rng = np.random.default_rng(5)
    for n in range(240):
        words = [str(x) for x in rng.choice(SENTENCES, int(rng.integers(3, 9)))]
        yield "prose", ("\n\n" if n % 3 else " ").join(words)
        if n % 6 == 0:
            mark = ("- ", "* ", "{}. ", "• ")[n // 6 % 4]
            yield "list", "\n".join(mark.format(i + 1) + str(x) for i, x in enumerate(rng.choice(GOODS, 14)))
        if n % 6 == 1:
            sep = (",", " | ", "\t", ";")[n // 6 % 4]
            yield "table", "\n".join(sep.join([str(g)[:6], *[str(int(x)) for x in rng.integers(10, 9999, 4)]]) for g in rng.choice(GOODS, 12))
        if n % 6 == 2:
            yield "junk", "".join(str(x) for x in rng.choice(list("~#x!?$ja0- "), 700)) if n % 12 == 2 else "wait here " * 70


def test_classification(spark):
    rows = [(i, text, kind, 0) for i, (kind, text) in enumerate(held_out())]
    rows += [(100_000, None, "junk", 0), (100_001, "", "junk", 0), (100_002, "the words of a long text are read as a whole. " * 20_000 + "And this is its end.", "any", 0)]
    # mostly a table, though every line of it has a frequent word: no share of lines without one could tell
    rows += [(100_003, "\n".join(f"The hall of {g} | {i * 37} | {i * 91} | {i * 13} | {i * 53}" for i, g in enumerate(GOODS * 2, 3)), "table", 0)]
    df = spark.createDataFrame(rows, DOCS)
    found = classify(df.repartition(5))
    got = {r.doc_id: r.doc_kind for r in found.collect()}
    want = {r[0]: r[2] for r in rows if r[2] != "any"}
    assert len(got) == len(rows) and got[100_003] == "table"
    right = sum(want[i] == got[i] != "prose" for i in want)
    assert right >= 0.9 * sum(k != "prose" for k in want.values()) and right >= 0.9 * sum(got[i] != "prose" for i in want)
    named = components(found).collect()
    assert sum(r.n_documents for r in named) == len(rows) and all(got[r.clearest] == r.doc_kind for r in named)


def test_fit_comes_to_rest(spark):
    df = spark.createDataFrame([(i, text, kind, 0) for i, (kind, text) in enumerate(held_out())], DOCS)
    model, names, how = fit_mixture(document_statistics(df))
    assert how["rested"] and how["steps"] < 60 and len(names) == len(model.means) == len(examples())


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert document_statistics(df).count() == 0 and classify(df).count() == 0
