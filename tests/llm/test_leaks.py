import random

import numpy as np

from ballotlens.llm.leaks import exact_leaks, find_leaks, myers
from ballotlens.llm.words import gram_hashes, word_hashes

DOCS, ITEMS = "doc_id bigint, text string, item_id int, passage int", "item_id bigint, passage string, doc_id int, text int"


def edits(a, b):
    """Least edits between a and any stretch of b."""
    last = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return min(last)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1, 1) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, 1, 1) for i, t in items], ITEMS)
    return find_leaks(d, e, **kw)


def test_myers():
    rng = np.random.default_rng(0)
    p, t = rng.integers(1, 4, (300, 13)).astype(np.uint64), rng.integers(1, 4, (300, 17)).astype(np.uint64)
    assert myers(p, t).tolist() == [min(edits(a, b), 13) for a, b in zip(p.tolist(), t.tolist())]


def test_words_and_grams():
    h, start, end, first, joined = word_hashes(["Ab ab-AB", "", "été_é 9", "x"])
    assert [joined[a:b] for a, b in zip(start, end)] == ["ab", "ab", "ab", "été", "é", "9", "x"] and first.tolist() == [0, 3, 3, 6, 7]
    assert len(set(h[:3])) == 1 and len(set(h.tolist())) == 5
    g = gram_hashes(h, 2)
    assert g[0] == g[1] and g[2] not in (g[0], g[3])


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: say(40) for i in range(8)}
    docs = {}
    for i in range(120):
        body, item = say(rng.randrange(0, 60)), items[rng.randrange(8)]
        begin, n = rng.randrange(0, 30), rng.randrange(8, 18)
        piece = item[begin : begin + n]
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(piece))
            rng.choice([lambda: piece.pop(at) if len(piece) > 1 else None, lambda: piece.insert(at, "zz"), lambda: piece.__setitem__(at, "yy")])()
        docs[i] = body[: len(body) // 2] + piece + body[len(body) // 2 :]
    glue = lambda ws: "".join(w.upper() if rng.random() < 0.3 else w for x in ws for w in (x, rng.choice([" ", ", ", "\n", "--"])))
    found = {(r.doc_id, r.item_id): r for r in run(spark, [(i, glue(d)) for i, d in docs.items()], [(i, glue(p)) for i, p in items.items()]).collect()}
    for i, d in docs.items():
        for k, p in items.items():
            least = min(edits(p[a : a + 13], d) for a in range(len(p) - 12))
            assert ((i, k) in found) == (least <= 2), (i, k, least)
            if least <= 2:
                assert found[i, k].distance == least and (least > 0 or found[i, k].run >= 13)


def test_limits_and_odd_input(spark):
    p = " ".join(f"word{i}" for i in range(20))
    twelve, thirteen = " ".join(p.split()[:12]), " ".join(p.split()[3:16])
    docs = [(1, thirteen), (2, twelve), (3, None), (4, ""), (5, "x " * 100_000 + thirteen.upper()), (1, thirteen)]
    items = [(1, p), (2, p), (3, None), (4, ""), (5, "short passage")]
    assert {(r.doc_id, r.item_id) for r in exact_leaks(run(spark, docs, items)).collect()} == {(1, 1), (1, 2), (5, 1), (5, 2)}
    assert {(r.doc_id, r.item_id) for r in exact_leaks(run(spark, docs, items, block_chars=100)).collect()} == {(1, 1), (1, 2), (5, 1), (5, 2)}
    assert run(spark, [], items).count() == 0 and run(spark, docs, []).count() == 0


def test_words_do_not_join_texts(spark):
    p = " ".join(f"word{i}" for i in range(13))
    halves = [(1, " ".join(p.split()[:6])), (2, " ".join(p.split()[6:]))]
    assert run(spark, halves, [(1, p)]).count() == 0


def test_hits_in_slices_lose_nothing():
    from ballotlens.llm.leaks import Index
    from ballotlens.llm.words import gram_hashes, word_hashes

    same = " ".join(["again"] * 60)
    index = Index({same: [1], "one two three four five six seven eight nine ten eleven twelve thirteen": [2]}, 13, 2)
    grams = gram_hashes(word_hashes([same + " one two three four " + same])[0], index.piece)
    whole = [np.concatenate(x) for x in zip(*index.hits(grams, 10**9))]
    sliced = list(index.hits(grams, 100))
    assert len(sliced) > 10 and max(len(a) for a, _, _ in sliced) <= 100
    assert all(np.array_equal(w, np.concatenate(x)) for w, x in zip(whole, zip(*sliced)))
