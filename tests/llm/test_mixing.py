import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotlens.llm.mixing import TOKENIZERS, encoder, mix, mix_sources, rake, shares

DOCS = "doc_id bigint, text string, lang string, source string, election_id string, n_tokens int, copies int"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def test_rake_meets_marginals_and_caps():
    cells = [(s, x, "t") for s in "ab" for x in ("en", "de")]
    tokens = np.array([100.0, 300.0, 50.0, 150.0])
    uses, gap = rake(tokens, cells, np.array([2.0, 2.0, 4.0, 4.0]), [{"a": 0.5, "b": 0.5}, {"en": 0.4, "de": 0.6}, {}], 800)
    got = tokens * uses
    assert gap < 0.01
    assert abs(got[:2].sum() - 400) < 1e-6 and abs(got[2:].sum() - 400) < 1e-6 and abs(got[[0, 2]].sum() - 320) < 5 and (uses <= [2, 2, 4, 4]).all()


def test_rake_is_the_least_change():
    """Without binding caps all marginals are met and uses are products of factors, which no scaling of sources alone gives."""
    rng = np.random.default_rng(3)
    cells = [(s, x, t) for s in "abc" for x in ("en", "de", "fr") for t in ("1", "2")]
    tokens = rng.integers(50, 900, len(cells)).astype(float)
    part = lambda d, v: float(sum(t for t, c in zip(tokens, cells) if c[d] == v)) / tokens.sum()
    marginals = [{"a": 0.5, "b": 0.3, "c": 0.2}, {x: part(1, x) for x in ("en", "de", "fr")}, {t: part(2, t) for t in "12"}]
    uses, gap = rake(tokens, cells, np.full(len(cells), 50.0), marginals, 2000.0)
    assert gap < 1e-8
    for d, m in enumerate(marginals):
        for v, share in m.items():
            assert abs(sum(t * u for t, u, c in zip(tokens, uses, cells) if c[d] == v) - share * 2000) < 1e-5
    design = np.array([[c[0] == s for s in "abc"] + [c[1] == x for x in ("en", "de", "fr")] + [c[2] == t for t in "12"] for c in cells], float)
    fit = design @ np.linalg.lstsq(design, np.log(uses), rcond=None)[0]
    assert np.allclose(fit, np.log(uses), atol=1e-6)
    alone = np.array([marginals[0][c[0]] / part(0, c[0]) for c in cells]) * 2000 / tokens.sum()
    assert np.max(np.abs(uses / alone - 1)) > 0.02


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


@needs_vocabulary
def test_shares_and_repeats(spark):
    rows = [(i, f"text number {i} " + "word " * (i % 17), ["en", "de", None][i % 3], ["big", "mid", "tiny"][0 if i % 10 else 1 if i % 50 else 2], f"el-203{i % 3}-1" if i % 7 else None) for i in range(1, 2000)]
    rows += [(5000 + i, *rows[i][1:]) for i in range(100)] + [(9001, None, "en", "big", None), (9002, "", "en", "big", None), (9003, "no target", "en", "other", None)]
    t = targets(spark, [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 3), ("absent", 0.4, 1)])
    topic = F.regexp_extract("election_id", r"^el-(\d{4})", 1)
    plan, goals = mix(docs(spark, rows).repartition(4), t, topic)
    got = {(r.part, r.value): r for r in shares(plan, goals).collect()}
    for s, want in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(got["source", s].actual_share - want) < 0.01, got
    assert ("source", "absent") not in got and got["source", "tiny"].most_copies <= 3 and got["source", "big"].most_copies == 1
    for (p, v), r in got.items():
        assert abs(r.actual_share - r.fitted_share) < 0.03, (p, v, r)
    used = plan.collect()
    texts = {i: t for i, t, *_ in rows}
    assert len({texts[r.doc_id] for r in used}) == len(used) and not {r.doc_id for r in used} & {9001, 9002, 9003}
    e = encoder(VOCABULARY)
    assert all(r.n_tokens == len(e.encode_ordinary(texts[r.doc_id])) for r in used[:50])
    again = mix_sources(docs(spark, rows[::-1]).repartition(7), t, topic)
    assert sorted(map(tuple, again.select("doc_id", "copies").collect())) == sorted((r.doc_id, r.copies) for r in used)


@needs_vocabulary
def test_empty(spark):
    t = targets(spark, [("a", 1.0, 1)])
    assert mix_sources(docs(spark, []), t, F.lit("x")).count() == 0
    assert mix_sources(docs(spark, [(1, "x", "en", "a", None)]), targets(spark, []), F.lit("x")).count() == 0
    assert [r.copies for r in mix_sources(docs(spark, [(1, "one text", None, "a", None)]), t, F.lit("x")).collect()] == [1]
