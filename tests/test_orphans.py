import datetime as dt

from ballotlens.operators import orphans
from ballotlens.operators.nested import session_candidates
from ballotlens.operators.orphans import Reference, find_orphans, orphan_counts

T0 = dt.datetime(2031, 1, 1)
day = lambda n, h=0: T0 + dt.timedelta(days=n, hours=h)
ROWS, PARENT = "record_id bigint, missing_key bigint, at timestamp_ntz, heavy int, n int", "missing_key bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz, note string"


def run(spark, rows, parent, **kw):
    ref = Reference("r", spark.createDataFrame([(*r, 1, 1) for r in rows], ROWS), spark.createDataFrame([(*p, "x") for p in parent], PARENT))
    return find_orphans([ref], **kw)


def brute(rows, parent):
    out = set()
    for rec, key, at in rows:
        if key is None:
            continue
        spells = [(a or dt.datetime.min, b) for k, a, b in parent if k == key]
        if not spells:
            out.add((rec, key, "missing"))
        elif at is not None and not any(a <= at and (b is None or at < b) for a, b in spells):
            out.add((rec, key, "late" if min(a for a, _ in spells) > at else "deleted"))
    return out


def test_against_brute_force_with_hot_key(spark):
    import random

    rng = random.Random(3)
    parent = [(k, day(rng.randrange(20)), day(20 + rng.randrange(20)) if rng.random() < 0.6 else None) for k in range(30) for _ in range(2)] + [(1, None, day(2)), (1, day(1), day(1))]
    rows = [(i, 1 if i % 3 == 0 else rng.choice([None, *range(40)]), None if rng.random() < 0.02 else day(rng.randrange(50), rng.randrange(24))) for i in range(1500)]
    rows += rows[:100]
    for share in (0.2, 1e-6, 1.0):
        found = {(r.record_id, r.missing_key, r.orphan_kind) for r in run(spark, rows, parent, heavy_share=share).collect()}
        assert found == brute(rows, parent)


def test_open_groups_beyond_a_broadcast(spark, monkeypatch):
    rows = [(i, 1 if i % 3 == 0 else i % 50, day(i % 40)) for i in range(900)]
    parent = [(k, day(20), day(30)) for k in range(2, 40)]
    for most in (3, 10_000):
        monkeypatch.setattr(orphans, "BROADCAST_ROWS", most)
        found = {(r.record_id, r.missing_key, r.orphan_kind) for r in run(spark, rows, parent, heavy_share=0.1).collect()}
        assert found == brute(rows, parent)


def test_bounds_of_a_spell(spark):
    rows = [(1, 5, day(1)), (2, 5, day(2)), (3, 5, day(0, 23))]
    assert {(r.record_id, r.orphan_kind) for r in run(spark, rows, [(5, day(1), day(2))]).collect()} == {(2, "deleted"), (3, "late")}


def test_empty_sides(spark):
    assert run(spark, [], [(1, T0, None)]).count() == 0
    found = run(spark, [(1, 2, T0), (2, 2, None), (3, None, T0)], []).collect()
    assert {(r.record_id, r.orphan_kind) for r in found} == {(1, "missing"), (2, "missing")}
    assert orphan_counts(run(spark, [(1, 2, T0)], [])).collect()[0].n_orphans == 1


def test_session_candidates(spark):
    p = ['{"Original":{"Cards":[{"Contests":[{"Marks":[{"CandidateId":"4"},{"CandidateId":null}]},{"Marks":null}]},{"Contests":null}]},"Modified":{"IsCurrent":false,"Contests":[{"Marks":[{"CandidateId":9}]}]}}', '{"Modified":{"IsCurrent":1,"Contests":[{"Marks":[{"CandidateId":8}]}]}}', None, "{"]
    p += ['{"Original":{"Cards":{"Contests":{"Marks":{"CandidateId":3}}}}}', '{"Original":{"Cards":[{"Contests":[{"Marks":[7, {"CandidateId":6}, null]}]}]}}']  # bare objects; items that are no object
    df = spark.createDataFrame([(i, x, T0) for i, x in enumerate(p)], "session_id bigint, payload string, exported_at timestamp_ntz")
    assert sorted((r.record_id, r.missing_key) for r in session_candidates(df).collect() if r.missing_key is not None) == [(0, 4), (1, 8), (4, 3), (5, 6)]
