"""Differences between two copies of a dataset whose keys may repeat.

Rows that are equal in key and compared fields cancel each other by multiplicity, in one aggregation
whose groups are single contents, so that a hot key is spread. What is left is paired inside each key
by minimum-cost assignment on the number of differing fields. Groups beyond MAX_GROUP rows a side are
paired at the same least cost by a flow over their distinct contents, whose size is linear in these.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlens.scratch import written

#: Largest number of left or right rows of a key that are paired by a dense assignment; beyond, by a flow.
MAX_GROUP = 200


def number_text(value: Column) -> Column:
    """A number as comparable text, exact to the last digit: thousands separators, a plus sign and zeros that say nothing
    go; null, blank and N/A give null; text that is no plain decimal number stays."""
    text = F.btrim(value.cast("string"), F.lit(" \t"))
    plain = F.regexp_replace(text, ",", "")
    number = plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    whole = F.regexp_replace(F.regexp_extract(plain, r"^[+-]?([0-9]*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(plain, r"\.([0-9]*)$", 1), "0+$", "")
    digits = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    out = F.when(plain.rlike("^(?:0|-?[1-9][0-9]*)$"), plain).when(number, F.concat(F.when(plain.startswith("-") & (digits != "0"), "-").otherwise(""), digits)).otherwise(text)
    return F.when((text == "") | (F.upper(text) == "N/A"), None).otherwise(out)


def name_text(value: Column) -> Column:
    """A name without outer blanks and tabs; null stays null."""
    return F.btrim(value.cast("string"), F.lit(" \t"))


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row of a cost matrix with no more rows than columns, its column in a minimum-cost assignment.

    Shortest augmenting paths with potentials, one row at a time, vectorised over the columns.
    """
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, reached, last = start, 0.0, -1
        path_rows = [start]
        while row >= 0:
            slack = reached + cost[row] - row_price[row] - col_price
            better = ~done & (slack < dist - 1e-12)
            dist[better], via[better] = slack[better], last
            nxt = int(np.argmin(np.where(done, np.inf, dist)))
            reached, last = dist[nxt], nxt
            done[nxt] = True
            row = owner[nxt]
            if row >= 0:
                path_rows.append(row)
        visited = done.copy()
        visited[last] = False
        for col in np.flatnonzero(visited):
            row_price[owner[col]] += reached - dist[col]
            col_price[col] -= reached - dist[col]
        row_price[start] += reached
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    out = np.full(n, -1)
    for col in np.flatnonzero(owner >= 0):
        out[owner[col]] = col
    return out


def pair_up(left: list[tuple], right: list[tuple]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs of indices at the least total number of differing fields; then what is left over on each side."""
    a, b = (left, right) if len(left) <= len(right) else (right, left)
    cost = np.array([[sum(x != y for x, y in zip(r, s)) for s in b] for r in a], float).reshape(len(a), len(b))
    to = assign(cost) if len(a) else np.zeros(0, int)
    pairs = [(i, int(j)) if a is left else (int(j), i) for i, j in enumerate(to)]
    used_l, used_r = {i for i, _ in pairs}, {j for _, j in pairs}
    return pairs, [i for i in range(len(left)) if i not in used_l], [j for j in range(len(right)) if j not in used_r]


def pair_counts(left: list[tuple[tuple, int]], right: list[tuple[tuple, int]]) -> list[tuple[int, int, int]]:
    """(i, j, n): n rows of left content i meet n of right content j at the least total number of differing fields;
    j or i is -1 for rows left over on the other side. Contents are distinct and come with how often they occur.

    A minimum-cost flow whose arcs lead from a left content over a shared node (fields and the values that agree
    in them) to a right content and save one for each of these fields, so that arcs grow with contents, not with
    pairs of them. Path lengths are whole numbers from 1 - fields to -1: so many rounds of blocking flows.
    """
    fields = range(len((left or right)[0][0])) if left or right else ()
    shared: dict[tuple, tuple[list[int], list[int]]] = {}
    for side, rows in enumerate((left, right)):
        for i, (row, _) in enumerate(rows):
            for k in range(len(fields), 0, -1):
                for agreed in combinations(fields, k):
                    at = (agreed, tuple(row[f] for f in agreed))
                    if side == 0 or at in shared:
                        shared.setdefault(at, ([], []))[side].append(i)
    hubs = [(len(at[0]), a, b) for at, (a, b) in shared.items() if b]
    first_r, first_hub = 1 + len(left), 1 + len(left) + len(right)
    source, sink = 0, first_hub + len(hubs)
    to, room, cost, out = [], [], [], [[] for _ in range(sink + 1)]

    def arc(u: int, v: int, most: int, price: int) -> None:
        for x, y, r, c in ((u, v, most, price), (v, u, 0, -price)):
            out[x].append(len(to))
            to.append(y), room.append(r), cost.append(c)

    for i, (_, n) in enumerate(left):
        arc(source, 1 + i, n, 0)
    for j, (_, n) in enumerate(right):
        arc(first_r + j, sink, n, 0)
    for h, (saved, a, b) in enumerate(hubs):
        for i in a:
            arc(1 + i, first_hub + h, left[i][1], -saved)
        for j in b:
            arc(first_hub + h, first_r + j, right[j][1], 0)
    # prices that make every first arc cost 0 or more: the least path from the source
    price = [0] * (sink + 1)
    for h, (saved, _, b) in enumerate(hubs):
        price[first_hub + h] = -saved
        for j in b:
            price[first_r + j] = min(price[first_r + j], -saved)
    price[sink] = min(price)
    while True:
        far = [None] * (sink + 1)
        far[source], buckets = 0, {0: [source]}
        while buckets:
            d = min(buckets)
            for u in (queue := buckets.pop(d)):
                if far[u] != d:
                    continue
                for e in out[u]:
                    if room[e] and (far[v := to[e]] is None or far[v] > d + cost[e] + price[u] - price[v]):
                        far[v] = x = d + cost[e] + price[u] - price[v]
                        (queue if x == d else buckets.setdefault(x, [])).append(v)
        if far[sink] is None:
            break
        price = [p + (far[sink] if f is None else min(f, far[sink])) for p, f in zip(price, far)]
        if price[sink] >= 0:
            break
        while True:
            level = [-1] * (sink + 1)
            level[source], queue = 0, [source]
            for u in queue:
                for e in out[u]:
                    v = to[e]
                    if room[e] and level[v] < 0 and cost[e] + price[u] == price[v]:
                        level[v] = level[u] + 1
                        queue.append(v)
            if level[sink] < 0:
                break
            tried, path, u = [0] * (sink + 1), [], source
            while True:
                if u == sink:
                    n = min(room[e] for e in path)
                    for e in path:
                        room[e] -= n
                        room[e ^ 1] += n
                    path, u = [], source
                elif tried[u] < len(out[u]):
                    e = out[u][tried[u]]
                    if room[e] and level[to[e]] == level[u] + 1 and cost[e] + price[u] == price[to[e]]:
                        path.append(e)
                        u = to[e]
                    else:
                        tried[u] += 1
                elif path:
                    u = to[path.pop() ^ 1]
                    tried[u] += 1
                else:
                    break
    free_l, free_r = [n for _, n in left], [n for _, n in right]
    met: dict[tuple[int, int], int] = {}

    def meet(a: list[list[int]], b: list[list[int]]) -> None:
        while a and b:
            n = min(a[-1][1], b[-1][1])
            i, j = a[-1][0], b[-1][0]
            met[i, j] = met.get((i, j), 0) + n
            free_l[i] -= n
            free_r[j] -= n
            for side in (a, b):
                side[-1][1] -= n
                if not side[-1][1]:
                    side.pop()

    for h in range(len(hubs)):
        arcs = [(to[e], room[e if e & 1 else e ^ 1]) for e in out[first_hub + h]]
        meet([[v - 1, n] for v, n in arcs if n and v < first_r], [[v - first_r, n] for v, n in arcs if n and v >= first_r])
    meet([[i, n] for i, n in enumerate(free_l) if n], [[j, n] for j, n in enumerate(free_r) if n])
    return [(i, j, n) for (i, j), n in met.items()] + [(i, -1, n) for i, n in enumerate(free_l) if n] + [(-1, j, n) for j, n in enumerate(free_r) if n]


def diff_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, Column], max_group: int = MAX_GROUP) -> DataFrame:
    """What remains of two copies after equal rows have cancelled, paired inside each key.

    fields: compared fields and the expression that makes each comparable (text; null equals null). Other
    columns do not count. Gives keys, l and r (structs of the fields; one is null where a row has no
    partner), n (how many times), in_left and in_right (rows of the key on each side before cancelling).
    Keys and fields must not be named l, r, n, in_left or in_right.
    Null keys equal each other. Equal copies give an empty result.
    """
    names = list(fields)
    side = lambda df, s: df.select(*keys, *[e.cast("string").alias(c) for c, e in fields.items()], F.lit(int(s == "l")).alias("__a"), F.lit(int(s == "r")).alias("__b"))
    contents = written(side(left, "l").unionByName(side(right, "r")).groupBy(*keys, *names).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b")), "contents")
    rest = F.col("__a") - F.col("__b")
    per_key = contents.groupBy(*keys).agg(
        F.sum("__a").alias("in_left"), F.sum("__b").alias("in_right"),
        F.sum(F.greatest(rest, F.lit(0))).alias("__rest_l"), F.sum(F.greatest(-rest, F.lit(0))).alias("__rest_r"),
        F.count_if(rest > 0).alias("__kinds_l"), F.count_if(rest < 0).alias("__kinds_r"),
    ).where("__rest_l > 0 or __rest_r > 0")
    per_key = written(per_key, "keys")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    left_over = contents.where("__a <> __b").alias("c").join(per_key.alias("k"), same).select(*[f"c.{k}" for k in keys], *[f"c.{c}" for c in names], F.abs(F.col("__a") - F.col("__b")).alias("n"), F.when(F.col("__a") > F.col("__b"), "l").otherwise("r").alias("__side"), "__rest_l", "__rest_r", "__kinds_l", "__kinds_r")
    row = F.struct(*names)
    as_l, as_r = F.when(F.col("__side") == "l", row), F.when(F.col("__side") == "r", row)
    simple = (F.col("__kinds_l") <= 1) & (F.col("__kinds_r") <= 1)
    large = ~simple & (F.greatest("__rest_l", "__rest_r") > max_group)
    single = left_over.where(simple).groupBy(*keys).agg(F.max(as_l).alias("l"), F.max(as_r).alias("r"), F.coalesce(F.max(F.when(F.col("__side") == "l", F.col("n"))), F.lit(0)).alias("nl"), F.coalesce(F.max(F.when(F.col("__side") == "r", F.col("n"))), F.lit(0)).alias("nr"))
    none = F.lit(None).cast(single.schema["l"].dataType)
    parts = F.filter(F.array(
        F.struct(F.col("l"), F.col("r"), F.least("nl", "nr").alias("n")),
        F.struct(F.col("l"), none.alias("r"), (F.col("nl") - F.col("nr")).alias("n")),
        F.struct(none.alias("l"), F.col("r"), (F.col("nr") - F.col("nl")).alias("n")),
    ), lambda p: p["n"] > 0)
    paired = single.select(*keys, F.inline(parts))

    several = left_over.where(~simple).select(*keys, *names, "n", "__side", large.alias("__large"))
    schema = several.select(*keys, as_l.alias("l"), as_r.alias("r"), "n").schema  # both may be null

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {s: sorted(((tuple(None if pd.isna(v) else v for v in r), int(n)) for r, n in zip(g[names].itertuples(index=False), g["n"])), key=repr) for s, g in pdf.groupby("__side")}
        left, right = rows.get("l", []), rows.get("r", [])
        if len(pdf) and pdf["__large"].iloc[0]:
            got = [(left[i][0] if i >= 0 else None, right[j][0] if j >= 0 else None, n) for i, j, n in pair_counts(left, right)]
        else:
            a, b = ([r for r, n in side for _ in range(n)] for side in (left, right))
            pairs, la, lb = pair_up(a, b)
            got = [(a[i], b[j], 1) for i, j in pairs] + [(a[i], None, 1) for i in la] + [(None, b[j], 1) for j in lb]
        d = lambda t: None if t is None else dict(zip(names, t))
        out = pd.DataFrame({"l": [d(x) for x, _, _ in got], "r": [d(y) for _, y, _ in got]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0] if len(pdf) else None)
        out["n"] = [n for _, _, n in got]
        return out[[f.name for f in schema]]

    solved = several.groupBy(*keys).applyInPandas(solve, schema)
    out = paired.unionByName(solved)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    return out.alias("d").join(per_key.select(*keys, "in_left", "in_right").alias("k"), same).select("d.*", "in_left", "in_right")


def field_differences(diff: DataFrame, keys: list[str], fields: list[str], missing_left: str, missing_right: str) -> DataFrame:
    """Distinct keys with what differs: missing_left or missing_right for a key that only the other side has,
    else the name of each field in which a pair differs. Surplus repeats of a key both sides have are no difference."""
    kinds = F.when(F.col("in_left") == 0, F.array(F.lit(missing_left))).when(F.col("in_right") == 0, F.array(F.lit(missing_right))).when(
        F.col("l").isNotNull() & F.col("r").isNotNull(), F.filter(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull()))
    return diff.select(*keys, F.explode(kinds).alias("difference")).distinct()

