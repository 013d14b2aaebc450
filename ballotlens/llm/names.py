"""Free-typed values mapped to the entries of a reference list.

Distinct values are normalised and held against an inverted index of the list's character n-grams; all
entries whose weighted cosine reaches the threshold are candidates. An exact check follows: a candidate is
admissible if its words can be aligned with the value's (equal, mistyped, abbreviated, cut off), numbers and
single letters being equal. The admissible candidate with the highest cosine is accepted if it beats every other
one by the margin. What is accepted for no entry is reported.

The list is taken in blocks of bounded size; each block is held against all distinct values, so neither
the list nor the values need to fit anywhere as a whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlens.scratch import written

#: Least weighted cosine of a candidate, and by how much the best one's must be above the next admissible one's.
THRESHOLD, MARGIN = 0.25, 0.05
#: What a choice of another contest than the value's own loses of its cosine.
OTHER_CONTEST = 0.1
#: Cells of the tables of n-gram counts and of first names, both indexed by hash, whatever the list's size.
CELLS = 1 << 18
#: Entries of the list in one block.
BLOCK = 20_000
#: A side is broadcast only if it was counted and is no larger.
BROADCAST_ROWS = 200_000
N = 3
NUMBER_WORDS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), 1)}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_ROMAN = re.compile(r"(l?x{0,3}|xl)(ix|iv|v?i{0,3})")
#: Words that carry nothing by themselves. Fixed values.
EMPTY_WORDS = {"of", "the", "and", "for", "at", "in", "no", "nr", "number", "num"}
#: Words of entries that typed titles often leave out. Fixed values.
OPTIONAL_WORDS = {"ballot"}
_EMPTY_LETTERS = {"".join(sorted(w)) for w in EMPTY_WORDS}
COURTESY = {"mr", "mrs", "ms", "dr", "hon", "prof", "rev", "sir", "miss", "mx"}
MEASURE_WORDS = {"the", "measure", "issue", "question", "proposition", "amendment", "this", "on"}
_NOISE = re.compile(r"\[[^\]]*\]|\([^()]*\bvote\b[^()]*\)|\(\s*np\s*\)|[-–—]?\s*\bvote\s+for\s+(?:\w+)\s*$|\*+\s*$", re.I)
_CUT = re.compile(r"(\.\.\.|…|~)\s*$")


def fold(text: str) -> str:
    """Without accents, case, underscores and outer or repeated blanks."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower().replace("_", " ")
    return " ".join(text.split())


def _letters(word: str) -> str:
    """A word in which digits stand for letters that look like them, if it has letters beside them."""
    if word.isalpha() or not any(c.isalpha() for c in word):
        return word
    if re.fullmatch(r"0[a-z]+|[a-z]+0", word):
        return word.replace("0", "o")
    if sum(c.isalpha() for c in word) < 2:
        return word
    return word.translate(str.maketrans("0153", "olse")) if not re.fullmatch(r"[0-9]+[a-z]{1,2}", word) else word


def _roman(word: str) -> int:
    values = [{"i": 1, "v": 5, "x": 10, "l": 50}[c] for c in word]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def title_words(text: str) -> tuple[list[str], bool]:
    """The words of a title, numbers as digits, and whether its end was cut off."""
    text = fold(text)
    for _ in range(3):
        text = _NOISE.sub(" ", text).strip()
    cut = bool(_CUT.search(text))
    text = _CUT.sub("", text).replace("&", " and ").replace("'", "")
    out = []
    words = re.findall(r"[^\W_]+", text)
    for i, w in enumerate(words):
        w = _letters(w)
        if w.isdigit():
            w = str(int(w))
        elif w in NUMBER_WORDS and NUMBER_WORDS[w] < 10 and i and words[i - 1] in TENS:
            out[-1] = str(TENS[words[i - 1]] + NUMBER_WORDS[w])
            continue
        elif w in NUMBER_WORDS or w in TENS:
            w = str(NUMBER_WORDS.get(w) or TENS[w])
        elif i and _ROMAN.fullmatch(w) and (len(w) > 1 or words[i - 1] in ("ward", "district", "dist", "no", "issue", "seat", "question") or i == len(words) - 1):
            w = str(_roman(w))
        out.append(w)
    return out, cut


def _edits(a: str, b: str, most: int) -> int:
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _alike(word: str) -> str:
    return word.replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("v", "u").replace("1", "l").replace("0", "o")


@lru_cache(maxsize=1_000_000)
def distance(a: str, b: str, most: int) -> int:
    """Edits between two words (insert, delete, replace, swap neighbours); most + 1 if there are more. Letters that look
    alike (rn and m, vv and w, cl and d, u and v, l and 1) may also be taken for each other, which is one edit in all."""
    d = _edits(a, b, most)
    if d > 1:
        x, y = _alike(a), _alike(b)
        if (x, y) != (a, b):
            d = min(d, max(1, _edits(x, y, most)))
    return min(d, most + 1)


def allowed(word: str) -> int:
    """Edits allowed in a word."""
    return 0 if len(word) <= 2 else 1 if len(word) <= 4 else 2


def shortens(short: str, word: str) -> bool:
    """Whether short is an abbreviation: fewer letters of the word, in order, from its first."""
    if not short or len(short) >= len(word) or short[0] != word[0] or not short.isalpha():
        return False
    if word.startswith(short):
        return True
    if len(short) < 2 or len(short) > 6:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def _empty(word: str) -> bool:
    """Whether a word carries nothing, also with its letters swapped."""
    return "".join(sorted(word)) in _EMPTY_LETTERS


@lru_cache(maxsize=1_000_000)
def word_fits(typed: str, word: str, last: bool) -> bool:
    """Whether a typed word can stand for a word of an entry."""
    if typed == word:
        return True
    if any(c.isdigit() for c in typed + word) or len(word) == 1:
        return False
    if last and word.startswith(typed) or shortens(typed, word):
        return True
    if len(typed) > 2 and distance(typed, word, allowed(word)) <= allowed(word):
        return True
    if 3 <= len(typed) < len(word) and typed[0] == word[0]:  # a mistyped abbreviation
        return len(typed) >= 4 and distance(typed, word[: len(typed)], 1) <= 1 or len(typed) <= 5 and not Counter(typed) - Counter(word)
    return False


def align(typed: list[str], entry: list[str]) -> list[int] | None:
    """For each typed word the place of the entry's word it stands for, all different; None if some word is left over.

    Equal words are taken first, the others along augmenting paths.
    """
    to = [-1] * len(typed)
    owner: dict[int, int] = {}
    for i, w in enumerate(typed):
        j = next((j for j, x in enumerate(entry) if x == w and j not in owner), None)
        if j is not None:
            to[i], owner[j] = j, i

    def find(i: int, seen: set[int]) -> bool:
        for j, x in enumerate(entry):
            if j not in seen and word_fits(typed[i], x, i == len(typed) - 1):
                seen.add(j)
                if j not in owner or find(owner[j], seen):
                    to[i], owner[j] = j, i
                    return True
        return False

    return to if all(to[i] >= 0 or find(i, set()) for i in sorted(range(len(typed)), key=lambda i: -len(typed[i]))) else None


def title_fits(typed: list[str], cut: bool, entry: list[str]) -> bool:
    """Whether a typed title can stand for an entry's.

    Words without meaning may be left over, and the entry's last words where the typed title was cut.
    """
    a, b = [w for w in typed if not _empty(w)], [w for w in entry if not _empty(w)]
    if not a or len(a) > len(b):
        return False
    to = align(a, b)
    if to is None:
        return False
    missing = sorted(j for j in set(range(len(b))) - set(to) if b[j] not in OPTIONAL_WORDS)
    if not missing:
        return True
    # only a title that may have been cut may lack words, and only the last ones
    in_order = all(x < y for x, y in zip(to[:-1], to[1:]))
    ends_cut = cut or in_order or (a[-1] != b[to[-1]] and b[to[-1]].startswith(a[-1]))
    return ends_cut and len(a) >= 2 and missing == list(range(len(b) - len(missing), len(b))) and to[-1] == len(b) - len(missing) - 1


@dataclass(frozen=True)
class Person:
    first: str
    middle: str
    last: str


def person(name: str) -> Person | None:
    words = re.findall(r"[^\W_]+", fold(name).replace("'", ""))
    if len(words) < 2:
        return None
    return Person(words[0], words[1] if len(words) == 3 and len(words[1]) == 1 else "", words[-1])


def choice_words(text: str) -> list[str]:
    """The words of a typed choice: without courtesy titles, nicknames in quotes and parts in brackets; of a ticket, its first name."""
    text = fold(text)
    text = re.sub(r"\([^()]*\)|\[[^\]]*\]", " ", text)
    text = re.sub(r"[\"“”«»][^\"“”«»]*[\"“”«»]", " ", text)
    return [w for w in (_letters(x) for x in re.findall(r"[^\W_]+", text.replace("'", ""))) if w not in COURTESY]


def cell_of(text: str) -> int:
    """The cell of a table of CELLS that stands for a text."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % CELLS


def person_fits(words: list[str], entry: Person, is_first: Callable[[str], bool]) -> tuple[bool, bool]:
    """Whether typed words can stand for a person, and whether with the first name written out.

    is_first: whether a word is a first name of the list; a typed one that is stands for no other first name.
    """
    whole = False
    for i, w in enumerate(words):
        most = 1 if len(entry.last) <= 5 else 2 if len(entry.last) <= 8 else 3
        if len(w) <= 2 or distance(w, entry.last, most) > most:
            continue
        rest = words[:i] + words[i + 1 :]
        long, short = [x for x in rest if len(x) > 1], [x for x in rest if len(x) == 1]
        if len(long) > 1 or len(short) > 2:
            continue
        if long:
            same = long[0] == entry.first
            if (same or distance(long[0], entry.first, 2) <= 2 and not is_first(long[0])) and not (short and entry.middle and short[0] != entry.middle):
                return True, True
        elif not short or short[0] == entry.first[0] and (len(short) == 1 or not entry.middle or short[1] == entry.middle):
            whole = True
    return whole, False


def grams(words: list[str]) -> Counter:
    out: Counter = Counter()
    for w in words:
        padded = f" {w} "
        for i in range(max(1, len(padded) - N + 1)):
            out[padded[i : i + N]] += 1
    return out


class Index:
    """An inverted index of the n-grams of one block of entries.

    weights: the weight of each n-gram by its cell; firsts: whether a cell holds a first name of the list.
    """

    def __init__(self, entries: list[tuple[int, str, str, int | None]], weights: np.ndarray, firsts: np.ndarray):
        self.entries, self.weights, self.firsts = entries, weights, firsts
        self.words = [title_words(n)[0] if kind == "contest" else choice_words(n) for _, kind, n, _ in entries]
        self.people = [None if kind == "contest" or "/" in n else person(n) for _, kind, n, _ in entries]
        self.by_kind = {}
        for kind in ("contest", "choice"):
            lists = defaultdict(list)
            for i, (e, w) in enumerate(zip(entries, self.words)):
                if e[1] == kind:
                    for x, v in self.vector(w).items():
                        lists[x].append((i, v))
            self.by_kind[kind] = {x: (np.array([i for i, _ in p]), np.array([v for _, v in p])) for x, p in lists.items()}

    def vector(self, words: list[str]) -> dict[str, float]:
        """The weighted n-grams of words, of length 1."""
        g = {x: c * float(self.weights[cell_of(x)]) for x, c in grams(words).items()}
        norm = sum(v * v for v in g.values()) ** 0.5 or 1.0
        return {x: v / norm for x, v in g.items()}

    def is_first(self, word: str) -> bool:
        return bool(self.firsts[cell_of(word)])

    def candidates(self, kind: str, words: list[str]) -> list[tuple[int, float]]:
        """All entries of the kind whose weighted cosine reaches the threshold, the highest first."""
        hit = [(self.by_kind[kind][x], v) for x, v in self.vector(words).items() if x in self.by_kind[kind]]
        if not hit:
            return []
        cos = np.bincount(np.concatenate([p[0] for p, _ in hit]), np.concatenate([p[1] * v for p, v in hit]), len(self.entries))
        at = np.flatnonzero(cos >= THRESHOLD)
        return [(int(i), float(cos[i])) for i in at[np.argsort(-cos[at], kind="stable")]]

    def match(self, kind: str, value: str, context: int | None, margin: float = MARGIN) -> list[tuple[int, float]]:
        """(canon_id, cosine) of the admissible entry with the highest cosine, and of every other one within the margin of it.

        A choice of another contest than the context must be written out and loses OTHER_CONTEST of its cosine.
        """
        parts = [p for p in re.split(r"\s+/\s+|/", value) if p.strip()]
        (words, cut), name = title_words(value) if kind == "contest" else (choice_words(value), False), choice_words(parts[0]) if parts else []
        found = []
        for i, cos in self.candidates(kind, words):
            cid, _, _, contest = self.entries[i]
            foreign = kind == "choice" and context is not None and contest is not None and contest != context
            found.append((cos - OTHER_CONTEST * foreign, cid, i, foreign))
        out: list[tuple[int, float]] = []
        for cos, cid, i, foreign in sorted(found, key=lambda f: (-f[0], f[1])):
            if out and cos < out[0][1] - margin:
                break
            if self.admissible(kind, words, cut, name, i, foreign):
                out.append((cid, cos))
        return out

    def admissible(self, kind: str, words: list[str], cut: bool, name: list[str], i: int, foreign: bool) -> bool:
        """The exact check of one candidate."""
        if kind == "contest":
            return title_fits(words, cut, self.words[i])
        if self.people[i] is None:
            left = [w for w in words if w not in MEASURE_WORDS]
            return bool(left) and len(left) <= len(self.words[i]) and all(any(distance(w, o, 1) <= (1 if len(w) > 2 else 0) for o in self.words[i]) for w in left)
        fits, full = person_fits(name, self.people[i], self.is_first)
        return fits and (full or not foreign)


def map_values(values: DataFrame, canon: DataFrame, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """value, name_kind, context, canon_id (0 if none) and cosine, of each distinct value.

    values: value, name_kind ("contest" or "choice") and context (canon_id of the contest, or null). canon:
    canon_id, name_kind, canonical_name, contest_canon_id; names that are null are no entries. Null and
    empty values stand for nothing. Repeated rows give one row; ties between entries give 0.
    """
    values = written(values.select("value", "name_kind", F.col("context").cast("int").alias("context")).distinct(), "values")
    canon = canon.select("canon_id", "name_kind", "canonical_name", "contest_canon_id").where("canonical_name is not null").distinct()
    blocks = max(1, -(-canon.count() // block))
    weights, firsts = _weights(canon, blocks)
    found = None
    for b in range(blocks):
        rows = [tuple(r) for r in canon.where(F.pmod(F.xxhash64("canon_id"), F.lit(blocks)) == b).collect()]  # one bounded block
        part = _match(values, Index(sorted(rows, key=lambda r: (r[0], r[1], r[2])), weights, firsts), margin)
        found = part if found is None else found.unionAll(part)
    keys = ["value", "name_kind", "context"]
    # the best and the next other entry of each value, by aggregates that combine before the shuffle
    found = written(found, "candidates")
    best = found.groupBy(*keys).agg(F.max(F.struct("cosine", -F.col("canon_id"))).alias("best"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    joined = found.alias("f").join(best.alias("b"), same("f", "b")).select(*[f"f.{k}" for k in keys], "f.cosine", "f.canon_id", F.col("b.best.cosine").alias("top"), (-F.col("b.best.col2")).alias("top_id"))
    rival = joined.groupBy(*keys).agg(F.first("top_id").alias("top_id"), F.first("top").alias("top"), F.max(F.when(F.col("canon_id") != F.col("top_id"), F.col("cosine"))).alias("next"))
    accepted = rival.select(*keys, F.when(F.col("next").isNull() | (F.col("top") - F.col("next") >= margin), F.col("top_id")).otherwise(0).alias("canon_id"), F.col("top").alias("cosine"))
    a, v = accepted.alias("a"), values.alias("v")
    return v.join(a, same("a", "v"), "left").select(*[f"v.{k}" for k in keys], F.coalesce("a.canon_id", F.lit(0)).alias("canon_id"), "a.cosine")


def _weights(canon: DataFrame, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies of all n-grams by their cell, and the cells of all first names, over the whole list,
    block by block. Both tables have a fixed size; n-grams that share a cell share their count."""
    counts, firsts = np.zeros(CELLS), np.zeros(CELLS, bool)
    total = 0
    for b in range(blocks):
        for r in canon.where(F.pmod(F.xxhash64("canon_id"), F.lit(blocks)) == b).collect():
            total += 1
            words = title_words(r.canonical_name)[0] if r.name_kind == "contest" else choice_words(r.canonical_name)
            for g in grams(words):
                counts[cell_of(g)] += 1
            if r.name_kind == "choice" and (p := person(r.canonical_name)):
                firsts[cell_of(p.first)] = True
    # n-grams that no entry has are mostly typing errors and weigh little
    return np.where(counts > 0, np.log((total + 1) / (counts + 0.5)).clip(0.01), 1.0), firsts


def _match(values: DataFrame, index: Index, margin: float) -> DataFrame:
    sent = values.sparkSession.sparkContext.broadcast(index)  # bounded by the block size and CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            at, ids, cosines = [], [], []
            for i, (value, kind, context) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                if value and value.strip():
                    for cid, cos in index.match(kind, value, context, margin):
                        at.append(i)
                        ids.append(cid)
                        cosines.append(cos)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in batch.columns], pa.array(ids, pa.int32()), pa.array(cosines, pa.float64())], names=["value", "name_kind", "context", "canon_id", "cosine"])

    # values are short and each takes long, so they are spread over all cores
    parts = max(values.sparkSession.sparkContext.defaultParallelism * 2, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return values.repartition(parts, "value").mapInArrow(run, "value string, name_kind string, context int, canon_id int, cosine double")


def canonicalise(titles: DataFrame, choices: DataFrame, canon: DataFrame) -> DataFrame:
    """source_table, record_id, field_name, value and canon_id of each non-null value that is not itself a canonical name.

    titles: source_table, record_id, field_name, value. choices: the same and title, the contest title beside
    the choice, which tells the contest for names that are not written out.
    """
    exact = canon.groupBy(F.col("canonical_name").alias("value"), "name_kind").agg(F.min("canon_id").alias("exact_id"))
    names = exact.select("value").distinct()
    names = F.broadcast(names) if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else names
    open_titles = titles.select(F.col("value")).unionAll(choices.select(F.col("title"))).where("value is not null").distinct().join(names, "value", "left_anti")
    mapped = written(map_values(open_titles.select("value", F.lit("contest").alias("name_kind"), F.lit(None).cast("int").alias("context")), canon).select("value", "canon_id"), "titles")
    known = mapped.unionAll(exact.where("name_kind = 'contest'").select("value", F.col("exact_id").alias("canon_id")))
    some = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
    out_titles = titles.where("value is not null").join(some(mapped), "value").select("source_table", "record_id", "field_name", "value", "canon_id")
    contest = known.where("canon_id <> 0").select(F.col("value").alias("title"), F.col("canon_id").alias("context"))
    rows = choices.where("value is not null").join(names, "value", "left_anti").join(some(contest), "title", "left")
    picked = written(map_values(rows.select("value", F.lit("choice").alias("name_kind"), "context"), canon).select("value", "context", "canon_id"), "choices")
    p = some(picked).alias("p")
    out_choices = rows.alias("r").join(p, (F.col("r.value") == F.col("p.value")) & F.col("r.context").eqNullSafe(F.col("p.context"))).select("r.source_table", "r.record_id", "r.field_name", "r.value", "p.canon_id")
    return out_titles.unionAll(out_choices).distinct()
