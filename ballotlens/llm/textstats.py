"""Statistics of texts, and by them whether a text is prose, a list, a table or junk.

One vectorised pass over each batch of texts gives the statistics of every document. A Gaussian mixture
is then fitted to the standardized statistics of all documents by expectation-maximization: each step is
one distributed pass that returns sums of fixed size. Components are started from and afterwards named
after a few inspected examples. No statistic says by itself what a text is; the mixture decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlens.llm.words import code_points, is_word_char, kept, mix, pieces, powers
from ballotlens.scratch import written

KINDS = ("prose", "list", "table", "junk")
#: Frequent words of English, Spanish, French and German. Fixed values.
COMMON = (
    "the of and to in is that for on be as with by at or an it its from this was were are not had have has been they he she we you but if who which what when then there all no so only one "
    "de la el los las que en un una se por con para del al lo su le les des et du est une dans qui sur pas ne ce au aux avant "
    "der die das und ist von den dem ein eine zu auf nicht mit im noch nur war waren wurden erst ob"
)
#: The statistics in their order. Shares of characters count visible ones.
NAMES = (
    "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "mean_line_length", "repeated_words",
    "word_spread", "number_words", "mixed_words", "distinct_words", "closed_share", "marked_share", "running_share", "plain_share", "line_length", "line_words", "delimiters", "blanks",
)
COUNTS = ("n_chars", "n_words", "n_lines")
LETTER, DIGIT, SPACE, NEWLINE, POINT, OTHER = range(6)
_ENDS = '.!?:;…"»”)'
_BULLETS = "-*•–·◦‣▪+"
_NEAR = ".,;:!?'\"()-’‘“”«»¿¡–—…"


def _classes() -> np.ndarray:
    out = np.full(0x10000, OTHER, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        out[i] = LETTER if c.isalpha() else DIGIT if c.isnumeric() else NEWLINE if c == "\n" else SPACE if c.isspace() else POINT if c in _NEAR else OTHER
    return out


def _lower() -> np.ndarray:
    return np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x10000)], np.uint32)


def _common() -> np.ndarray:
    return np.sort(np.array([_hash(w) for w in set(COMMON.split())], np.uint64))


def _hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(codes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * down[start])


def _hash(word: str) -> np.uint64:
    return _hashes(code_points(word), np.array([0]), np.array([len(word)]))[0]


def statistics(texts: list[str]) -> np.ndarray:
    """One row for each text, with the columns NAMES. Texts without visible characters have all zeros but n_chars and n_lines.

    word_spread: mean square of word lengths. number_words, mixed_words: words of digits only, and of digits and letters.
    repeated_words: words that equal one of the six before them. Shares of visible characters: on lines that end in
    punctuation (closed), begin with a bullet or number (marked), go on in small letters on the next line (running), or
    hold no frequent word (plain). line_length, line_words: of the line a character is on, on average. delimiters: bars,
    tabs, semicolons, equal signs, gaps and commas without a blank, per visible character. blanks: share of all characters.
    """
    classes, low, common = kept("classes", _classes), kept("lower", _lower), kept("common", _common)
    codes = code_points("\n".join(texts) + "\n")
    docs, size = len(texts), np.array([len(t) for t in texts])
    doc_end = np.cumsum(size + 1) - 1
    cls = classes[np.minimum(codes, 0xFFFF)]
    newline = np.flatnonzero(codes == 10)
    begin, end = np.concatenate(([0], newline[:-1] + 1)), newline
    line_doc = np.searchsorted(doc_end, begin, "left")

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.view(np.uint8), begin, dtype=np.int32) - mask[end]  # a line feed belongs to no line

    space = cls == SPACE
    visible_at = np.flatnonzero(~space & (cls != NEWLINE))
    pad = np.append(visible_at, len(codes) - 1)
    a, b = np.searchsorted(visible_at, begin), np.searchsorted(visible_at, end)
    visible, length = b - a, end - begin
    blank = visible == 0
    first, last = pad[a], np.where(blank, begin, pad[np.maximum(b - 1, 0)])
    at = lambda i: codes[np.minimum(i, len(codes) - 1)]
    kind_at = lambda i: cls[np.minimum(i, len(codes) - 1)]

    word = is_word_char(codes)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    w_start, w_end = edge[0::2], edge[1::2]
    lower = codes.copy()
    inside = codes <= 0xFFFF
    lower[inside] = low[codes[inside]]
    h = _hashes(lower, w_start, w_end)
    w_first = np.append(np.searchsorted(w_start, begin), len(w_start))
    line_words, w_size = np.diff(w_first), w_end - w_start
    w_line = np.repeat(np.arange(len(begin)), line_words)
    w_doc = line_doc[w_line]
    is_common = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
    repeats = np.zeros(len(h), bool)
    for lag in range(1, 7):
        repeats[lag:] |= (h[lag:] == h[:-lag]) & (w_doc[lag:] == w_doc[:-lag])
    digit_sum = np.concatenate(([0], np.cumsum(cls == DIGIT)))
    w_digits = digit_sum[w_end] - digit_sum[w_start]
    once = np.unique(h + w_doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)[1]  # a place of each word of each text
    line_common = np.bincount(w_line, is_common, len(begin))

    # markers at the line's beginning
    c0, c2 = at(first), at(first + 2)
    bullet = np.isin(c0, code_points(_BULLETS)) & (kind_at(first + 1) == SPACE)
    d0, d1, d2 = (kind_at(first + i) == DIGIT for i in range(3))
    closes = lambda i: np.isin(at(first + i), code_points(".)")) & (kind_at(first + i + 1) == SPACE)
    number = (d0 & closes(1)) | (d0 & d1 & closes(2)) | (d0 & d1 & d2 & closes(3)) | ((kind_at(first) == LETTER) & closes(1) & (at(first + 1) == ord(")")))
    paren = (c0 == ord("(")) & ((c2 == ord(")")) | (at(first + 3) == ord(")"))) & (kind_at(first + 1) <= DIGIT)
    marked = ~blank & (bullet | number | paren | ((c0 == ord("[")) & (c2 == ord("]"))))

    cut = (codes == ord("|")) | (codes == 9) | (codes == ord(";")) | (codes == ord("="))
    cut[:-1] |= (codes[:-1] == ord(",")) & (cls[1:] != SPACE)
    gap = np.zeros(len(codes), bool)
    gap[2:] = space[:-2] & space[1:-1] & ~space[2:] & (cls[2:] != NEWLINE)
    cuts = per_line(cut) + np.maximum(per_line(gap) - (first - begin >= 2), 0)  # an indent is no gap
    ends = ~blank & np.isin(at(last), code_points(_ENDS))
    small_start = ~blank & (kind_at(first) == LETTER) & (low[np.minimum(c0, 0xFFFF)] == c0)
    runs = np.append(small_start[1:] & (line_doc[1:] == line_doc[:-1]), False)

    add = lambda x: np.bincount(line_doc, x, docs)
    of_words = lambda x: np.bincount(w_doc, x, docs)
    shown, lines, n_words = add(visible), add(~blank), of_words(np.ones(len(h)))
    v, n = np.maximum(shown, 1), np.maximum(n_words, 1)
    part = lambda x: add(np.where(x, visible, 0)) / v
    others, digits = per_line(cls == OTHER), per_line(cls == DIGIT)
    return np.column_stack((
        size, n_words, add(np.ones(len(begin))) * (size > 0), of_words(w_size) / n, add(others) / v, add(digits) / v, add(ends) / np.maximum(lines, 1), of_words(is_common) / n, shown / np.maximum(lines, 1), of_words(repeats) / n,
        of_words(w_size.astype(float) ** 2) / n, of_words(w_digits == w_size) / n, of_words((w_digits > 0) & (w_digits < w_size)) / n, np.bincount(w_doc[once], minlength=docs) / n,
        part(ends), part(marked), part(runs), part(line_common == 0), add(visible * length.astype(float)) / v, add(visible * line_words.astype(float)) / v, add(cuts) / v, add(per_line(space)) / np.maximum(add(length), 1),
    ))


STATS = "doc_id bigint, " + ", ".join(f"{c} {'bigint' if c in COUNTS else 'double'}" for c in NAMES)


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics NAMES of every text, over the whole text. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in pieces(texts):
                piece = batch.slice(begin, end - begin)
                s = statistics(texts[begin:end])
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(s[:, i].astype(np.int64) if c in COUNTS else s[:, i]) for i, c in enumerate(NAMES)]], names=["doc_id", *NAMES])

    return documents.select("doc_id", "text").mapInArrow(run, STATS)


# inspected examples, some of each kind, written for this purpose; their groups start the components
_SENTENCES = ("The clerk opened the box and counted the ballots with two observers from the parish.", "Nobody had told them that the seal was broken, so the count began again at noon.", "It was the second time this week that a page had been left on the scanner.", "If the margin is small, the board will read more cards before it signs the record.", "They said that all of the totals would be posted on the door of the town hall.")
_THINGS = ("ink pads", "sealed boxes", "paper rolls", "spare keys", "tally sheets", "the poll books", "name tags", "red folders", "a long table", "the old scanner", "lamps", "blue pens")
_PLACES = ("Northfield", "Easton", "Milbrook", "Harrow", "Stanton", "Upwell", "Cranford", "Dunmore")


def _wrap(text: str, width: int) -> str:
    out, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def examples() -> list[tuple[str, str, list[str]]]:
    """Groups of inspected examples: kind, name, texts."""
    rng = np.random.default_rng(11)
    pick = lambda xs, n: [xs[i] for i in rng.integers(0, len(xs), n)]
    num = lambda: f"{int(rng.integers(100, 9999)):,}"
    raw = lambda: str(int(rng.integers(100, 9999)))
    letters = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    prose = [" ".join(pick(_SENTENCES, n)) for n in (4, 8, 12, 16)]
    rows = lambda sep, f, n=12: "\n".join(sep.join([p, *[f() for _ in range(4)]]) for p in pick(_PLACES, n))
    fixed = lambda n=12: "\n".join(f"{p:<24}" + "".join(f"{num():>9}" for _ in range(4)) for p in pick(_PLACES, n))
    keyed = lambda n=12: "\n".join(f"Place={p}; Votes={num()}; Cards={num()}; Over={num()}" for p in pick(_PLACES, n))
    small = "abcdefghijklmnopqrstuvwxyz"
    gibberish = lambda: " ".join(letters(small, int(k)) for k in rng.integers(2, 12, 90))
    return [
        ("prose", "long lines", prose), ("prose", "paragraphs", ["\n\n".join(p.split(". ")[0] + ". " + p for p in prose[:2])] * 2),
        ("prose", "wrapped", [_wrap(p, w) for p in prose for w in (50, 64, 78)]), ("prose", "without marks", [p.lower().replace(".", "").replace(",", "") for p in prose]),
        ("prose", "some structure", [p + "\n" + "\n".join("- " + t for t in pick(_THINGS, 6)) for p in prose[1:]] + [p + "\n" + rows(",", raw, 4) for p in prose[2:]]),
        ("list", "bullets", ["\n".join(m + t for t in pick(_THINGS, n)) for m, n in (("- ", 9), ("* ", 20), ("• ", 30), ("[x] ", 15))]),
        ("list", "numbers", ["\n".join(f"{i + 1}. {t}" for i, t in enumerate(pick(_THINGS, n))) for n in (9, 20, 30)]),
        ("list", "bare", ["\n".join(pick(_THINGS, n)) for n in (10, 15, 25)] + ["On the list are:\n" + "\n".join(pick(_THINGS, 12))]),
        ("list", "names", ["\n".join(pick(_PLACES, n)) for n in (10, 20, 30)] + ["Places on the route:\n" + "\n".join(p + q.lower() for p, q in zip(pick(_PLACES, n), pick(_PLACES, n))) for n in (12, 20)]),
        ("table", "commas", [rows(",", raw) for _ in range(3)]), ("table", "bars", [rows(" | ", num) for _ in range(3)]), ("table", "tabs", [rows("\t", num) for _ in range(3)]),
        ("table", "columns", [fixed() for _ in range(3)]), ("table", "keys", [keyed() for _ in range(3)]),
        ("junk", "symbols", [letters("~#*!?$x0a- ", 900) for _ in range(3)]), ("junk", "wrong letters", [letters("âÃ€œ™¢©¿½ï nioeuaƒ†", 900) for _ in range(3)]),
        ("junk", "markup", ["".join(pick(["<td>", "</tr>", "<br/>", "&nbsp;", "&#512;", "&#77;", "&#901;"], 200)) for _ in range(3)]),
        ("junk", "random letters", [gibberish() for _ in range(3)]), ("junk", "encoded", ["\n".join(letters(small + small.upper() + "0123456789+/", 76) for _ in range(12)) for _ in range(3)]),
        ("junk", "dumps", ["\n".join(" ".join([letters("0123456789abcdef", 8), *[letters("0123456789abcdef", 2) for _ in range(12)], letters(".x#~", 8)]) for _ in range(14)) for _ in range(3)]),
        ("junk", "repeats", ["please hold " * 80, "\n".join(["no data"] * 60), "end of page | " * 50]),
    ]


#: Statistics that enter the mixture by their logarithms: sizes, whatever their scale.
SIZES = tuple(NAMES.index(c) for c in ("n_words", "n_lines", "word_spread", "mean_line_length", "line_length", "line_words"))


def vectors(stats: np.ndarray) -> np.ndarray:
    """The statistics as the mixture sees them: all but n_chars, sizes and the delimiters (in per cent) by their logarithms."""
    s = stats.astype(float)
    s[:, SIZES] = np.log1p(s[:, SIZES])
    s[:, NAMES.index("delimiters")] = np.log1p(100 * s[:, NAMES.index("delimiters")])
    return s[:, 1:]


class Mixture:
    """A Gaussian mixture with full covariances."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, means: np.ndarray, covs: np.ndarray, shares: np.ndarray):
        self.shift, self.scale, self.means, self.covs, self.shares = shift, scale, means, covs, shares

    def points(self, stats: np.ndarray) -> np.ndarray:
        return (vectors(stats) - self.shift) / self.scale

    def densities(self, x: np.ndarray) -> np.ndarray:
        """log(share * density) of each point under each component."""
        k, d = self.means.shape
        roots = np.linalg.inv(np.linalg.cholesky(self.covs))  # lower triangles
        z = (x @ roots.reshape(k * d, d).T).reshape(len(x), k, d) - np.einsum("kij,kj->ki", roots, self.means)
        return np.log(self.shares + 1e-300) + np.log(np.einsum("kii->ki", roots)).sum(axis=1) - 0.5 * np.einsum("nki,nki->nk", z, z)

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        d = self.densities(x)
        top = d.max(axis=1, keepdims=True)
        p = np.exp(d - top)
        total = p.sum(axis=1, keepdims=True)
        return p / total, float((top + np.log(total)).sum())

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sufficient statistics of an expectation step: per component weight, sums and products; then the log likelihood."""
        r, fit = self.responsibilities(x)
        d = x.shape[1]
        i, j = np.triu_indices(d)
        products = np.zeros((r.shape[1], d, d))
        products[:, i, j] = products[:, j, i] = r.T @ (x[:, i] * x[:, j])
        return np.concatenate([r.sum(axis=0), (r.T @ x).ravel(), products.ravel(), [fit]])

    def step(self, sums: np.ndarray, floor: float) -> tuple[Mixture, float]:
        k, d = self.means.shape
        w = np.maximum(sums[:k], 1e-9)
        means = sums[k : k + k * d].reshape(k, d) / w[:, None]
        covs = sums[k + k * d : -1].reshape(k, d, d) / w[:, None, None] - means[:, :, None] * means[:, None, :] + floor * np.eye(d)
        return Mixture(self.shift, self.scale, means, covs, w / w.sum()), float(sums[-1])


def fit_mixture(stats: DataFrame, steps: int = 60, floor: float = 0.1, tolerance: float = 1e-4) -> tuple[Mixture, list[str], dict]:
    """The mixture fitted to the standardized statistics of all documents, the kind of each component, and how the fit went
    (steps, and whether the log likelihood had come to rest within the tolerance).

    Each step sums over all partitions; the examples take part with weight 1 each. A component is named
    after the kind whose examples are most likely under it, else (no example is) after the example nearest to its mean.
    floor is added to the variances, in units of the standardized statistics.
    """
    groups = examples()
    seeds = [statistics(texts) for _, _, texts in groups]
    every = np.concatenate(seeds)
    columns = list(NAMES)

    def total(f, width: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros(width)
            for b in batches:
                if b.num_rows:
                    s += f(np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]))
            yield pa.RecordBatch.from_arrays([pa.array([s.tolist()], pa.list_(pa.float64()))], names=["s"])

        # as many rows as partitions, each of fixed width, summed before they reach the driver
        one = stats.select(*columns).mapInArrow(run, "s array<double>")
        got = one.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for r in got:
            out[r.i] = r.v
        return out

    dims, k = vectors(every).shape[1], len(groups)
    moments = lambda s: np.concatenate([[len(s)], vectors(s).sum(axis=0), (vectors(s) ** 2).sum(axis=0)])
    m = total(moments, 1 + 2 * dims) + moments(every)
    shift = m[1 : dims + 1] / m[0]
    scale = np.sqrt(np.maximum(m[dims + 1 :] / m[0] - shift**2, 1e-4))
    start = Mixture(shift, scale, np.zeros((1, dims)), np.eye(dims)[None], np.ones(1))
    means = np.array([start.points(s).mean(axis=0) for s in seeds])
    model = Mixture(shift, scale, means, np.repeat(np.eye(dims)[None] * 0.5, k, axis=0), np.full(k, 1 / k))
    width = k + k * dims + k * dims * dims + 1
    before, rested, n = -np.inf, False, 0
    while n < steps and not rested:
        n, now = n + 1, model
        s = total(lambda x, now=now: now.sums(now.points(x)), width) + now.sums(now.points(every))
        model, fit = now.step(s, floor)
        rested, before = fit - before < tolerance * abs(fit), fit
    names = []
    for i in range(k):
        votes = {kind: 0.0 for kind in KINDS}
        for (kind, _, _), seed in zip(groups, seeds):
            votes[kind] += float(model.responsibilities(model.points(seed))[0][:, i].mean())
        best = max(votes, key=lambda x: votes[x])
        if votes[best] < 0.05:
            gaps = [np.abs(model.points(seed) - model.means[i]).sum(axis=1).min() for seed in seeds]
            best = groups[int(np.argmin(gaps))][0]
        names.append(best)
    return model, names, {"steps": n, "rested": rested}


def classify(documents: DataFrame) -> DataFrame:
    """doc_id, doc_kind, component, certainty and the statistics of every document.

    doc_kind is the kind with the largest posterior probability (its certainty), summed over the mixture's components.
    Texts without any word or symbol are junk. Row copies are kept.
    """
    stats = written(document_statistics(documents), "statistics")
    model, names, _ = fit_mixture(stats)
    kind_of = np.array([KINDS.index(n) for n in names])
    symbols = NAMES.index("symbol_ratio")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(NAMES))])
            p, _ = model.responsibilities(model.points(x))
            by = np.column_stack([p[:, kind_of == i].sum(axis=1) for i in range(len(KINDS))])
            kind = np.where((x[:, 1] == 0) & (x[:, symbols] == 0), KINDS.index("junk"), by.argmax(axis=1))
            sure = np.minimum(by[np.arange(len(kind)), kind], 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([KINDS[i] for i in kind]), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(sure), *b.columns[1:]], names=["doc_id", "doc_kind", "component", "certainty", *NAMES])

    return stats.select("doc_id", *NAMES).mapInArrow(run, "doc_id bigint, doc_kind string, component int, certainty double, " + STATS.split(", ", 1)[1])


def components(classified: DataFrame) -> DataFrame:
    """component, doc_kind, n_documents, certainty (the mean) and clearest (the doc_id with the highest certainty, for inspection)."""
    surest = F.max(F.struct("certainty", (-F.col("doc_id")).alias("d")))
    out = classified.groupBy("component", "doc_kind").agg(F.count("*").alias("n_documents"), F.avg("certainty").alias("certainty"), surest.alias("s"))
    return out.select("component", "doc_kind", "n_documents", "certainty", (-F.col("s.d")).alias("clearest"))
