"""Rows that fail to parse, set apart with their reason while all others are loaded.

Blocks of lines with the same header go through vectorised checks, and those that pass are parsed in bulk by the
columnar CSV reader. A block that the reader refuses is bisected until the bad lines stand among a few
others. Only these and the lines that a check has found are then diagnosed, one by one, by the strict reader.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlens.functions.csvline import cells, strip_end

#: Lines in the largest block that is parsed at once.
BLOCK = 4096
#: A failing block of at most so many lines is not halved further: each of its lines is diagnosed.
LEAF = 8
#: Columns every line must fill, under the header's names.
NUMBER, IMPRINT, PARTS, STYLE = "CvrNumber", "ImprintedId", ("TabulatorNum", "BatchId", "RecordId"), "BallotType"
BLANKS = " \t"
# a cell is bare text without quotes, a quoted cell or ="quoted"; anything else is left to the strict reader
WELL_FORMED = r'^(?:[^",]*|=?"(?:[^"]|"")*")(?:,(?:[^",]*|=?"(?:[^"]|"")*"))*$'
#: The side of headers is broadcast only if it was counted and is no larger.
BROADCAST_ROWS = 100_000
LOADED = "line_id bigint, file_name string, line_no int, cvr_number bigint, cvr_text string, tabulator_num string, batch_id string, record_id string, imprinted_id string, ballot_type string, precinct_portion string, cells array<string>, reason string"


def diagnose(line: str | None, header: list[str]) -> tuple[str, list[str] | None]:
    """The first reason that holds for a line ("" if it is good) and its cells.

    quoting, then columns, then value. A null line has no cells and counts as columns.
    """
    if line is None:
        return "columns", None
    found = cells(strip_end(line))
    if found is None:
        return "quoting", None
    if len(found) != len(header):
        return "columns", found
    row = {h.strip(BLANKS): c.strip(BLANKS) for h, c in zip(header, found)}
    number = row.get(NUMBER, "")
    good = re.fullmatch("[0-9]+", number) and int(number) >= 1 and row.get(IMPRINT) == "-".join(row.get(p, "") for p in PARTS) and row.get(STYLE, "") != ""
    return ("" if good else "value"), found


def _suspects(ends: pa.Array, n: int) -> np.ndarray:
    """Which lines are not plainly well-formed with n cells, as far as vectorised checks can tell."""
    quoted = pc.match_substring(ends, '"')
    cells_off = pc.and_(pc.invert(quoted), pc.not_equal(pc.count_substring(ends, ","), n - 1))
    # ="x" becomes "x" below; where such a start could also lie inside a quoted cell, the strict reader decides
    odd = pc.or_(pc.invert(pc.match_substring_regex(ends, WELL_FORMED)), pc.match_substring_regex(ends, '[\\r\\n]|=""'))
    return pc.fill_null(pc.or_(cells_off, odd), True).to_numpy(zero_copy_only=False)


def _read(plain: pa.Array, n: int) -> pa.Table | None:
    """The columns of a block of lines, or None if the columnar reader refuses any of them."""
    names = [str(i) for i in range(n)]
    try:
        text = "\n".join(plain.to_pylist()).encode() + b"\n"
        block = pacsv.read_csv(
            io.BytesIO(text), pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(text) + 1), pacsv.ParseOptions(ignore_empty_lines=False),
            pacsv.ConvertOptions(column_types={c: pa.string() for c in names}, strings_can_be_null=False),
        )
    except (pa.ArrowInvalid, UnicodeEncodeError):
        return None
    return block if block.num_rows == len(plain) else None


def _bisect(at: np.ndarray, plain: pa.Array, n: int) -> Iterator[tuple[np.ndarray, pa.Table | None]]:
    """Positions with their parsed block, or with None where a few lines are left that must be read strictly."""
    if len(at):
        block = _read(plain, n)
        if block is not None or len(at) <= LEAF:
            yield at, block
        else:
            half = len(at) // 2
            yield from _bisect(at[:half], plain[:half], n)
            yield from _bisect(at[half:], plain[half:], n)


def _good(block: pa.Table, header: list[str]) -> np.ndarray | None:
    """Which rows of a block have good values; None if the header lacks a column that must be filled."""
    at = {h.strip(BLANKS): i for i, h in enumerate(header)}
    if not all(c in at for c in (NUMBER, IMPRINT, STYLE, *PARTS)):
        return None
    cell = lambda c: pc.utf8_trim(block.column(at[c]), BLANKS)
    good = pc.and_(pc.match_substring_regex(cell(NUMBER), r"^0*[1-9][0-9]{0,17}$"), pc.not_equal(cell(STYLE), ""))
    good = pc.and_(good, pc.equal(cell(IMPRINT), pc.binary_join_element_wise(*[cell(p) for p in PARTS], "-")))
    return good.to_numpy()


def parse_block(lines: pa.Array, header: list[str]) -> tuple[list[tuple[np.ndarray, pa.Table]], list[tuple[int, str, list[str] | None]]]:
    """Of a block of lines: the good ones in bulk, as (positions, columns), and (position, reason, cells) of those read strictly."""
    ends = pc.replace_substring_regex(lines, r"\r?\n?$", "")
    suspect = _suspects(ends, len(header))
    plain = pc.replace_substring_regex(ends, r'(^|,)="', r'\1"')
    rest, bulk = list(np.flatnonzero(suspect)), []
    found = np.flatnonzero(~suspect)
    for at, block in _bisect(found, plain.take(pa.array(found)), len(header)):
        good = None if block is None else _good(block, header)
        if good is None:
            rest += list(at)
            continue
        rest += list(at[~good])
        if good.any():
            bulk.append((at[good], block.filter(pa.array(good))))
    texts = lines.take(pa.array(rest, pa.int64())).to_pylist()
    return bulk, [(int(i), *diagnose(t, header)) for i, t in zip(rest, texts)]


def load_lines(lines: DataFrame, files: DataFrame, block: int = BLOCK, only_bad: bool = False) -> DataFrame:
    """Every line with its typed columns and reason (null for a good line, whose columns are filled).

    lines: line_id, file_name, line_no, line. files: file_name, header_line; a file sent twice counts
    once (the least header). Lines of a file without a header, or with a header that is not well-formed, are bad
    ("columns"). cvr_number is null where the number is 2^63 or more; cvr_text always has it. only_bad: good lines are
    left out as soon as they are known to be good. A file may hold any share of the lines: headers are broadcast where
    they fit, else a large file's lines are split by the adaptive join. Extra columns are dropped.
    """
    heads = files.groupBy("file_name").agg(F.min("header_line").alias("header_line"))
    heads = F.broadcast(heads) if heads.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else heads
    joined = lines.select("line_id", "file_name", "line_no", "line").join(heads, "file_name", "left").select("line_id", "file_name", "line_no", "line", "header_line")
    schema = T._parse_datatype_string(LOADED)
    texts = ("cvr_text", "tabulator_num", "batch_id", "record_id", "imprinted_id", "ballot_type", "precinct_portion")
    arrow = pa.schema([("line_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int32()), ("cvr_number", pa.int64()), *[(c, pa.string()) for c in texts], ("cells", pa.list_(pa.string())), ("reason", pa.string())])
    headings = (NUMBER, *PARTS, IMPRINT, STYLE, "PrecinctPortion")

    def of_block(piece: pa.Table, at: np.ndarray, found: pa.Table, header: list[str]) -> pa.RecordBatch:
        where, n = {h.strip(BLANKS): i for i, h in enumerate(header)}, len(at)
        trimmed = [pc.utf8_trim(found.column(where[c]), BLANKS).combine_chunks() if c in where else pa.nulls(n, pa.string()) for c in headings]
        flat = pa.concat_arrays([c.combine_chunks() for c in found.columns]).take(pa.array(np.arange(n * found.num_columns).reshape(found.num_columns, n).T.ravel()))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * found.num_columns, pa.int32()), flat)
        ids = [piece.column(c).combine_chunks().take(pa.array(at)) for c in ("line_id", "file_name", "line_no")]
        return pa.RecordBatch.from_arrays([*ids, pc.cast(trimmed[0], pa.int64()), *trimmed, rows, pa.nulls(n, pa.string())], schema=arrow)

    def of_lines(piece: pa.Table, found: list[tuple[int, str, list[str] | None]], header: list[str]) -> pa.RecordBatch:
        where = {h.strip(BLANKS): i for i, h in enumerate(header)}
        get = lambda c: [row[where[c]].strip(BLANKS) if not why and c in where else None for _, why, row in found]
        at = pa.array([i for i, _, _ in found], pa.int64())
        ids = [piece.column(c).combine_chunks().take(at) for c in ("line_id", "file_name", "line_no")]
        numbers = [int(x) if x else None for x in get(NUMBER)]
        return pa.RecordBatch.from_arrays([
            *ids, pa.array([x if x is not None and x < 2**63 else None for x in numbers], pa.int64()), *[pa.array(get(c), pa.string()) for c in headings],
            pa.array([row if not why else None for _, why, row in found], pa.list_(pa.string())), pa.array([why or None for _, why, _ in found], pa.string()),
        ], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = pc.dictionary_encode(batch.column("header_line"), null_encoding="encode")
            codes = code.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            table = pa.table(batch).take(pa.array(order))
            edges = np.searchsorted(codes[order], np.arange(len(code.dictionary) + 1))
            for head, low, high in zip(code.dictionary.to_pylist(), edges[:-1], edges[1:]):
                header = cells(strip_end(head)) if head is not None else None
                for begin in range(int(low), int(high), block):
                    piece = table.slice(begin, min(block, int(high) - begin))
                    if header is None:
                        yield of_lines(piece, [(i, "columns", None) for i in range(piece.num_rows)], [])
                        continue
                    text = piece.column("line").combine_chunks()
                    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
                    bulk, strict = parse_block(text, header)
                    strict = [x for x in strict if x[1]] if only_bad else strict
                    if strict:
                        yield of_lines(piece, strict, header)
                    for at, found in () if only_bad else bulk:
                        yield of_block(piece, at, found, header)

    return joined.mapInArrow(run, schema)


def bad_lines(loaded: DataFrame) -> DataFrame:
    """line_id and reason of each bad line, once."""
    return loaded.where("reason is not null").select("line_id", "reason").distinct()
