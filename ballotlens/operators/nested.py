"""Deeply nested records to related flat tables, in one pass.

A depth-first visitor turns each JSON record into tagged rows: table tag, primary key, parent key and
payload. It runs inside ``mapInArrow``, so each record is parsed once, whatever the number of tables;
nothing is shuffled. The payload is typed: one struct for each tag, of which only the row's own is filled, so nothing
is written as text and parsed again. The rows are written partitioned by tag and each tag is read with its schema.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlens.scratch import new_path

TRUE_WORDS, FALSE_WORDS = ("true", "1", "1.0", "yes", "y", "t"), ("false", "0", "0.0", "no", "n", "f")


def as_int(value: object) -> int | None:
    """A whole number written 7, 7.0, "7" or " 7 "; anything else is None."""
    if isinstance(value, bool):
        return None
    if isinstance(value, int):
        return value
    try:
        number = float(value) if isinstance(value, float) else float(str(value)) if "." in str(value) else int(str(value))
    except (ValueError, OverflowError):
        return None
    return int(number) if number == number and abs(number) < 2**63 and number == int(number) else None


def as_bool(value: object) -> bool | None:
    """A truth value written true, 1, "true", "Yes", "T" and the like; anything else is None."""
    if isinstance(value, bool) or value is None:
        return value
    word = str(value).strip().lower()
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def as_text(value: object) -> str | None:
    """The text of a leaf; numbers as written by JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


READERS: dict[str, Callable] = {"int": as_int, "bigint": as_int, "boolean": as_bool, "string": as_text}
#: Numbers beyond these bounds give None, as the flat column could not hold them.
BOUNDS = {"int": 2**31, "bigint": 2**63}
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
REJECT = {"record_key": "string", "reason": "string"}


def read_leaf(value: object, kind: str) -> object:
    if value is None:
        return None
    out = READERS[kind](value)
    return None if kind in BOUNDS and out is not None and not -BOUNDS[kind] <= out < BOUNDS[kind] else out


@dataclass(frozen=True)
class Level:
    """One nesting level.

    tag: name of its flat table. array: the parent's field that holds its records; one bare record
    counts as an array of one, anything else as absent. fields: JSON field to output column and SQL
    type. optional: the level may be absent, its children then lie directly in the parent and one
    implicit record with ordinal 1 stands for it. carry: ancestors' columns that its rows repeat.
    A record that is null still counts for the ordinals of those after it.
    """

    tag: str
    array: str
    fields: dict[str, tuple[str, str]]
    children: tuple[Level, ...] = ()
    optional: bool = False
    carry: tuple[str, ...] = ()


def _items(level: Level, parent: dict) -> list:
    items = parent.get(level.array)
    if isinstance(items, list):
        return items
    if isinstance(items, dict):
        return [items]
    if level.optional and any(isinstance(parent.get(c.array), (list, dict)) for c in level.children):
        return [{c.array: parent.get(c.array) for c in level.children}]
    return []


Emit = Callable[[str, str, "str | None", tuple], None]


def visitor(level: Level, known: tuple[str, ...], only: frozenset[str] | None) -> Callable[[dict, str, tuple, Emit], None]:
    """A function that emits the rows of a level below a parent object, each before its children: visit(parent, its key,
    the values of the columns known from above, emit). only: the tags wanted (None: all).

    A leaf that holds something which is no value of its type is null, and a row of the tag ``reject`` says so.
    """
    carried = [known.index(c) for c in level.carry]
    leaves = [(f, kind) for f, (_, kind) in level.fields.items()]
    below = (*known, f"{level.tag}_no", *[out for out, _ in level.fields.values()])
    wanted, told = only is None or level.tag in only, only is None or "reject" in only
    children = [visitor(c, below, only) for c in level.children]

    def visit(parent: dict, key: str, values: tuple, emit: Emit) -> None:
        for at, item in enumerate(_items(level, parent), 1):
            if not isinstance(item, dict):
                continue
            own, mine = f"{key}/{at}", [at]
            for field, kind in leaves:
                raw = item.get(field)
                value = raw if type(raw) is int and kind == "int" and -(2**31) <= raw < 2**31 or type(raw) is bool and kind == "boolean" else read_leaf(raw, kind)
                mine.append(value)
                if told and value is None and raw is not None and raw != "":
                    emit("reject", own, key, (own, f"unreadable {field}"))
            if wanted:
                emit(level.tag, own, key, (*[values[i] for i in carried], *mine))
            if children:
                for child in children:
                    child(item, own, (*values, *mine), emit)

    return visit


def columns_of(level: Level, carried: dict[str, str]) -> dict[str, str]:
    """Columns and types of a level's payload. carried: types of the columns that it repeats."""
    return {c: carried[c] for c in level.carry} | {f"{level.tag}_no": "int"} | {out: kind for out, kind in level.fields.values()}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {k}" for c, k in columns.items())


Start = Callable[[dict, dict], tuple[dict, dict, str]]


def emit_tagged(df: DataFrame, key: str, payload: str, start: Start, root_tag: str, levels: tuple[Level, ...], tables: dict[str, dict[str, str]], keep: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """The tagged rows of ``df``'s records: the columns of keep, tag, row_key, parent_key, payload.

    key, payload: columns with the record's key and its JSON. start(record, row) gives the root table's
    columns, the object below which the levels lie, and the reason if the record is unfit ("" if not).
    tables: columns and types of each tag's table. A payload that is null, no JSON or no object gives one row with the
    tag ``reject``, with the key and the reason. keep: columns repeated beside each row, which must not be named like
    the four; other columns of ``df`` are dropped, whatever their names.
    """
    tables = {t: c for t, c in (tables | {"reject": REJECT}).items() if only is None or t in only}
    columns = list(dict.fromkeys([key, payload, *keep, *[c for c in ("county_id",) if c in df.columns]]))
    kind = T._parse_datatype_string(", ".join(f"`{t}` struct<{', '.join(f'`{c}`: {k}' for c, k in cols.items())}>" for t, cols in tables.items()))
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, T.StringType()) for c in ("tag", "row_key", "parent_key")], T.StructField("payload", kind)])
    wanted = None if only is None else frozenset(only)
    arrow = {t: pa.struct([(c, ARROW[k]) for c, k in cols.items()]) for t, cols in tables.items()}
    root_columns = tuple(tables.get(root_tag) or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads, visits = json.loads, None
        for batch in batches:
            rows: dict[str, list[tuple]] = {t: [] for t in tables}
            texts, others = batch.column(columns.index(payload)).to_pylist(), {c: batch.column(columns.index(c)).to_pylist() for c in columns if c != payload}
            for i, text in enumerate(texts):
                def emit(tag: str, own: str, parent: str | None, values: tuple, i: int = i) -> None:
                    rows[tag].append((i, own, parent, values))

                row = {c: v[i] for c, v in others.items()}
                own = str(row[key])
                try:
                    record = loads(text) if text is not None else None
                    reason = "" if isinstance(record, dict) else "null" if record is None else "no object"
                except (ValueError, RecursionError):
                    record, reason = None, "no JSON"
                if not reason:
                    root, below, reason = start(record, row)
                if reason:
                    if "reject" in rows:
                        emit("reject", own, None, (own, reason))
                    continue
                if root_tag in rows:
                    emit(root_tag, own, None, tuple(root.get(c) for c in root_columns))
                if visits is None:
                    visits = [visitor(level, tuple(root), wanted) for level in levels]
                for visit in visits:
                    visit(below, own, tuple(root.values()), emit)
            for tag, found in rows.items():
                if found:
                    at, own, parent, values = zip(*found)
                    at = pa.array(at, pa.int64())
                    mine = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values), arrow[tag])], fields=list(arrow[tag]))
                    body = pa.StructArray.from_arrays([mine if t == tag else pa.nulls(len(at), arrow[t]) for t in tables], fields=[pa.field(t, arrow[t]) for t in tables])
                    yield pa.RecordBatch.from_arrays([*[batch.column(columns.index(c)).take(at) for c in keep], pa.array([tag] * len(at)), pa.array(own, pa.string()), pa.array(parent, pa.string()), body], names=[f.name for f in schema])

    return df.select(*columns).mapInArrow(run, schema)


def only_tag(rows: DataFrame, tag: str) -> DataFrame:
    """Tagged rows of one tag as its table: the kept columns, row_key, parent_key and its own columns."""
    return rows.where(F.col("tag") == tag).select(*[c for c in rows.columns if c not in ("tag", "payload")], f"payload.{tag}.*")


class FlatTables:
    """The tables of one emission, stored by tag."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self._spark, self.path, self._schema = spark, path, schema

    def __getitem__(self, tag: str) -> DataFrame:
        """Table ``tag``: the kept columns, row_key, parent_key and its own columns. Only its part is read."""
        return only_tag(self._spark.read.schema(self._schema).parquet(self.path), tag)


def write_tagged(rows: DataFrame, name: str = "flat") -> FlatTables:
    """Writes tagged rows, partitioned by tag, into the shared folder."""
    path = new_path(rows.sparkSession, name)
    rows.write.partitionBy("tag").parquet(path)
    order = [f for f in rows.schema if f.name != "tag"] + [f for f in rows.schema if f.name == "tag"]
    return FlatTables(rows.sparkSession, path, T.StructType(order))


# --- cast-vote-record sessions -------------------------------------------------------------------

MARK = Level("mark", "Marks", {"CandidateId": ("candidate_id", "bigint"), "Rank": ("mark_rank", "int"), "IsVote": ("is_vote", "boolean"), "IsAmbiguous": ("is_ambiguous", "boolean"), "MarkDensity": ("mark_density", "int"), "PartyId": ("party_id", "int")}, carry=("session_id", "ballot_style_id", "card_no", "contest_no", "contest_id"))
CONTEST = Level("contest", "Contests", {"Id": ("contest_id", "int"), "Undervotes": ("undervotes", "int"), "Overvotes": ("overvotes", "int")}, (MARK,), carry=("session_id", "ballot_style_id", "card_no"))
CARD = Level("card", "Cards", {"Id": ("card_id", "int"), "PaperIndex": ("paper_index", "int")}, (CONTEST,), optional=True, carry=("session_id", "ballot_style_id"))
_PARENTS = {"session_id": "bigint", "ballot_style_id": "int", "card_no": "int", "contest_no": "int", "contest_id": "int"}
SESSION_FIELDS = {"TabulatorId": ("tabulator_id", "int"), "BatchId": ("batch_id", "string"), "RecordId": ("record_id", "string"), "CountingGroupId": ("counting_group", "int"), "ImageMask": ("image_mask", "string"), "SessionType": ("session_type", "string")}
STATE_FIELDS = {"PrecinctPortionId": ("precinct_portion_id", "int"), "BallotTypeId": ("ballot_style_id", "int")}
SESSION_TABLES = {
    "session": {"session_id": "bigint", "county_id": "int", "state": "string"} | dict([*SESSION_FIELDS.values(), *STATE_FIELDS.values()]),
    "card": columns_of(CARD, _PARENTS), "contest": columns_of(CONTEST, _PARENTS), "mark": columns_of(MARK, _PARENTS),
}


def _current(record: dict, row: dict) -> tuple[dict, dict, str]:
    modified = record.get("Modified")
    name = "Modified" if isinstance(modified, dict) and as_bool(modified.get("IsCurrent")) else "Original"
    state = record.get(name)
    if not isinstance(state, dict):
        return {}, {}, "no state"
    root = {"session_id": row["session_id"], "county_id": row.get("county_id"), "state": name}
    root |= {out: read_leaf(record.get(f), kind) for f, (out, kind) in SESSION_FIELDS.items()}
    root |= {out: read_leaf(state.get(f), kind) for f, (out, kind) in STATE_FIELDS.items()}
    return root, state, ""


def session_rows(sessions: DataFrame, keep: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """Tagged rows of cvr_sessions, of each session's current state.

    The current state is Modified if it is an object and its IsCurrent is true, else Original; a session
    with neither is rejected ("no state"). Repeated rows of a session give repeated tagged rows;
    ``distinct`` on a flat table removes them.
    """
    return emit_tagged(sessions, "session_id", "payload", _current, "session", (CARD,), SESSION_TABLES, keep, only)


def flatten_sessions(sessions: DataFrame, only: tuple[str, ...] | None = None) -> FlatTables:
    """cvr_sessions as the tables session, card, contest and mark (and reject), with their parent keys; only: those wanted."""
    return write_tagged(session_rows(sessions, only=only), "sessions")


def session_candidates(sessions: DataFrame) -> DataFrame:
    """record_id, missing_key and at (exported_at) of every mark of each session's current state, read as above."""
    marks = only_tag(session_rows(sessions, ("exported_at",), ("mark",)), "mark")
    return marks.select(F.col("session_id").alias("record_id"), F.col("candidate_id").alias("missing_key"), F.col("exported_at").alias("at"))
