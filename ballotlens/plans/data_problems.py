"""Queries of the general data problems: nested records, orphan references, copies, bad rows, drifting schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.operators.badrows import bad_lines, load_lines
from ballotlens.operators.copies import diff_copies, field_differences, name_text, number_text
from ballotlens.operators.drift import change_scripts, compile_projections, field_kinds, one_table, schema_changes, typed
from ballotlens.operators.nested import flatten_sessions, only_tag, session_candidates, session_rows
from ballotlens.operators.orphans import Reference, find_orphans, orphan_counts
from ballotlens.scratch import written
from ballotlens.tables import table

#: Names and kinds of fields are broadcast only if they were counted and are no more.
MAX_FIELDS = 100_000
SUMMARY_KEY = ["county_id", "contest_id", "choice_no"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each mark that is a vote in a session's current state."""
    marks = flatten_sessions(table(spark, d, "cvr_sessions"), ("mark",))["mark"].where("is_vote").withColumn("candidate_id", F.col("candidate_id").try_cast("int"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return marks.select("session_id", "card_no", "contest_id", "mark_no", zero("candidate_id"), zero("mark_rank"), zero("ballot_style_id")).distinct()


def _flat(spark: SparkSession, d: str, tag: str, *columns: str) -> DataFrame:
    """One flat table on its own: only its rows are emitted, and nothing is written on the way."""
    return only_tag(session_rows(table(spark, d, "cvr_sessions"), only=(tag,)), tag).select(*columns).distinct()


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of sessions, of their current state."""
    return _flat(spark, d, "session", "session_id", "county_id", "state", "tabulator_id", "batch_id", "record_id", "counting_group", "session_type", "precinct_portion_id", "ballot_style_id")


def p1_cards(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of cards; its parent is the session."""
    return _flat(spark, d, "card", "session_id", "card_no", "card_id", "paper_index", "ballot_style_id")


def p1_contests(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of contests; their parent is the card."""
    return _flat(spark, d, "contest", "session_id", "card_no", "contest_no", "contest_id", "undervotes", "overvotes", "ballot_style_id")


def p1_marks(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of marks, votes or not; their parent is the contest."""
    return _flat(spark, d, "mark", "session_id", "card_no", "contest_no", "contest_id", "mark_no", "candidate_id", "mark_rank", "is_vote", "is_ambiguous", "mark_density", "party_id", "ballot_style_id")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Records and fields that could not be read, per reason."""
    return _flat(spark, d, "reject", "record_key", "reason").groupBy("reason").agg(F.count("*").alias("n_records"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each flat table, and how many lack their parent there (none should)."""
    flat = flatten_sessions(table(spark, d, "cvr_sessions"))
    out = None
    for child, parent in (("session", None), ("card", "session"), ("contest", "card"), ("mark", "contest")):
        own = flat[child].select("row_key", "parent_key").distinct()
        keys = flat[parent].select(F.col("row_key").alias("parent_key"), F.lit(1).alias("known")).distinct() if parent else None
        own = own.join(keys, "parent_key", "left") if parent else own.withColumn("known", F.lit(1))
        part = own.agg(F.count("*").alias("n_rows"), F.count_if(F.col("known").isNull()).alias("n_without_parent")).select(F.lit(child).alias("flat_table"), "n_rows", "n_without_parent")
        out = part if out is None else out.unionAll(part)
    return out


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    spells = lambda t, k: table(spark, d, t).select(F.col(k).alias("missing_key"), "loaded_at", "deleted_at")
    refs = lambda t, r, k, at: table(spark, d, t).select(F.col(r).alias("record_id"), F.col(k).alias("missing_key"), F.col(at).alias("at"))
    return find_orphans([
        Reference("contest_manifest.district_id", refs("contest_manifest", "contest_id", "district_id", "loaded_at"), spells("district_manifest", "district_id")),
        Reference("cvr_sessions.candidate_id", session_candidates(table(spark, d, "cvr_sessions")), spells("candidate_manifest", "candidate_id")),
        Reference("cvr_export.precinct_portion_id", refs("cvr_export", "cvr_key", "precinct_portion_id", "exported_at"), spells("precinct_portions", "precinct_portion_id")),
    ])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each reference whose key is not valid in its parent table at the record's time."""
    return _orphans(spark, d).select("reference_name", "record_id", "missing_key", "orphan_kind").distinct()


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per referring table, kind and day."""
    return orphan_counts(_orphans(spark, d))


def _summary_diff(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    fields = {"total_votes": number_text(F.col("total_votes")), "total_undervotes": number_text(F.col("total_undervotes")), "choice_name": name_text(F.col("choice_name"))}
    return diff_copies(table(spark, d, "summary_official"), table(spark, d, "summary_copy"), SUMMARY_KEY, fields), list(fields)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that one side lacks, and fields in which the two sides differ."""
    diff, fields = _summary_diff(spark, d)
    return field_differences(diff, SUMMARY_KEY, fields, "missing_in_official", "missing_in_copy")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Bad lines and why."""
    return bad_lines(load_lines(table(spark, d, "raw_cvr_lines"), table(spark, d, "raw_cvr_files"), only_bad=True))


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The cast-vote records of all good lines, with their cells."""
    rows = load_lines(table(spark, d, "raw_cvr_lines"), table(spark, d, "raw_cvr_files")).where("reason is null")
    return rows.select("line_id", "file_name", "cvr_number", "imprinted_id", "ballot_type", "precinct_portion", F.array_join("cells", "|").alias("cells")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of columns from each county's previous file to the next."""
    return schema_changes(change_scripts(table(spark, d, "export_files"), table(spark, d, "export_lines")))


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """All lines in one table: file_id, line_no, and field, kind and value of each non-empty cell, the value written as the
    field's one kind over all files demands."""
    scripts = written(change_scripts(table(spark, d, "export_files"), table(spark, d, "export_lines")), "scripts")
    names = written(compile_projections(scripts), "projections")
    rows = one_table(table(spark, d, "export_lines"), names)
    cells = rows.select("file_id", "line_no", F.explode("cells").alias("field", "value")).where("value is not null")
    kinds = F.broadcast(field_kinds(scripts, names).limit(MAX_FIELDS + 1)) if names.select("field").distinct().limit(MAX_FIELDS + 1).count() <= MAX_FIELDS else field_kinds(scripts, names)
    kind = F.coalesce("kind", F.lit("text"))
    return cells.join(kinds, "field", "left").select("file_id", "line_no", "field", kind.alias("kind"), typed(F.col("value"), kind).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_sessions, p1_cards, p1_contests, p1_marks, p1_rejects, p1_links, p2_found, p2_counts, p4_found, p5_found, p5_loaded, p7_found, p7_table)}

_STATES = """
truths(w) as (values ('true'), ('1'), ('1.0'), ('yes'), ('y'), ('t')),
states as (
  select session_id, exported_at,
    case when lower(trim(payload::json->'Modified'->>'IsCurrent')) in (select w from truths) then payload::json->'Modified' else payload::json->'Original' end as st
  from cvr_sessions),
cards as (
  select distinct session_id, exported_at, st, card_no, card from (
    select session_id, exported_at, st, unnest(list) as card, generate_subscripts(list, 1) as card_no from (
      select session_id, exported_at, st,
        case when json_type(st->'Cards') = 'ARRAY' then from_json(st->'Cards', '["json"]') when json_type(st->'Contests') = 'ARRAY' then [json_object('Contests', st->'Contests')] end as list
      from states))),
contests as (
  select session_id, exported_at, st, card_no, unnest(list) as contest, generate_subscripts(list, 1) as contest_no from (
    select session_id, exported_at, st, card_no, from_json(card->'Contests', '["json"]') as list from cards where json_type(card->'Contests') = 'ARRAY')),
marks as (
  select session_id, exported_at, st, card_no, contest_no, contest, unnest(list) as mark, generate_subscripts(list, 1) as mark_no from (
    select session_id, exported_at, st, card_no, contest_no, contest, from_json(contest->'Marks', '["json"]') as list from contests where json_type(contest->'Marks') = 'ARRAY'))
"""

_ORPHANS = f"""
{_STATES},
refs as (
  select 'contest_manifest.district_id' as reference_name, cast(contest_id as bigint) as record_id, cast(district_id as bigint) as missing_key, loaded_at as at from contest_manifest
  union select 'cvr_sessions.candidate_id', session_id, try_cast(trim(mark->>'CandidateId') as bigint), exported_at from marks
  union select 'cvr_export.precinct_portion_id', cvr_key, precinct_portion_id, exported_at from cvr_export),
spells as (
  select 'contest_manifest.district_id' as reference_name, cast(district_id as bigint) as missing_key, loaded_at, deleted_at from district_manifest
  union select 'cvr_sessions.candidate_id', candidate_id, loaded_at, deleted_at from candidate_manifest
  union select 'cvr_export.precinct_portion_id', precinct_portion_id, loaded_at, deleted_at from precinct_portions),
firsts as (select reference_name, missing_key, min(loaded_at) as first_loaded from spells group by all),
orphans as (
  select r.reference_name, r.record_id, r.missing_key, r.at,
    case when f.first_loaded is null then 'missing' when f.first_loaded > r.at then 'late' else 'deleted' end as orphan_kind
  from refs r left join firsts f using (reference_name, missing_key)
  where r.missing_key is not null and not exists (
    select 1 from spells s where s.reference_name = r.reference_name and s.missing_key = r.missing_key and s.loaded_at <= r.at and (s.deleted_at is null or r.at < s.deleted_at)))
"""

_NUMBER = "case when trim({0}, ' \t') = '' or upper(trim({0}, ' \t')) = 'N/A' then null else coalesce(cast(try_cast(replace(trim({0}, ' \t'), ',', '') as decimal(38,6)) as varchar), trim({0}, ' \t')) end"
_FORM = r"""^(?:[^",]*|=?"(?:[^"]|"")*")(?:,(?:[^",]*|=?"(?:[^"]|"")*"))*$"""

_whole = lambda x, kind="int": f"coalesce(try_cast(trim({x}) as {kind}), case when trim({x}) like '%.%' and try_cast(trim({x}) as double) = floor(try_cast(trim({x}) as double)) then try_cast(try_cast(trim({x}) as double) as {kind}) end)"
_truth = lambda x: f"case when lower(trim({x})) in (select w from truths) then true when lower(trim({x})) in ('false', '0', '0.0', 'no', 'n', 'f') then false end"

_LINES = f"""with l as (select distinct line_id, file_name, regexp_replace(line, '\\r$', '') as t, header_line as h from raw_cvr_lines join raw_cvr_files using (file_name)),
      w as (select *, regexp_matches(t, '{_FORM}') as fit, [case when x like '="%' or x like '"%' then replace(regexp_replace(x[:-2], '^=?"', ''), '""', '"') else x end for x in regexp_extract_all(',' || t, ',(=?"(?:[^"]|"")*"|[^",]*)', 1)] as c,
        regexp_extract_all(',' || h, ',([^,]*)', 1) as hs from l),
      v as (select *, len(hs) = len(c) as same, trim(c[list_position(hs, 'CvrNumber')], ' \t') as nr, trim(c[list_position(hs, 'ImprintedId')], ' \t') as im, trim(c[list_position(hs, 'BallotType')], ' \t') as bt, trim(c[list_position(hs, 'PrecinctPortion')], ' \t') as pp,
        trim(c[list_position(hs, 'TabulatorNum')], ' \t') || '-' || trim(c[list_position(hs, 'BatchId')], ' \t') || '-' || trim(c[list_position(hs, 'RecordId')], ' \t') as parts from w),
      b as (select *, not fit or not same or not regexp_matches(nr, '^0*[1-9][0-9]*$') or im <> parts or bt = '' as bad from v)"""

ORACLE: dict[str, str] = {
    "p1_sessions": f"""with {_STATES}
      select distinct session_id, county_id, case when lower(trim(payload::json->'Modified'->>'IsCurrent')) in (select w from truths) then 'Modified' else 'Original' end as state,
        {_whole("payload::json->>'TabulatorId'")} as tabulator_id, payload::json->>'BatchId' as batch_id, payload::json->>'RecordId' as record_id, {_whole("payload::json->>'CountingGroupId'")} as counting_group,
        payload::json->>'SessionType' as session_type, {_whole("st->>'PrecinctPortionId'")} as precinct_portion_id, {_whole("st->>'BallotTypeId'")} as ballot_style_id
      from cvr_sessions join (select distinct session_id, st from states where json_type(st) = 'OBJECT') using (session_id)""",
    "p1_cards": f"""with {_STATES}
      select distinct session_id, card_no::int as card_no, {_whole("card->>'Id'")} as card_id, {_whole("card->>'PaperIndex'")} as paper_index, {_whole("st->>'BallotTypeId'")} as ballot_style_id from cards where json_type(card) = 'OBJECT'""",
    "p1_contests": f"""with {_STATES}
      select distinct session_id, card_no::int as card_no, contest_no::int as contest_no, {_whole("contest->>'Id'")} as contest_id, {_whole("contest->>'Undervotes'")} as undervotes, {_whole("contest->>'Overvotes'")} as overvotes, {_whole("st->>'BallotTypeId'")} as ballot_style_id
      from contests where json_type(contest) = 'OBJECT'""",
    "p1_marks": f"""with {_STATES}
      select distinct session_id, card_no::int as card_no, contest_no::int as contest_no, {_whole("contest->>'Id'")} as contest_id, mark_no::int as mark_no, {_whole("mark->>'CandidateId'", "bigint")} as candidate_id, {_whole("mark->>'Rank'")} as mark_rank,
        {_truth("mark->>'IsVote'")} as is_vote, {_truth("mark->>'IsAmbiguous'")} as is_ambiguous, {_whole("mark->>'MarkDensity'")} as mark_density, {_whole("mark->>'PartyId'")} as party_id, {_whole("st->>'BallotTypeId'")} as ballot_style_id
      from marks where json_type(mark) = 'OBJECT'""",
    "p1_links": f"""with {_STATES}
      select 'session' as flat_table, count(distinct session_id) as n_rows, 0::bigint as n_without_parent from states where json_type(st) = 'OBJECT'
      union all select 'card', count(distinct (session_id, card_no)), 0 from cards where json_type(card) = 'OBJECT'
      union all select 'contest', count(distinct (session_id, card_no, contest_no)), 0 from contests where json_type(contest) = 'OBJECT'
      union all select 'mark', count(distinct (session_id, card_no, contest_no, mark_no)), 0 from marks where json_type(mark) = 'OBJECT'""",
    "p1_found": f"""with {_STATES}
      select distinct session_id, cast(card_no as int) as card_no, cast(trim(contest->>'Id') as int) as contest_id, cast(mark_no as int) as mark_no,
        coalesce(cast(trim(mark->>'CandidateId') as int), 0) as candidate_id, coalesce(cast(trim(mark->>'Rank') as int), 0) as mark_rank, coalesce(cast(trim(st->>'BallotTypeId') as int), 0) as ballot_style_id
      from marks where lower(trim(mark->>'IsVote')) in (select w from truths)""",
    "p2_found": f"with {_ORPHANS} select distinct reference_name, record_id, missing_key, orphan_kind from orphans",
    "p2_counts": f"""with {_ORPHANS}
      select reference_name, orphan_kind, cast("at" as date) as period, count(*) as n_orphans, count(distinct missing_key) as n_keys
      from (select distinct * from orphans) group by all""",
    "p4_found": f"""with o as (select distinct county_id, contest_id, choice_no, {_NUMBER.format('total_votes')} as v, {_NUMBER.format('total_undervotes')} as u, trim(choice_name, ' \t') as n from summary_official),
      c as (select distinct county_id, contest_id, choice_no, cast(cast(total_votes as decimal(38,6)) as varchar) as v, cast(cast(total_undervotes as decimal(38,6)) as varchar) as u, trim(choice_name, ' \t') as n from summary_copy),
      p as (select county_id, contest_id, choice_no, o.v as ov, c.v as cv, o.u as ou, c.u as cu, o.n as ona, c.n as cn from o join c using (county_id, contest_id, choice_no))
      select county_id, contest_id, choice_no, 'missing_in_copy' as difference from o anti join c using (county_id, contest_id, choice_no)
      union select county_id, contest_id, choice_no, 'missing_in_official' from c anti join o using (county_id, contest_id, choice_no)
      union select county_id, contest_id, choice_no, 'total_votes' from p where ov is distinct from cv
      union select county_id, contest_id, choice_no, 'total_undervotes' from p where ou is distinct from cu
      union select county_id, contest_id, choice_no, 'choice_name' from p where ona is distinct from cn""",
    "p5_found": f"{_LINES} select distinct line_id, case when not fit then 'quoting' when not same then 'columns' else 'value' end as reason from b where bad",
    "p5_loaded": f"{_LINES} select distinct line_id, file_name, nr::bigint as cvr_number, im as imprinted_id, bt as ballot_type, pp as precinct_portion, array_to_string(c, '|') as cells from b where not bad",
}
