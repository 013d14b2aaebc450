"""Queries of the problems on text and training data, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.llm.leaks import exact_leaks, find_leaks
from ballotlens.llm.mixing import mix, mix_sources, shares
from ballotlens.llm.names import canonicalise
from ballotlens.llm.sampling import audit_samples, golden_sample
from ballotlens.llm.textstats import _ENDS, _NEAR, COMMON, COUNTS, NAMES, classify, components, document_statistics
from ballotlens.tables import table

GOLDEN_RATE, GOLDEN_SHIFT = 0.05, 20311104


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry of the reference list for each typed value that is not itself one."""
    sov, manifest = table(spark, d, "statement_of_votes"), table(spark, d, "contest_manifest")
    as_rows = lambda df, t, k, f, *more: df.select(F.lit(t).alias("source_table"), F.col(k).cast("bigint").alias("record_id"), F.lit(f).alias("field_name"), F.col(f).alias("value"), *more)
    titles = as_rows(sov, "statement_of_votes", "row_id", "contest_title").unionAll(as_rows(manifest, "contest_manifest", "contest_id", "description"))
    choices = as_rows(sov, "statement_of_votes", "row_id", "choice_name", F.col("contest_title").alias("title"))
    return canonicalise(titles, choices, table(spark, d, "canonical_names")).select("source_table", "record_id", "field_name", "canon_id")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Records whose typed value stands for no entry, per field."""
    return p3_found(spark, d).where("canon_id = 0").groupBy("source_table", "field_name").agg(F.count("*").alias("n_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The cards of each county's sample in each round."""
    return audit_samples(table(spark, d, "card_manifest"), table(spark, d, "audit_rounds"))


def p6_golden(spark: SparkSession, d: str) -> DataFrame:
    """Cards selected by the golden-ratio points of their persistent numbers."""
    return golden_sample(table(spark, d, "card_manifest", "county_id", "card_key"), "card_key", GOLDEN_RATE, GOLDEN_SHIFT).distinct()


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "passage"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items such that the text holds at least 13 words in a row of the passage."""
    return exact_leaks(_leaks(spark, d))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items such that the text holds a window of 13 words of the passage with at most two word edits."""
    return _leaks(spark, d).select("doc_id", "item_id", "distance", "run")


def _topic():
    return F.regexp_extract("election_id", r"^el-(\d{4})", 1)


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    """How often each text is used."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"), _topic())


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, fitted and actual share of each source, language and topic."""
    return shares(*mix(table(spark, d, "documents"), table(spark, d, "source_targets"), _topic()))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not prose, and what they are."""
    return classify(table(spark, d, "documents", "doc_id", "text")).where("doc_kind <> 'prose'").select("doc_id", "doc_kind").distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document's text (sizes and shares of words, symbols, digits, lines and common words)."""
    s = document_statistics(table(spark, d, "documents", "doc_id", "text"))
    return s.select("doc_id", *[c if c in COUNTS else F.round(c, 6).alias(c) for c in NAMES[:9]])


def p10_components(spark: SparkSession, d: str) -> DataFrame:
    """The mixture's components, what each was taken for, and the document to look at first."""
    return components(classify(table(spark, d, "documents", "doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_unmatched, p6_found, p6_golden, p8_found, p8_near, p9_plan, p9_shares, p10_found, p10_statistics, p10_components)}

_quoted = lambda chars: "".join(f"\\x{{{ord(c):x}}}" for c in chars)
_SPACE = r"\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}"

ORACLE: dict[str, str] = {
    "p10_statistics": rf"""with
      d as (select doc_id, t, string_split(t, chr(10)) as ls, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') as w, regexp_replace(t, '[{_SPACE}]', '', 'g') as v from (select doc_id, coalesce(text, '') as t from documents)),
      l as (select *, list_filter(list_transform(ls, lambda x: regexp_replace(x, '[{_SPACE}]', '', 'g')), lambda x: len(x) > 0) as shown from d)
      select doc_id, len(t)::bigint as n_chars, len(w)::bigint as n_words, case when t = '' then 0 else len(ls) end::bigint as n_lines,
        round(coalesce(list_sum(list_transform(w, lambda x: len(x))) / nullif(len(w), 0), 0)::double, 6) as mean_word_length,
        round(coalesce(len(regexp_replace(v, '[\p{{L}}\p{{N}}{_quoted(_NEAR)}]', '', 'g')) / nullif(len(v), 0), 0)::double, 6) as symbol_ratio,
        round(coalesce((len(v) - len(regexp_replace(v, '\p{{N}}', '', 'g'))) / nullif(len(v), 0), 0)::double, 6) as digit_ratio,
        round(coalesce(len(list_filter(shown, lambda x: regexp_matches(x, '[{_quoted(_ENDS)}]$'))) / nullif(len(shown), 0), 0)::double, 6) as punctuated_lines,
        round(coalesce(len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{c}'" for c in sorted(set(COMMON.split())))}))) / nullif(len(w), 0), 0)::double, 6) as common_words,
        round(coalesce(len(v) / nullif(len(shown), 0), 0)::double, 6) as mean_line_length from l""",
    "p6_found": """with recursive
      c0 as (select county_id, card_key, added_at, regexp_replace(lower(trim(prn, ' \t')), '^0x', '') as h from card_manifest where prn is not null),
      cards as (select county_id, card_key, min(('0x' || h)::ubigint) as number, min(added_at) as added_at from c0 group by all),
      stored as (select distinct county_id, ('0x' || regexp_replace(lower(trim(p, ' \t')), '^0x', ''))::ubigint as number from (select county_id, unnest(sample_prns) as p from audit_rounds where round_idx = 1)),
      r1 as (select county_id, card_key from cards semi join stored using (county_id, number)),
      n2 as (select county_id, card_key from (
        select c.county_id, c.card_key, r.wanted - (select count(*) from r1 where r1.county_id = c.county_id) as need, row_number() over (partition by c.county_id order by number, c.card_key) as rn
        from cards c join audit_rounds r on r.county_id = c.county_id and r.round_idx = 2 and c.added_at <= r.drawn_at
        where not exists (select 1 from r1 where r1.county_id = c.county_id and r1.card_key = c.card_key)) where rn <= need),
      r2 as (select * from r1 where county_id in (select county_id from audit_rounds where round_idx = 2) union select * from n2),
      n3 as (select county_id, card_key from (
        select c.county_id, c.card_key, r.wanted - (select count(*) from r2 where r2.county_id = c.county_id) as need, row_number() over (partition by c.county_id order by number, c.card_key) as rn
        from cards c join audit_rounds r on r.county_id = c.county_id and r.round_idx = 3 and c.added_at <= r.drawn_at
        where not exists (select 1 from r2 where r2.county_id = c.county_id and r2.card_key = c.card_key)) where rn <= need),
      r3 as (select * from r2 where county_id in (select county_id from audit_rounds where round_idx = 3) union select * from n3)
      select county_id, 1 as round_idx, card_key from r1 union all select county_id, 2, card_key from r2 union all select county_id, 3, card_key from r3""",
    "p6_golden": f"select distinct county_id, card_key from card_manifest where ((card_key % 2147483648) * 1327217885 + {GOLDEN_SHIFT}) % 2147483648 < {int(GOLDEN_RATE * 2**31)}",
    "p8_found": r"""with
      w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
      g as (select distinct doc_id, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w)),
      v as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as w from eval_items),
      h as (select distinct item_id, array_to_string(w[i:i + 12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as i from v))
      select distinct doc_id, item_id from g join h using (g)""",
}
