"""Stored audit records: write-once tables, JSON dimensions, zipped and XML inputs."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of an audit record in the order in which they are committed. Fixed values.
COMMITMENT = ("election", "styles", "pools", "cards", "contests", "assertions", "sorted_cards", "mvrs")
CONTESTS_JSON = "className string, info struct<name: string, id: int, choiceFunction: string, nwinners: int, voteForN: int, candidateNames: map<string,int>>, votes map<string,int>, Nc int, Ncast int, Npop int"
CONTEST_MANIFEST = "List array<struct<Description: string, Id: int, VoteFor: int, NumOfRanks: int>>"
CANDIDATE_MANIFEST = "List array<struct<Description: string, Id: int, ContestId: int>>"
ASSERTION_JSON = "contest_id int, cassorter struct<assorter: struct<className: string, winner: int, loser: int, reportedMargin: double, t: double>, noerror: double>"
ROUND_JSON = "roundIdx int, contestRounds array<struct<id: int, assertionRounds: array<struct<winner: int, loser: int, estSampleSize: int, auditResult: struct<status: string>>>>>"
STYLES_JSON = "batches array<struct<name: string, id: int, possibleContests: array<int>, hasExactContests: boolean, ncards: int>>"
PRNS_JSON = "samplePrns array<string>, round bigint"


def commit(df: DataFrame, folder: str, name: str) -> None:
    """Writes a table of the record once; a second write of the same name fails."""
    if name not in COMMITMENT:
        raise ValueError(f"no table of a record: {name}")
    df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def commit_round(df: DataFrame, folder: str, name: str, round_idx: int) -> None:
    """Writes a round's table (estimates, sample, mvrs or results) once, beside the other rounds."""
    df.write.mode("errorifexists").parquet(f"{folder}/{name}/round={round_idx}")


def read_record(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def export_csv(lines: DataFrame, folder: str, compression: str = "none") -> None:
    """Text lines as files, optionally compressed (gzip, bzip2)."""
    lines.select("value").write.option("compression", compression).text(folder)


def read_json(spark: SparkSession, path: str, schema: str, whole_files: bool = True) -> DataFrame:
    """JSON documents read with a schema: one a file, or one a line."""
    return spark.read.schema(schema).option("multiLine", whole_files).json(path)


def read_styles(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """style_id, name, pool_name (the name up to its first - or .), possible_contests, has_exact and ncards."""
    b = read_json(spark, path, STYLES_JSON, whole_files).select(F.explode("batches").alias("b"))
    return b.select(F.col("b.id").alias("style_id"), F.col("b.name").alias("name"), F.split("b.name", "[-.]")[0].alias("pool_name"), F.col("b.possibleContests").alias("possible_contests"), F.col("b.hasExactContests").alias("has_exact"), F.col("b.ncards").alias("ncards"))


def read_sample_prns(spark: SparkSession, path: str, *keep: str) -> DataFrame:
    """place and prn of stored samples of hexadecimal numbers, beside the documents' columns of keep."""
    rows = spark.read.schema(PRNS_JSON).option("multiLine", not keep).json(path)
    return rows.select(*keep, F.posexplode("samplePrns").alias("place", "p")).select(*keep, "place", F.conv("p", 16, 10).cast("bigint").alias("prn"))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of manifests, each a document with a list."""
    return spark.read.schema(schema).json(path).select(F.inline("List"))


def read_contests(spark: SparkSession, path: str) -> DataFrame:
    """contest_id, name, vote_for, ranked (told by the class), nc, ncast, npop and votes of each contest."""
    r = spark.read.schema(CONTESTS_JSON).json(path)
    return r.select(F.col("info.id").alias("contest_id"), F.col("info.name").alias("name"), F.col("info.voteForN").alias("vote_for"), (F.col("className") == "IrvContest").alias("ranked"), F.col("Nc").alias("nc"), F.col("Ncast").alias("ncast"), F.col("Npop").alias("npop"), "votes")


def read_assertions(spark: SparkSession, path: str) -> DataFrame:
    """contest_id, kind (the assorter's class), winner, loser, margin, t and noerror."""
    r = spark.read.schema(ASSERTION_JSON).json(path)
    a = "cassorter.assorter"
    return r.select("contest_id", F.col(f"{a}.className").alias("kind"), F.col(f"{a}.winner").alias("winner"), F.col(f"{a}.loser").alias("loser"), F.col(f"{a}.reportedMargin").alias("margin"), F.col(f"{a}.t").alias("t"), F.col("cassorter.noerror").alias("noerror"))


def read_configuration(spark: SparkSession, election: str, creation: str, rounds: str) -> DataFrame:
    """One row: election, audit_type, ncards, ncontests, risk_limit, seed (from hexadecimal), percentiles and max_loss."""
    e = spark.read.schema("electionName string, auditType string, ncards int, ncontests int").json(election)
    c = spark.read.schema("riskLimit double, seed string").json(creation)
    r = spark.read.schema("simulation struct<nsimEst: int, estPercentile: array<int>>, clcaConfig struct<maxLoss: double>").json(rounds)
    both = e.crossJoin(c).crossJoin(r)  # one row each
    return both.select(F.col("electionName").alias("election"), F.col("auditType").alias("audit_type"), "ncards", "ncontests", F.col("riskLimit").alias("risk_limit"), F.conv("seed", 16, 10).cast("bigint").alias("seed"), F.col("simulation.estPercentile").alias("percentiles"), F.col("clcaConfig.maxLoss").alias("max_loss"))


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """round, contest_id, winner, loser, estimate and done of each assertion in a round's state."""
    r = spark.read.schema(ROUND_JSON).json(path).select(F.col("roundIdx").alias("round"), F.explode("contestRounds").alias("c"))
    r = r.select("round", F.col("c.id").alias("contest_id"), F.explode("c.assertionRounds").alias("a"))
    return r.select("round", "contest_id", F.col("a.winner").alias("winner"), F.col("a.loser").alias("loser"), F.col("a.estSampleSize").alias("estimate"), (F.col("a.auditResult.status") == "StatRejectNull").alias("done"))


def write_zip(lines: DataFrame, folder: str, member: str, most: int = 1_000_000) -> None:
    """Text lines as zip archives in a folder, each with one member of at most so many lines. Tasks write their own archives
    through the folder's file system, under names of their own, so that a task that is repeated writes nothing twice."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs
        from pyspark import TaskContext

        fs, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        part, held, no = TaskContext.get().partitionId(), [], 0

        def put() -> str:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(member, "".join(x + "\n" for x in held))
            name = f"{root}/part-{part:05d}-{no:03d}.zip"
            with fs.open_output_stream(name) as f:
                f.write(data.getvalue())
            return name

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(x or "")
                if len(held) >= most:
                    yield pa.RecordBatch.from_pydict({"path": [put()]})
                    held, no = [], no + 1
        if held:
            yield pa.RecordBatch.from_pydict({"path": [put()]})

    lines.select("value").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def write_counties(data: DataFrame, folder: str, county: str = "county_id") -> None:
    """CSV files with a header, in one folder for each county."""
    data.write.partitionBy(county).option("header", True).csv(folder)


def unzip_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, member, line_no and value of each text line in the zip archives; an archive is read by one task, as it cannot be split."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        with z.open(member) as f:
                            lines = [x.decode("utf-8", "replace").rstrip("\r\n") for x in f]
                        for begin in range(0, len(lines), 50_000):
                            part = lines[begin : begin + 50_000]
                            yield pd.DataFrame({"file": file, "member": member, "line_no": range(begin, begin + len(part)), "value": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, line_no bigint, value string")


def read_summary_xml(spark: SparkSession, path: str, row_tag: str = "contest") -> DataFrame:
    """contest_id, ncards, undervotes, overvotes and blanks, from attributes of a summary's contest elements. Each file is a document with one root."""
    schema = "_id int, _ballotsCast bigint, _undervotes bigint, _overvotes bigint, _blanks bigint"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.where("_id is not null").select(F.col("_id").alias("contest_id"), F.col("_ballotsCast").alias("ncards"), F.col("_undervotes").alias("undervotes"), F.col("_overvotes").alias("overvotes"), F.col("_blanks").alias("blanks"))


def read_party_lists(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """constituency, party and votes, from JSON documents with a list of party results."""
    schema = "name string, lists array<struct<party: string, votes: bigint, seats: int>>"
    return read_json(spark, path, schema, whole_files).select(F.col("name").alias("constituency"), F.inline("lists"))
