"""Reading captures and faces, writing results."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docfields.sources.schemas import CAPTURES, CORRUPT, FACES


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captures with the declared schema. A broken JSON row comes back with NULL fields and its
    text in `_corrupt_record`, and ends up in the dead letters."""
    if fmt == "json":
        schema = f"{CAPTURES}, {CORRUPT} string"
        return spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return spark.read.schema(CAPTURES).parquet(path)


def stream_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The same as a stream over arriving files."""
    return spark.readStream.schema(CAPTURES).format(fmt).load(path)


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACES).parquet(path)


def write_results(records: DataFrame, path: str, mode: str = "append") -> None:
    """Nested result rows, one folder per kind. The raw text is not among the columns."""
    records.write.mode(mode).partitionBy("kind").parquet(path)


#: One row per finished write: whose rows, in which folder, and which earlier jobs they stand for.
MANIFEST = "job string, attempt string, committed_at timestamp, replaces array<string>, columns string"


def commit_results(records: DataFrame, path: str, job: str, replaces: tuple[str, ...] = ()) -> str:
    """Writes the records of a job so that each is in the results once, however often the job is run or killed.

    Rows are staged in a folder of this attempt; one small file in the manifest then makes them part of the results, so a
    killed job leaves nothing that is read. A job that has been committed is not written again; of attempts that are committed
    at the same time the first one counts. Jobs in `replaces` are out of the results from the same moment. Returns the attempt that counts.
    """
    spark = records.sparkSession
    done = {r.job: r.attempt for r in _committed(spark, path)}
    if job in done:
        return done[job]
    attempt = uuid.uuid4().hex
    records.write.partitionBy("kind").parquet(f"{path}/staged/attempt={attempt}")
    row = [(job, attempt, list(replaces), records.schema.json())]
    entry = spark.createDataFrame(row, "job string, attempt string, replaces array<string>, columns string")
    entry = entry.withColumn("committed_at", F.current_timestamp()).select(*[c.split()[0] for c in MANIFEST.split(", ")])
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return {r.job: r.attempt for r in _committed(spark, path)}[job]


def _committed(spark: SparkSession, path: str) -> list:
    """The first committed attempt of each job, without replaced jobs; one row per job."""
    try:
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    order = F.struct("committed_at", "attempt")
    first = manifest.groupBy("job").agg(F.min_by(F.struct("attempt", "replaces", "columns", "committed_at"), order).alias("m"))
    rows = first.select("job", "m.*").collect()
    gone = {job for r in rows for job in r.replaces or []}
    return [r for r in rows if r.job not in gone]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All committed records; staged rows of killed, repeated or replaced jobs are not among them."""
    rows = _committed(spark, path)
    if not rows:
        raise ValueError(f"no committed results in {path}")
    newest = max(rows, key=lambda r: (r.committed_at, r.attempt))
    schema = StructType.fromJson(json.loads(newest.columns))
    folders = [f"{path}/staged/attempt={r.attempt}" for r in rows]
    return spark.read.schema(schema).option("basePath", f"{path}/staged").parquet(*folders).select(*schema.names)


def compact_results(spark: SparkSession, path: str, job: str) -> str:
    """The results as one job, in the place of all jobs so far; jobs that are committed meanwhile stay beside it."""
    jobs = tuple(r.job for r in _committed(spark, path))
    return commit_results(read_results(spark, path), path, job, jobs)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and intermediate tables. Where the session
    names none, one machine (a `local` master, whose tasks all run in the driver) gets a
    folder of its own; on a cluster that is an error, as executors would not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docfields-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes rows to the shared folder and reads them again: steps that build on one another see the same rows, and a lost executor
    costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/steps/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
