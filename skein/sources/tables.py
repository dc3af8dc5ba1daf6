"""Sources: relational tables, captures, recorded responses, CSV inputs, fixture files, rendered files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = (
    "url string, title string, html string, timestamp timestamp, "
    "structured struct<ld_json: array<string>, next_data: string, initial_state: string, meta: map<string,string>>, "
    "requests array<struct<url: string, method: string, resource_type: string, response_status: int, content_type: string, body_size: int, is_json: boolean, body: string, timestamp: bigint>>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a stored table that a task takes where each of them is read into much more.
TASK_ROWS = 100_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a stored table by ``keys``, for work that costs far more than their bytes tell: a small file would be one task. The
    number of parts grows with the rows, so that a task's memory does not, and later steps on the same keys need no shuffle."""
    return rows.repartition(parts_of(rows), *keys)


def parts_of(rows: DataFrame) -> int:
    """In how many parts ``spread`` lays a stored table."""
    return max(4 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK_ROWS)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures stored as JSON lines, read with the declared schema; malformed lines give null columns."""
    return spark.read.schema(CAPTURE).json(path)


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON captures."""
    return spark.read.schema(CAPTURE).option("multiLine", True).json(path)


def json_requests(captured: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded responses that are JSON: keys, seq (capture order), url, body."""
    exploded = captured.select(*keys, F.posexplode("requests").alias("seq", "r"))
    return exploded.where(F.col("r.is_json") & F.try_parse_json(F.col("r.body")).isNotNull()).select(*keys, "seq", "r.url", "r.body")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quoted cells over several lines and doubled quotes; rows with nothing but blanks go. All
    columns are text: types come from the contract, not from a second pass over the file."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    filled = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "" for c in rows.columns]
    keep = F.lit(False)
    for test in filled:
        keep = keep | test
    return rows.where(keep)


def rendered_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes with their path, size and time; the newest of a name is ``latest_per`` on it."""
    return spark.read.format("binaryFile").load(path)


