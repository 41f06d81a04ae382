"""Write-ahead logs: change rows as JSON lines, and back up to the first damaged line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json_line import quoted
from ..schema import WAL_RECORD


def encode(changes: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """seq, line: one JSON object for each change (seq, key, value, is_deleted and a timestamp in nanoseconds).

    A null value is written as the empty one; a null key or flag is an error.
    """
    operation = F.when(F.col("is_deleted"), "DELETE").when(~F.col("is_deleted"), "PUT").otherwise(F.raise_error(F.lit("a change without is_deleted")))
    key = F.coalesce("key", F.raise_error(F.lit("a change without key")).cast("string"))
    value = F.when(F.col("is_deleted"), F.lit("")).otherwise(F.coalesce("value", F.lit("")))
    line = F.concat(F.lit('{"operation":'), quoted(operation), F.lit(',"key":'), quoted(key), F.lit(',"value":'), quoted(value), F.lit(',"timestamp":'), F.coalesce(F.col(timestamp), F.lit(0)).cast("string"), F.lit("}"))
    return changes.select("seq", line.alias("line"))


def parsed(lines: DataFrame, *by: str) -> DataFrame:
    """``by``, pos, operation, key, value, timestamp, bad of lines (``by``, pos, line), blank ones passed over.

    A line is damaged (bad) if it is no JSON object or lacks one of the four fields. Each is parsed once: filters stay above the generator.
    """
    record = F.from_json("line", f"{WAL_RECORD}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    records = lines.where(F.col("line") != "").select(*by, "pos", F.inline(F.array(record)))
    bad = F.col("_corrupt").isNotNull()
    for name in ("operation", "key", "value", "timestamp"):
        bad = bad | F.col(name).isNull()
    return records.withColumn("bad", bad).drop("_corrupt")


def decode(lines: DataFrame, *by: str) -> DataFrame:
    """Records of the lines (``by``, pos, line) before the first damaged one: ``by``, pos, operation, key, value, timestamp.

    Lines after a damaged one are lost, as they may have been glued to it. Each line is parsed once; a log (``by``) is bounded by
    a write buffer and so can be looked at in one task. ``Store`` takes logs of any size.
    """
    torn = F.min(F.when(F.col("bad"), F.col("pos"))).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    marked = parsed(lines, *by).withColumn("torn", torn)
    return marked.where(F.col("torn").isNull() | (F.col("pos") < F.col("torn"))).drop("bad", "torn")


def changes_of(records: DataFrame, *by: str) -> DataFrame:
    """seq, key, value, is_deleted of decoded records; operations other than PUT and DELETE are ignored."""
    known = records.where(F.col("operation").isin("PUT", "DELETE"))
    deleted = F.col("operation") == "DELETE"
    return known.select(*by, F.col("pos").cast("bigint").alias("seq"), "key", F.when(deleted, F.lit("")).otherwise(F.col("value")).alias("value"), deleted.alias("is_deleted"))


def write(changes: DataFrame, path: str, timestamp: str = "timestamp", *, one_file: bool = True) -> None:
    """Append a log in order of ``seq`` as one text file, or as several in order of their numbers, so that no task writes it all."""
    ordered = encode(changes, timestamp).orderBy("seq")
    (ordered.coalesce(1) if one_file else ordered).select("line").write.mode("append").option("maxRecordsPerFile", 0).text(path)


#: Positions that a file of a batch has room for: those of a batch's first file are its line numbers.
FILE_LINES = 1 << 32


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """first, pos, line of logs of any size: files part-n, in order of n, in folders named by the log's first sequence number.

    Files are read by lines, in splits. A line's number in its file doesn't depend on how the file is split.
    """
    file = F.col("_metadata.file_path")
    first, part = F.regexp_extract(file, r"/(\d+)/part-[^/]*$", 1).cast("bigint"), F.regexp_extract(file, r"/part-(\d+)[^/]*$", 1).cast("bigint")
    text = spark.read.text(path, lineSep="\n")
    lines = text.select(first.alias("first"), part.alias("part"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    number = F.row_number().over(Window.partitionBy("first", "part").orderBy("split", "at")) - 1
    return lines.select("first", (F.col("part") * FILE_LINES + number).alias("pos"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, line of one log file, read whole, for the place of a line is what matters."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))


def recover(spark: SparkSession, path: str) -> DataFrame:
    """The changes of a log file up to the first damaged line; none if there is no such file."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        return spark.createDataFrame([], "seq bigint, key string, value string, is_deleted boolean")
    return changes_of(decode(read_lines(spark, path)))

