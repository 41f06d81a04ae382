"""Scripts of PUT, GET and DEL lines, answered line by line in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_line import trimmed
from ..operators.lookup import asof_get
from ..schema import ABSENT, DELETED

#: What a shell prints.
OK, NIL, MARKED, BYE = "OK", "(nil)", "(error) Key marked as deleted", "Bye!"
USAGE_PUT, USAGE_GET, USAGE_DEL = "(error) Usage: PUT <key> <val>", "(error) Usage: GET <key>", "(error) Usage: DEL <key>"
UNKNOWN = "(error) Unknown command: "


def parsed(lines: DataFrame) -> DataFrame:
    """seq, verb, word, key, value of script lines (seq, line); blank lines, and all from EXIT or QUIT on, are left out.

    Verbs are read in any case, keys are not; a value is the rest of its line, without blanks at either side.
    """
    text = lines.withColumn("text", trimmed(F.col("line"))).where("text <> ''")
    parts = text.select(
        "seq", F.regexp_extract("text", r"^(\S+)", 1).alias("word"), F.regexp_extract("text", r"^\S+\s+(\S+)", 1).alias("key"),
        trimmed(F.regexp_extract("text", r"(?s)^\S+\s+\S+(.*)$", 1)).alias("value"),
    )
    named = parts.withColumn("verb", F.upper("word")).withColumn("verb", F.when(F.col("verb") == "DEL", "DELETE").otherwise(F.col("verb")))
    end = ended(named)
    return named.join(F.broadcast(end)).where(F.col("end").isNull() | (F.col("seq") < F.col("end"))).drop("end")


def ended(commands: DataFrame) -> DataFrame:
    """end: where the first EXIT or QUIT stands, null without one."""
    return commands.where(F.col("verb").isin("EXIT", "QUIT")).agg(F.min("seq").alias("end"))


def answers(lines: DataFrame) -> DataFrame:
    """seq, output: what each line of a script prints, EXIT or QUIT included. A GET sees the writes above it."""
    commands = parsed(lines)
    valid = (F.col("key") != "") & ((F.col("verb") != "PUT") | (F.col("value") != ""))
    known = F.col("verb").isin("PUT", "GET", "DELETE")
    run = commands.where(known & valid)
    shown = F.when(F.col("status") == ABSENT, NIL).when(F.col("status") == DELETED, MARKED).otherwise(F.concat(F.lit('"'), F.col("value"), F.lit('"')))
    reads = asof_get(run).select("seq", shown.alias("output"))
    writes = run.where("verb <> 'GET'").select("seq", F.lit(OK).alias("output"))
    usage = F.when(F.col("verb") == "PUT", USAGE_PUT).when(F.col("verb") == "GET", USAGE_GET).otherwise(USAGE_DEL)
    wrong = commands.where(known & ~valid).select("seq", usage.alias("output"))
    unknown = commands.where(~known).select("seq", F.concat(F.lit(UNKNOWN), F.col("word")).alias("output"))
    verbs = lines.select("seq", F.upper(F.regexp_extract(trimmed(F.col("line")), r"^(\S+)", 1)).alias("verb"))
    bye = ended(verbs).where("end IS NOT NULL").select(F.col("end").alias("seq"), F.lit(BYE).alias("output"))
    return reads.unionByName(writes).unionByName(wrong).unionByName(unknown).unionByName(bye)
