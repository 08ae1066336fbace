"""Run logs: free text with one summary line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schema as S
from runlens.functions.scalars import safe_numeric
from runlens.sources.run_tables import path_component

FAILURE = r"^(Traceback \(most recent call last\)|[A-Za-z]*Error\b)"


def scan_log_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Log lines with their file and place in it.

    Files are read by line and may be split; the start of the split, then the
    order inside it, give a line's place.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .text(pattern)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("place"),
            F.col("value").alias("line"),
        )
    )


def scan_log_bundles(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of bundles: files of many logs, each line being a log's name, a tab and its text.

    As `scan_log_lines`, with the name as path.  A log may go on in another file; files
    follow each other by name.  A line without a tab belongs to no log.
    """
    lines = scan_log_lines(spark, pattern)
    name, text = F.split_part("line", F.lit("\t"), F.lit(1)), F.col("line").substr(F.instr("line", "\t") + 1, F.length("line"))
    place = F.struct(F.col("path").alias("file"), F.col("place.block"), F.col("place.line"))
    return lines.filter(F.contains("line", F.lit("\t"))).select(name.alias("path"), place.alias("place"), text.alias("line"))


def parsed_line(line: Column) -> Column:
    """(energy, seconds) of a summary line, null for any other line.

    A plain search comes first, so that most lines never meet the pattern.
    """
    return F.when(
        F.contains(line, F.lit("Energy consumption in joules: ")) & line.rlike(S.LOG_PATTERN),
        F.struct(
            safe_numeric(F.regexp_extract(line, S.LOG_PATTERN, 1)).alias("energy"),
            safe_numeric(F.regexp_extract(line, S.LOG_PATTERN, 2)).alias("seconds"),
        ),
    )


def keyword_line(line: Column) -> Column:
    """(energy, seconds) by keywords and splitting; unreadable numbers are null."""
    after = F.split_part(line, F.lit("Energy consumption in joules:"), F.lit(2))
    words = F.split(F.trim(after), r"\s+")
    return F.when(
        F.contains(line, F.lit("Energy consumption in joules:")),
        F.struct(
            safe_numeric(F.try_element_at(words, F.lit(1))).alias("energy"),
            F.when(
                F.contains(line, F.lit("sec of execution")),
                safe_numeric(F.try_element_at(words, F.array_position(words, "sec").cast("int") - 1)),
            ).alias("seconds"),
        ),
    )


def last_reading(lines: DataFrame, parser=parsed_line, keys=("path",)) -> DataFrame:
    """The last summary line of each log, with the failure flag.

    One aggregate with partial results per task; a log is never held whole.
    """
    reading = parser(F.col("line"))
    return (
        lines.select(*keys, "place", reading.alias("r"), F.col("line").rlike(FAILURE).alias("bad"))
        .groupBy(*keys)
        .agg(
            F.max_by("r", F.when(F.col("r").isNotNull(), F.col("place"))).alias("r"),
            F.coalesce(F.bool_or("bad"), F.lit(False)).alias("failed"),
        )
        .select(
            *keys,
            F.col("r.energy").alias("energy_joules_log"),
            F.col("r.seconds").alias("exec_time_sec_log"),
            "failed",
        )
    )


def parse_run_log(spark: SparkSession, pattern: str, scan=scan_log_lines) -> DataFrame:
    """(path, energy, seconds, failed) of every log under a glob; ``scan`` tells one log a file from bundles."""
    return last_reading(scan(spark, pattern))


def parse_run_log_keyword(spark: SparkSession, pattern: str, scan=scan_log_lines) -> DataFrame:
    return last_reading(scan(spark, pattern), keyword_line)


def failed_run_flag(lines: DataFrame, keys=("path",)) -> DataFrame:
    """Logs that show an interpreter or compiler error (an added check)."""
    return last_reading(lines, keys=keys).select(*keys, "failed")


def keyed_by_run(parsed: DataFrame, set_depth: int = 4, run_depth: int = 2) -> DataFrame:
    """Replace the log's path by the (results_set, run_id) found in it."""
    return parsed.withColumns(
        {
            "results_set": path_component(F.col("path"), set_depth),
            "run_id": path_component(F.col("path"), run_depth),
        }
    )
