"""Processing logs as text files: IMAGES/BRAND_query_archive_time/fpyolo..._time/processing_log.txt, one log a run of an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

E = F.expr

# The phrases of the log's format in its order, the reason that each gives, and whether its case counts. The first that fits counts.
PHRASES = [
    (r"no masks\b", "yolo_no_masks", True),
    (r"Skipping because no masks", "yolo_no_masks", False),
    (r"no keyword match\b", "keyword_map_miss", True),
    (r"Skipping because no keyword", "keyword_map_miss", False),
    (r"no garment detection\b", "yolo_no_garment", True),
    (r"Skipping because no garment", "yolo_no_garment", False),
    (r"file not found\b", "yolo_file_not_found", True),
    (r"bad filename format\b", "yolo_other", True),
    (r"exception\b", "yolo_other", True),
    (r"success \(seg_id", "segmented", True),
    (r"Processed successfully", "segmented", False),
]
RUN_PREFIX = "fpyolo11l241114_"


def write_logs(lines: DataFrame, root: str) -> str:
    """Lines (archive_dir, run_dir, line_no, line) as text files, one a run; a run's lines stay in order."""
    one = lines.repartition("archive_dir", "run_dir").sortWithinPartitions("archive_dir", "run_dir", "line_no")
    one.select("archive_dir", "run_dir", F.col("line").alias("value")).write.partitionBy("archive_dir", "run_dir").mode("append").text(root)
    return root


def read_logs(spark: SparkSession, root: str, name: str = "*.txt") -> DataFrame:
    """(path, archive_dir, run_dir, modified, line_no, line) of all logs under ``root``; a log is read whole, as it is one archive's.

    Folders may be plain or of the form key=value. The file's time of modification comes from the file system. Lines lose white space behind
    them, and number 0 is the header. Spark passes over files without a byte: such a log is no log, and the run before it is the latest."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    part = lambda at: F.regexp_replace(F.element_at("parts", at), "^[a-z_]+=", "")
    found = files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")).withColumn("parts", F.split(F.url_decode("path"), "/"))
    return found.select("path", part(-3).alias("archive_dir"), part(-2).alias("run_dir"), "modified", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"\s+$", ""))


def archives_of_folders(runs: DataFrame) -> DataFrame:
    """``runs`` with brand, query, archive_id and stamp of folders BRAND_query_archive_time; others have nulls. The query may hold underscores."""
    parts = F.split("archive_dir", "_")
    known = F.size(parts) >= 4
    return runs.withColumn("brand", F.when(known, parts[0])).withColumn("query", F.when(known, F.array_join(F.slice(parts, 2, F.size(parts) - 3), "_"))).withColumn("archive_id", F.when(known, F.element_at(parts, -2).try_cast("bigint"))).withColumn("stamp", F.when(known, F.element_at(parts, -1)))


def latest_runs(lines: DataFrame, by_time: bool = False, prefix: str = RUN_PREFIX) -> DataFrame:
    """The lines of each archive folder's latest run: the largest name, or the last modification (then the largest name)."""
    runs = lines.filter(F.col("run_dir").startswith(prefix)).groupBy("archive_dir", "run_dir").agg(F.max("modified").alias("at"))
    order = F.struct("at", "run_dir") if by_time else F.col("run_dir")
    return lines.join(runs.groupBy("archive_dir").agg(F.max_by("run_dir", order).alias("run_dir")), ["archive_dir", "run_dir"], "left_semi")


def header_archive(lines: DataFrame) -> DataFrame:
    """(path, archive_id): what the first line of a log says, ``Archive ID: N``; logs without it are left out."""
    said = E(r"try_cast(regexp_extract(line, '^\\s*Archive ID:\\s*([0-9]+)', 1) AS bigint)")
    return lines.filter("line_no = 0").select("path", said.alias("archive_id")).filter("archive_id IS NOT NULL")


def parse(lines: DataFrame) -> DataFrame:
    """(path, instance_id, reason): of each instance the first line that a phrase fits. A line begins with a file name up to its first colon, whose
    parts archive-instance-... are numbers; other lines say nothing."""
    reason = F.lit(None).cast("string")
    for phrase, name, case in reversed(PHRASES):
        reason = F.when(F.col("line").rlike(("" if case else "(?i)") + "^[^:]+: " + phrase), name).otherwise(reason)
    instance = E(r"try_cast(regexp_extract(line, '^\\s*[0-9]+\\s*-\\s*([0-9]+)\\s*(-[^:]*)?:', 1) AS bigint)")
    said = lines.select("path", "line_no", reason.alias("reason"), instance.alias("instance_id")).filter("reason IS NOT NULL AND instance_id IS NOT NULL")
    return said.groupBy("path", "instance_id").agg(F.min_by("reason", "line_no").alias("reason"))
