"""Log files in their format, the archive stream when it is cut off, rules on capitals."""

import os

import pytest
from pyspark.sql import functions as F

from huegrain.catalog import keyword_exclusion
from huegrain.functions import text as T
from huegrain.sources import logs
from huegrain.streaming.archives import append_archives

LOG = """Archive ID: 4711
4711-1-9-1-77: no masks
4711-2-9-1-77: Skipping because no garment detection found.
4711-3-9-1-77: no masksX
4711-3-9-1-77: file not found: /x/y.png
4711-1-9-1-77: success (seg_id 5)
4711-4-9-1-77: processed SUCCESSFULLY
4711-5-9-1-77: No keyword match
4711-5-9-1-77: skipping because no keyword was there  \t
bad-6-9: no masks
4711: exception
4711-7: exception in a: b
4711-8-1 no masks
4711-9-9-1-77: SUCCESS (seg_id 5)
4711-10-9-1-77: bad filename format
a: 4711-11: no masks
"""


def write(root, archive, run, text, name="processing_log.txt", age=0):
    path = root / archive / run / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def test_log_files(spark, tmp_path):
    pre = logs.RUN_PREFIX
    write(tmp_path, "BR_mens_coats_4711_20240101", pre + "20240301", LOG, age=10)
    write(tmp_path, "BR_mens_coats_4711_20240101", pre + "20240201", "Archive ID: 4711\n4711-1-9: no garment detection\n", age=99)
    write(tmp_path, "BR_mens_coats_4711_20240101", "other_20250101", "Archive ID: 4711\n4711-1-9: exception\n", age=500)
    write(tmp_path, "BR_womens_12_20240101", pre + "1", "\n", age=5)
    write(tmp_path, "BR_womens_12_20240101", pre + "2", "", age=6)  # no log
    write(tmp_path, "short_1", pre + "1", "nothing\nArchive ID: 3\n")
    write(tmp_path, "BR_womens_13_20240101", pre + "1", "Archive ID: 13\n", name="notes.md")
    lines = logs.read_logs(spark, f"file://{tmp_path}")
    latest = logs.latest_runs(lines).cache()
    assert {(r.archive_dir, r.run_dir) for r in latest.collect()} == {("BR_mens_coats_4711_20240101", pre + "20240301"), ("BR_womens_12_20240101", pre + "1"), ("short_1", pre + "1")}
    newest = logs.latest_runs(lines, by_time=True).filter("archive_dir like '%4711%'").select("run_dir").distinct().collect()
    assert [r.run_dir for r in newest] == [pre + "20240201"]
    got = {r.instance_id: r.reason for r in logs.parse(latest).collect()}
    assert got == {1: "yolo_no_masks", 2: "yolo_no_garment", 3: "yolo_file_not_found", 4: "segmented", 5: "keyword_map_miss", 7: "yolo_other", 10: "yolo_other"}
    assert [r.archive_id for r in logs.header_archive(latest).collect()] == [4711]
    folders = {r.archive_dir: (r.brand, r.query, r.archive_id, r.stamp) for r in logs.archives_of_folders(latest.select("archive_dir").distinct()).collect()}
    assert folders == {"BR_mens_coats_4711_20240101": ("BR", "mens_coats", 4711, "20240101"), "BR_womens_12_20240101": ("BR", "womens", 12, "20240101"), "short_1": (None, None, None, None)}


def test_written_logs_are_read_again(spark, tmp_path):
    rows = [(f"B_q q_{i % 3}_2024", f"{logs.RUN_PREFIX}{i % 2}", i, f"{i % 3}-{i}-x: no masks é") for i in range(60)]
    df = spark.createDataFrame(rows, "archive_dir string, run_dir string, line_no long, line string").repartition(5)
    lines = logs.read_logs(spark, logs.write_logs(df, f"file://{tmp_path}/logs"))
    back = sorted((r.archive_dir, r.run_dir, r.line_no, r.line) for r in lines.filter("line <> ''").collect())
    want = {}
    for archive, run, _, line in rows:
        want.setdefault((archive, run), []).append(line)
    assert back == sorted((*k, i, line) for k, said in want.items() for i, line in enumerate(said))


def test_a_stream_that_is_cut_off_and_repeated(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 7).alias("archive_id"), "id", (F.col("id") % 5).alias("part"))
    df.repartition("part").write.partitionBy("part").parquet(f"{tmp_path}/arrived")
    schema = "archive_id long, id long, part long"
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schema)
    place = lambda name: (f"{tmp_path}/arrived", schema, f"{tmp_path}/{name}/held", f"{tmp_path}/{name}/checkpoint")
    append_archives(spark, *place("once"), files_a_batch=1)

    def fail(number):
        if number == 2:
            raise RuntimeError("cut off")

    with pytest.raises(Exception, match="cut off"):
        append_archives(spark, *place("twice"), files_a_batch=1, before_commit=fail)
    part = spark.read.parquet(f"{tmp_path}/twice/held")
    assert part.select("batch").distinct().count() == 3  # the third was written, and not noted
    for _ in range(2):
        append_archives(spark, *place("twice"), files_a_batch=1)
    told = [sorted((r.archive_id, r.id, r.part) for r in spark.read.parquet(f"{tmp_path}/{name}/held").collect()) for name in ("once", "twice")]
    assert told[0] == told[1] == sorted((i % 7, i, i % 5) for i in range(200))
    spark.createDataFrame([(9, 999)], "archive_id long, id long").write.parquet(f"{tmp_path}/arrived/part=9")
    append_archives(spark, *place("twice"))
    assert spark.read.parquet(f"{tmp_path}/twice/held").filter("archive_id = 9").count() == 1


def test_genders_of_capitals(spark):
    df = spark.createDataFrame([("Mens Clothing",), ("WOMENS",), ("Women tops",), ("kids",), (None,), ("Men",)], "query string")
    got = [tuple(r) for r in df.select(F.expr(T.GENDER_STRICT), F.expr(T.GENDER_LOOSE)).collect()]
    assert got == [("mens", "mens"), ("womens", "womens"), (None, "womens"), (None, None), (None, None), (None, "mens")]


def test_both_titles_are_searched(spark):
    rows = keyword_exclusion(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.field in ("title", "title_second") and r.keyword for r in rows)
