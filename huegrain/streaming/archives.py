"""Archives that arrive as files, appended once each: a file stream that takes what is there and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append_archives(spark: SparkSession, arrived: str, schema: StructType, held: str, checkpoint: str, by: str = "archive_id", files_a_batch: int = 100, before_commit=None) -> None:
    """Append the rows of all files under ``arrived`` that ``checkpoint`` does not know to the table ``held``, in batches of files.

    Each batch writes its own folder ``batch=N`` in overwrite mode, so that a batch which was written before the run was cut off, but not noted in
    the checkpoint, is written again in the same place: a run that is cut off and repeated leaves the table of one run. A later file may
    hold more rows of an archive that is held; rows are not compared. ``before_commit`` is called when a batch is written (for tests).
    An empty folder gives an empty table."""

    def one(batch: DataFrame, number: int) -> None:
        batch.repartition(F.col(by)).write.mode("overwrite").parquet(f"{held}/batch={number}")
        if before_commit:
            before_commit(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(arrived)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
