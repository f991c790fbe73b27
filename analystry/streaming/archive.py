"""The archive job as a stream: pages that arrive as files are handled once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from analystry.plans.archive import MANIFEST, new_photos, photos_of, posts_of, read_manifest, write_manifest
from analystry.session import cut_lineage
from analystry.sources.files import file_contents, listed_files, local_folder


def archive_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> DataFrame:
    """Read every new page file below source, add photos that target lacks, stop, and return the manifest.

    The manifest itself says what is stored, so no growing state is kept, posts may arrive in any
    order, and a batch that runs again after a failure adds nothing twice.

    Spark's file source lists and remembers every file in the driver. Of a local or mounted folder, tasks therefore list the files, the
    names not seen before are added to a table below the checkpoint, and the stream follows that table; its batches read the pages.
    """
    write_manifest(spark.createDataFrame([], MANIFEST), target)  # lets the first batch read it
    place = local_folder(spark, source)

    def add(batch: DataFrame, _number: int) -> None:
        if place is not None:
            batch = file_contents(batch).select(F.col("content").cast("string").alias("value"))
        photos = photos_of(posts_of(batch, "value")).persist()  # both the days and the new photos need them
        try:
            write_manifest(new_photos(photos, read_manifest(batch.sparkSession, target)), target)
        finally:
            photos.unpersist()

    if place is None:
        pages = spark.readStream.schema("value string").option("wholetext", "true").text(source)
    else:
        names = f"{checkpoint.rstrip('/')}/pages"
        spark.createDataFrame([], "path string").write.mode("append").parquet(names)  # lets the first run read it
        fresh = listed_files(spark, place, within="=").join(spark.read.schema("path string").parquet(names), "path", "left_anti")
        cut_lineage(fresh).write.mode("append").parquet(names)
        pages, checkpoint = spark.readStream.schema("path string").parquet(names), f"{checkpoint.rstrip('/')}/stream"
    running = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return read_manifest(spark, target)
