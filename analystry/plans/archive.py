"""Stored answer pages of a paginated blog -> a date-partitioned photo manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from analystry.functions import text as T
from analystry.session import cut_lineage

PAGE_SIZE = 50
POST_SCHEMA = ("`posts-total` long, posts array<struct<slug: string, type: string, `date-gmt`: string, "
               "`photo-url-1280`: string, photos: array<struct<`photo-url-1280`: string>>>>")

DAY = "concat_ws('-', year, month, day)"
MANIFEST = "slug string, url string, file string, year string, month string, day string"


def page_ranges(posts: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """(start): the first post number of every page needed to cover all posts."""
    return posts.sparkSession.range(0, posts.count(), size).withColumnRenamed("id", "start")


def missing_pages(pages: DataFrame, body: str, start: str, size: int = PAGE_SIZE) -> DataFrame:
    """(start) of pages that the stored answers announce but that are not stored."""
    total = pages.agg(F.max(T.parse_jsonp(F.col(body), POST_SCHEMA)["posts-total"])).first()[0]
    wanted = pages.sparkSession.range(0, total or 0, size).withColumnRenamed("id", start)
    return wanted.join(pages.select(start), start, "left_anti")


def posts_of(pages: DataFrame, body: str) -> DataFrame:
    """One row per post of the JSONP pages."""
    parsed = pages.select(T.parse_jsonp(F.col(body), POST_SCHEMA).alias("_p"))
    return parsed.select(F.explode("_p.posts").alias("post")).select("post.*")


def photos_of(posts: DataFrame) -> DataFrame:
    """(year, month, day, slug, place, url, file): the main photo of each post, in place 0, and the list of a photo post."""
    listed = F.when(F.col("type") == "photo", F.transform("photos", lambda p: p["photo-url-1280"]))
    urls = F.concat(F.array(F.col("`photo-url-1280`")), F.coalesce(listed, F.array().cast("array<string>")))
    rows = posts.select(*T.date_parts(F.col("`date-gmt`")), "slug", F.posexplode(urls).alias("place", "url"))
    return rows.where(F.col("url").isNotNull()).withColumn("file", T.url_file(F.col("url")))


def new_photos(photos: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Photos whose folder and file are not in the stored manifest, each once; of several URLs for a file the main photo's,
    then the first one listed.

    Of the manifest, which is partitioned by day, only the days of these photos are read.
    """
    folder = ["year", "month", "day", "slug", "file"]
    fresh = photos.groupBy(*folder).agg(F.min(F.struct("place", "url"))["url"].alias("url"))
    if stored is None:
        return fresh
    days = [r[0] for r in photos.select(F.expr(DAY)).distinct().collect()]  # bounded by the calendar
    return fresh.join(stored.where(F.expr(DAY).isin(days)).select(*folder), folder, "left_anti")


def write_manifest(photos: DataFrame, path: str) -> None:
    """Append below year/month/day folders."""
    photos.write.mode("append").partitionBy("year", "month", "day").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)


def archive(pages: DataFrame, body: str, path: str, stored: DataFrame | None = None) -> DataFrame:
    """Add what is new to the manifest at path and return posts and photos per day of the new part."""
    added = cut_lineage(new_photos(photos_of(posts_of(pages, body)), stored))
    write_manifest(added, path)
    return added.groupBy("year", "month", "day").agg(F.countDistinct("slug").alias("posts"), F.count(F.lit(1)).alias("photos"))
