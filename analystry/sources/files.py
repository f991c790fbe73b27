"""Delimited text, JSON, folders of texts, encoded pages."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from analystry.session import cut_lineage, scratch_path


def read_delimited(spark: SparkSession, path: str, sep: str, schema: str) -> DataFrame:
    """Delimited text with a header line, typed by the given schema."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, encoding="UTF-8")


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    df.write.option("sep", sep).option("header", True).option("encoding", "UTF-8").csv(path)


def read_json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array; its elements become rows."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json_arrays(df: DataFrame, path: str, block: Column) -> None:
    """One JSON array file per block; keep blocks small, for each is built in one task."""
    arrays = df.groupBy(block.alias("_block")).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


PROBLEM_LIST = "`problem-name` string, language string, encoding string"
PROBLEM_HEADER = "`unknown-folder` string, `candidate-authors` array<struct<`author-name`: string>>"


def read_problem_list(spark: SparkSession, path: str) -> DataFrame:
    """(problem, language, encoding) of a collection."""
    return read_json_arrays(spark, path, PROBLEM_LIST).select(
        F.col("`problem-name`").alias("problem"), "language", "encoding")


def parse_problem_header(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., unknown_folder, author): one row per candidate author."""
    parsed = df.select(*keep, F.from_json(column, PROBLEM_HEADER).alias("_h"))
    authors = parsed.select(*keep, F.col("_h.`unknown-folder`").alias("unknown_folder"),
                            F.explode("_h.`candidate-authors`").alias("_a"))
    return authors.select(*keep, "unknown_folder", F.col("_a.`author-name`").alias("author"))


def read_problem_headers(spark: SparkSession, path: str) -> DataFrame:
    """(problem, unknown_folder, author) from every problem-info.json below path."""
    files = (spark.read.schema(PROBLEM_HEADER)
             .json(path, multiLine=True, pathGlobFilter="problem-info.json", recursiveFileLookup=True))
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = files.select(F.element_at(parts, -2).alias("problem"), F.col("`unknown-folder`").alias("unknown_folder"),
                        F.explode("`candidate-authors`").alias("_a"))
    return rows.select("problem", "unknown_folder", F.col("_a.`author-name`").alias("author"))


#: How Spark names the folder of rows without a value.
NO_PROBLEM = "__HIVE_DEFAULT_PARTITION__"
#: Characters that Spark escapes in the names of such folders.
ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def write_labelled_texts(df: DataFrame, path: str, folders: Sequence[str], text: str = "text") -> None:
    """One *.txt file per row, its text and a line end, in folders named `column=value` as Spark names them.

    Hadoop's local file system starts a process for every file that it makes, to set its mode. On a local (or mounted) folder each
    task therefore writes the files itself, below a folder of its own; folders of attempts that did not finish are removed. Other
    stores are written by Spark.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        df.select(*folders, text).write.option("maxRecordsPerFile", 1).partitionBy(*folders).text(path)
        return
    place = store.makeQualified(target).toUri().getPath()
    os.makedirs(place)
    names = list(folders)

    def write(batches):
        context, made, n = TaskContext.get(), set(), 0
        mine = f"texts-{context.partitionId():05d}-{context.taskAttemptId()}"
        for batch in batches:
            for *values, content in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                parts = [f"{name}={ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', v) if v else NO_PROBLEM}" for name, v in zip(names, values)]
                folder = os.path.join(place, mine, *parts)
                if folder not in made:
                    os.makedirs(folder)
                    made.add(folder)
                with open(os.path.join(folder, f"part-{n:07d}.txt"), "wb") as f:
                    f.write((content or b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"folder": [mine]})

    rows = df.select(*[F.col(c).cast("string").alias(c) for c in names], F.col(text).cast("binary"))
    done = {r["folder"] for r in rows.mapInArrow(write, "folder string").collect()}
    for left in set(os.listdir(place)) - done:
        shutil.rmtree(os.path.join(place, left), ignore_errors=True)


#: Texts that a task reads, and bytes of texts that it hands on at once.
TASK_TEXTS, BATCH_BYTES = 4096, 16 << 20


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The place of a folder on a local or mounted disk; None in other stores and for patterns."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    place = store.makeQualified(target).toUri().getPath()
    return place if store.getUri().getScheme() == "file" and os.path.isdir(place) else None


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def listed_files(spark: SparkSession, place: str, ending: str = "", within: str = "") -> DataFrame:
    """(path) of the files of a local or mounted folder, and of the folders in it whose names hold `within`, whose names have the ending.

    Tasks list the folders. The driver holds no names: it goes down one level of folders at a time, and only sees how many there are.
    """
    tasks = spark.sparkContext.defaultParallelism

    def below(batches):
        for batch in batches:
            for top in batch.column(0).to_pylist():
                with os.scandir(top) as found:
                    inner = [e.path for e in found if within in e.name and not _hidden(e.name) and e.is_dir()]
                yield pa.RecordBatch.from_pydict({"path": pa.array(inner, pa.string())})

    def files(batches):
        for batch in batches:
            for top in batch.column(0).to_pylist():
                some = []
                with os.scandir(top) as found:
                    for e in found:
                        if e.name.endswith(ending) and not _hidden(e.name) and e.is_file():
                            some.append(e.path)
                        if len(some) == TASK_TEXTS:
                            yield pa.RecordBatch.from_pydict({"path": pa.array(some, pa.string())})
                            some = []
                yield pa.RecordBatch.from_pydict({"path": pa.array(some, pa.string())})

    level = spark.createDataFrame([(place,)], "path string")
    folders, some = level, 1
    while some:
        level = cut_lineage(level.repartition(min(some, 4 * tasks)).mapInArrow(below, "path string"))
        folders, some = folders.unionByName(level), level.count()
    return cut_lineage(folders.repartition(4 * tasks).mapInArrow(files, "path string"))


def file_contents(names: DataFrame) -> DataFrame:
    """(path, content) of the files in `path` that are not empty, read by tasks of at most about TASK_TEXTS files."""
    def read(batches):
        for batch in batches:
            paths, contents, held = [], [], 0
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    content = f.read()
                if not content:
                    continue
                paths.append(path)
                contents.append(content)
                held += len(content)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})
                    paths, contents, held = [], [], 0
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})

    tasks = max(names.sparkSession.sparkContext.defaultParallelism, -(-names.count() // TASK_TEXTS))
    return names.select("path").repartition(tasks).mapInArrow(read, "path string, content binary")


def read_labelled_texts(spark: SparkSession, path: str) -> DataFrame:
    """(problem, label, filename, text) of every *.txt below path; the folders give problem and label.

    On a local or mounted folder the tasks list and read the files, for Spark's readers list every file in the driver.
    """
    place = local_folder(spark, path)
    if place is not None:
        files = file_contents(listed_files(spark, place, ".txt")).select("path", F.col("content").cast("string").alias("value"))
        parts = F.split("path", "/")
        # a plus sign is a blank, as it is when the name is read from the address of a file
        folder = lambda depth: F.translate(F.regexp_replace(F.element_at(parts, depth), "^[^=]*=", ""), "+", " ")
        return files.select(folder(-3).alias("problem"), folder(-2).alias("label"), F.element_at(parts, -1).alias("filename"), F.col("value").alias("text"))
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    folder = lambda depth: F.url_decode(F.regexp_replace(F.element_at(parts, depth), "^[^=]*=", ""))
    return files.select(folder(-3).alias("problem"), folder(-2).alias("label"),
                        F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(words): one sentence per line, split at white space; blank lines are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(F.length("line") > 0)
    return lines.select(F.split("line", r"\s+").alias("words"))


def decode_page(content: Column) -> Column:
    """Bytes as text: UTF-8 if they are valid UTF-8, else Latin-1."""
    return (F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
            .otherwise(F.decode(content, "ISO-8859-1")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every stored page."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", decode_page(F.col("content")).alias("text"))


def write_answers(df: DataFrame, path: str) -> None:
    """(problem, unknown-text, predicted-author): one file `answers-<problem>.json` per problem, an array of objects by text.

    Each problem's rows are sorted and written as a stream by one task, since they are one file; problems are spread over all tasks.
    The files appear in `path`, replacing those of the same problems, only when all are written. Slashes in names are escaped; rows
    without a problem go to `answers-.json`; a table without rows gives an empty folder.
    """
    spark, staged = df.sparkSession, scratch_path(df.sparkSession, "answers")
    order = Window.partitionBy("problem").orderBy("unknown-text", "predicted-author")
    line = F.to_json(F.struct("unknown-text", "predicted-author"), {"ignoreNullFields": "false"})
    rows = df.select("problem", F.when(F.row_number().over(order) == 1, "[").otherwise(" ").alias("head"), line.alias("line"),
                     F.when(F.lead(F.lit(1)).over(order).isNull(), "]").otherwise(",").alias("tail"))
    rows.select("problem", F.concat("head", "line", "tail").alias("value")).write.partitionBy("problem").text(staged)
    java, settings = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, target = java.Path(staged), java.Path(path)
    files = source.getFileSystem(settings)
    to = target.getFileSystem(settings)
    to.mkdirs(target)
    for folder in files.listStatus(source):
        name = folder.getPath().getName()
        if name.startswith("problem="):
            [part] = [f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            problem = "" if name.endswith(NO_PROBLEM) else unquote(name[8:]).replace("/", "%2F")
            java.FileUtil.copy(files, part, to, java.Path(target, f"answers-{problem}.json"), True, True, settings)
    files.delete(source, True)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(unknown-text, predicted-author, problem) of a folder of answer files."""
    rows = spark.read.schema("`unknown-text` string, `predicted-author` string").option("multiLine", True).json(f"{path}/answers-*.json")
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/answers-([^/]*)\.json$", 1))
    return rows.withColumn("problem", F.nullif(F.replace(name, F.lit("%2F"), F.lit("/")), F.lit("")))


def load_labelled(df: DataFrame, key: str, subset: str = "all", test_percent: int = 33, seed: int = 0,
                  modulo: bool = False) -> DataFrame:
    """Rows of the train or test subset, decided by the row's own key.

    Unlike a random split this does not change with the partitioning. `modulo` splits on
    key % 100 instead of a hash.
    """
    digits = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 10)
    slot = F.pmod(F.col(key) if modulo else F.conv(digits, 16, 10).cast("long"), F.lit(100))
    if subset == "test":
        return df.where(slot < test_percent)
    if subset == "train":
        return df.where(slot >= test_percent)
    return df
