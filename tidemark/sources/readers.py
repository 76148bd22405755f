"""Readers: Parquet tables, text corpora, index files, feeds, lexicons, fingerprints."""

from __future__ import annotations

import json
import os
import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import zero_fill
from tidemark.sources.sinks import PRICE_BUCKET, price_bucket


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet with an optional explicit schema; a missing path raises."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_prices(spark: SparkSession, path: str, ticker: str | None = None,
                start: date | None = None, end: date | None = None) -> DataFrame:
    """Bars of a ticker and an inclusive date range; the predicates reach the
    scan (pruning of the ticker's folder, row-group pushdown on ``ticker`` and ``date``)."""
    df = spark.read.parquet(path)
    folders = PRICE_BUCKET in df.columns
    if ticker:
        df = df.filter(F.col("ticker") == ticker)
        if folders:
            df = df.filter(F.col(PRICE_BUCKET) == price_bucket(F.lit(ticker)))
    if start:
        df = df.filter(F.col("date") >= F.lit(start))
    if end:
        df = df.filter(F.col("date") <= F.lit(end))
    return df.drop(PRICE_BUCKET)


def read_news(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Bytes and files that a reading task hands on at once.
SLICE_BYTES, SLICE_FILES = 16 << 20, 1000


def _folder(spark: SparkSession, root: str):
    """(file system, base path, the base as Spark spells it) of a folder that tasks can list
    by themselves; None: a file, a pattern, a missing path or an unknown file system."""
    import pyarrow as pa
    from pyarrow import fs

    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        root = f"file:{os.path.abspath(root)}" if default.startswith("file:") else default.rstrip("/") + root
    try:
        if root.startswith("file:"):
            base = os.path.normpath("/" + root.removeprefix("file:").lstrip("/"))
            files, spelled = fs.LocalFileSystem(), f"file:{base}"
        else:
            files, base = fs.FileSystem.from_uri(root)
            spelled = root.rstrip("/")
        return (files, base, spelled) if files.get_file_info(base).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError, ValueError):
        return None


def whole_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, file_path, length, content) of every file below ``root`` whose name matches ``glob``:
    the rows that Spark's ``binaryFile`` source finds (no hidden and no empty files), ``file_path``
    being the path as ``_metadata`` spells it.

    That source lists all files into the driver.  Here tasks list the folders and read the files, so the
    driver holds no name: one task lists ``root`` itself, every folder in it is walked by one
    task, and the files are dealt out over the shuffle partitions.  What tasks cannot list goes through
    Spark's source."""
    found = None if re.search(r"[\[\]{}\\]", glob) else _folder(spark, root)
    if found is None:
        df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", glob).load(root))
        return df.select("path", F.col("_metadata.file_path").alias("file_path"), "length", "content")
    files, base, spelled = found
    most_bytes, most_files = SLICE_BYTES, SLICE_FILES
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def inside(folder):
        """(folders, files) of a folder, as Spark sees them."""
        from fnmatch import fnmatchcase

        from pyarrow import fs

        dirs, names = [], []
        for f in files.get_file_info(fs.FileSelector(folder)):
            hidden = (f.base_name.startswith("_") and "=" not in f.base_name) or f.base_name.startswith(".") or \
                f.base_name.endswith("._COPYING_")
            if f.type == fs.FileType.Directory:
                if not hidden or f.base_name.startswith(("_metadata", "_common_metadata")):
                    dirs.append(f.path)
            elif f.size and not hidden and fnmatchcase(f.base_name, glob):
                names.append(f.path)
        return dirs, names

    def batch_of(dirs, names):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(dirs + names, pa.string()),
                                           pa.array([True] * len(dirs) + [False] * len(names), pa.bool_())], ["at", "folder"])

    def first(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                yield batch_of(*inside(at))

    def walked(batches):
        for batch in batches:
            for at, folder in zip(*(c.to_pylist() for c in batch.columns)):
                if not folder:
                    yield batch_of([], [at])
                    continue
                left = [at]
                while left:
                    dirs, names = inside(left.pop())
                    left += dirs
                    yield batch_of([], names)

    def read(batches):
        from urllib.parse import quote

        import pyarrow as pa

        def rows(held):
            paths = [spelled + at[len(base):] for at, _ in held]
            urls = ["".join(c if ord(c) > 127 else quote(c, safe="/~!@$&*()_+-=:;',.") for c in p) for p in paths]
            return pa.RecordBatch.from_arrays([
                pa.array(paths, pa.string()), pa.array(urls, pa.string()),
                pa.array([len(b) for _, b in held], pa.int64()), pa.array([b for _, b in held], pa.binary())],
                ["path", "file_path", "length", "content"])

        held, size = [], 0
        for batch in batches:
            for at in batch.column(0).to_pylist():
                with files.open_input_stream(at, compression=None) as f:
                    content = f.read()
                if held and (size + len(content) > most_bytes or len(held) >= most_files):
                    yield rows(held)
                    held, size = [], 0
                held.append((at, content))
                size += len(content)
        if held:
            yield rows(held)

    listed = "at string, folder boolean"
    top = spark.createDataFrame([(base,)], "at string").coalesce(1).mapInArrow(first, listed)
    named = top.repartition(parts).mapInArrow(walked, listed)
    return named.select("at").repartition(parts).mapInArrow(
        read, "path string, file_path string, length bigint, content binary")


def read_filing_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.txt`` below ``root`` as one row (whole file), with CIK and
    accession cut from the path ``…/<cik>/<accession>.txt``."""
    path = F.col("file_path")
    return whole_files(spark, root, "*.txt").select(
        path,
        F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"),
        zero_fill(F.regexp_extract(path, r"/([0-9]+)/[^/]+$", 1), 10).alias("cik"),
        F.regexp_extract(path, r"([^/]+)\.txt$", 1).alias("accession"),
        F.col("content").cast("string").alias("raw"),
    )


def read_index_files(spark: SparkSession, path: str) -> DataFrame:
    """Index files → (file_path, pos, line).  Each file is read whole so line
    positions are exact; daily index files are small, and files are spread
    over tasks."""
    df = spark.read.text(path, wholetext=True)
    return (df.select(F.col("_metadata.file_path").alias("file_path"),
                      F.posexplode(F.split(F.col("value"), r"\r?\n")).alias("pos", "line")))


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    """Daily company-index files → index rows, one pass per file (each file is
    read whole and parsed inside its own row: no shuffle)."""
    from tidemark.operators.filings import parse_index_text

    df = spark.read.text(path, wholetext=True)
    return parse_index_text(df.select(F.col("_metadata.file_path").alias("file_path"), "value"))


FEED_ITEM_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("link", T.StringType()), T.StructField("pubDate", T.StringType()),
])


def read_feed_items(spark: SparkSession, path: str, source: str, collected_at) -> DataFrame:
    """Staged RSS ``<item>`` elements (Spark's XML source) → article rows.

    Missing fields become '', the publication date falls back to the
    collection time, the feed position is kept for first-seen ordering."""
    raw = (spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM_SCHEMA).load(path))
    # RFC 822 dates; the weekday name is dropped first (Spark 3+ parsers
    # reject day-of-week letters in a parse pattern)
    rfc = F.regexp_replace(F.trim(F.col("pubDate")), r"^[A-Za-z]{3},\s*", "")
    ts = F.coalesce(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")),
                    F.try_to_timestamp(F.col("pubDate")), F.lit(collected_at))
    return raw.select(
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("summary"),
        F.coalesce("link", F.lit("")).alias("link"),
        F.coalesce("pubDate", F.lit("")).alias("published"),
        F.lit(source).alias("source"),
        F.lit(str(collected_at)).alias("collected_at"),
        ts.alias("published_date"),
        F.monotonically_increasing_id().alias("feed_pos"),
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """JSON object aspect → [terms] as a long (aspect, term) table."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), "map<string,array<string>>")
    return (raw.select(F.explode(m).alias("aspect", "terms"))
            .select("aspect", F.explode("terms").alias("term")))


def write_lexicon(spark: SparkSession, lexicon: dict, path: str) -> None:
    """The lexicon is a small parameter: one JSON document written through
    Spark (so it lands on the cluster's shared storage), read back whole by
    ``read_lexicon``."""
    doc = spark.createDataFrame([(json.dumps(lexicon, indent=2),)], "value string")
    doc.coalesce(1).write.mode("overwrite").text(path)


def file_fingerprints(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """SHA-256 of every file's bytes."""
    return whole_files(spark, root, glob).select("path", "length", F.sha2(F.col("content"), 256).alias("sha256"))
