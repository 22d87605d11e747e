"""Documents from files, object stores and tables, and tables written back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.operators.collectors import KnowledgeBase

#: Extensions that count as documents.
EXTENSIONS = ["md", "markdown", "mdx", "txt", "rst"]


def read_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(uri, text) of the documents below a folder or bucket prefix, local or not, or of a single document; exclude: substrings of uris.

    uri is relative to the folder (of a single document its name), in plain characters and with forward slashes; other
    extensions are left out, unless the root itself is one file. Rows have no order; `in_order` gives them that of uris.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    single = files.exists(path) and files.getFileStatus(path).isFile()
    top = files.makeQualified(path.getParent() if single else path).toUri().getPath().rstrip("/")
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    plain = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))  # the reader gives an encoded address
    below = F.regexp_replace(F.replace(plain, F.lit("\\"), F.lit("/")), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    found = rows.withColumn("below", below).select(F.substring(F.col("below"), len(top) + 2, 2**31 - 1).alias("uri"), F.col("value").alias("text"))
    if not single:
        found = found.where(F.lower(F.regexp_extract("uri", r"\.([^./]*)$", 1)).isin(EXTENSIONS))
    for part in exclude:
        found = found.where(~F.contains("uri", F.lit(part)))
    return found


def in_order(docs: DataFrame) -> DataFrame:
    """Documents by uri."""
    return docs.orderBy("uri")


def read_table(rows: DataFrame, uri: str, text: str) -> DataFrame:
    """Documents that already lie in a table's columns."""
    return rows.select(F.col(uri).cast("string").alias("uri"), F.col(text).cast("string").alias("text"))


def first_documents(docs: DataFrame, n: int, modified: DataFrame) -> DataFrame:
    """The first n documents by uri and those in modified(uri). Edges are pruned to them by `KnowledgeBase.of`."""
    return docs.orderBy("uri").limit(n).unionByName(docs.join(modified, "uri", "left_semi")).dropDuplicates(["uri"])


def read_bucket(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """read_tree for s3://, which Spark reads as s3a://."""
    return read_tree(spark, root.replace("s3://", "s3a://", 1), exclude)


Reader = Callable[..., DataFrame]
#: (supports, reader), of which the first that supports an address reads it.
_SOURCES: list[tuple[Callable[[str], bool], Reader]] = [(lambda source: source.startswith("s3://"), read_bucket), (lambda source: source.split("://")[0] in ("file", "s3a", "hdfs", "viewfs") or "://" not in source, read_tree)]


def register(supports: Callable[[str], bool], reader: Reader) -> None:
    """Add a kind of source; later ones are asked first."""
    _SOURCES.insert(0, (supports, reader))


def read(spark: SparkSession, source: str, **options) -> DataFrame:
    """Documents of a source by its address."""
    for supports, reader in _SOURCES:
        if supports(source):
            return reader(spark, source, **options)
    raise ValueError(f"no reader for {source}")


def knowledge_base(spark: SparkSession, source: str, exclude: tuple[str, ...] = (), first: int | None = None, modified: DataFrame | None = None) -> KnowledgeBase:
    """The documents of a source without the excluded ones, or its first ones and modified(uri), with the edges among them."""
    docs = read(spark, source, exclude=exclude)
    if first is not None:
        docs = first_documents(docs, first, modified if modified is not None else docs.where("false").select("uri"))
    return KnowledgeBase.of(docs)


def append_runs(signals: DataFrame, folder: str) -> None:
    """Add a run's findings to a table partitioned by assessment_id."""
    signals.write.mode("append").partitionBy("assessment_id").parquet(folder)
