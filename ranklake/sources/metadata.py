"""Metadata source: every ``*.parquet`` / ``*.parquet.gz`` file of a
directory is the metadata of the index named by the file name up to its
last ``.parquet``. A folder of that name holds the same as sorted parts
(``part-<number>...``, as ``write_metadata`` leaves them).

The two record schemas cannot be read together (string vs long
``warc_date``), so the files are grouped by schema from their footers (one
small footer read per file, as many files as indexes), each group is read
in one scan with an explicit schema, projected to the canonical columns
and the groups are unioned. ``file_pos`` is the record's row index in its
file (``_metadata.row_index``) plus the rows of the parts before it, which
keeps file order for "last duplicate wins". Unreadable files are skipped (``ignoreCorruptFiles``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.config import BROADCAST_MAX_ROWS
from ranklake.operators.enrich import canonical_schema_a, canonical_schema_b

S = T.StringType()
SCHEMA_A = T.StructType([T.StructField(n, S) for n in
                         ("record_id", "url", "title", "plain_text", "language", "warc_date")])
SCHEMA_B = T.StructType(
    [T.StructField(n, S) for n in ("id", "url_scheme", "url_subdomain", "url_domain", "url_suffix",
                                   "url_path", "url_query", "url_fragment", "title", "plain_text",
                                   "language")]
    + [T.StructField("warc_date", T.LongType())])

#: Footers read at a time when a directory is scanned.
FOOTER_READERS = 16

SUFFIXES = (".parquet", ".parquet.gz")


def _list_files(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p_of = jvm.org.apache.hadoop.fs.Path
    p = p_of(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isFile() and name.endswith(SUFFIXES):
            out.append(st.getPath().toString())
        elif st.isDirectory() and name.endswith(SUFFIXES[0]):
            parts = fs.globStatus(p_of(st.getPath(), "part-*"))
            out += [part.getPath().toString() for part in parts or []]
    return sorted(out)


def _schema_groups(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Files by schema, from their footers, several read at a time; an
    unreadable file is skipped like the reference does."""
    def group(file: str) -> str | None:
        try:
            names = set(spark.read.parquet(file).schema.fieldNames())
        except (PySparkException, Py4JJavaError):
            return None
        return "a" if "record_id" in names else "b"
    with ThreadPoolExecutor(FOOTER_READERS) as pool:
        found = list(zip(files, pool.map(group, files), strict=True))
    return {g: [f for f, x in found if x == g] for g in ("a", "b")}


def _read_group(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    read = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*files)
    # Empty for a plain file; the path is a URI.
    folder = F.url_decode(F.replace(F.regexp_extract("_path", r"([^/]*)\.parquet/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
    named = F.when(folder != "", folder).otherwise(F.regexp_extract("_file", r"^(.*)\.parquet(\.gz)?$", 1))
    meta = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("_path")]
    df = read.select("*", *meta, F.col("_metadata.row_index").alias("_row")).withColumn("index_name", named)
    if not any(SUFFIXES[0] + "/" in f for f in files):
        return df.withColumn("file_pos", F.col("_row"))
    # Rows before each part: one row a file, summed up within its index.
    part = F.when(folder != "", F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("long"))
    counts = (read.select(*meta).withColumn("index_name", named).withColumn("_part", part)
              .groupBy("index_name", "_part", "_file", "_path").agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy("index_name").orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_path", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    if len(files) <= BROADCAST_MAX_ROWS:
        before = F.broadcast(before)
    return (df.join(before, "_path", "left")
            .withColumn("file_pos", F.col("_row") + F.coalesce("_before", F.lit(0))).drop("_before"))


def write_metadata(rows: DataFrame, path: str, parts: int | None = None, order_col: str = "file_pos") -> None:
    """``rows`` in the order of ``order_col`` (not written) as a folder of
    sorted parts, as many as their size asks for unless ``parts`` is given.
    Rows must differ in ``order_col`` for a defined order."""
    ranges = rows.repartitionByRange(parts, order_col) if parts else rows.repartitionByRange(order_col)
    ranges.sortWithinPartitions(order_col).drop(order_col).write.parquet(path)


def scan_metadata_dir(spark: SparkSession, path: str) -> DataFrame:
    """Canonical metadata of every index file in ``path`` (see module doc)."""
    groups = _schema_groups(spark, _list_files(spark, path))
    parts = []
    if groups["a"]:
        parts.append(canonical_schema_a(_read_group(spark, groups["a"], SCHEMA_A)))
    if groups["b"]:
        parts.append(canonical_schema_b(_read_group(spark, groups["b"], SCHEMA_B)))
    if not parts:
        more = [T.StructField("index_name", S), T.StructField("file_pos", T.LongType())]
        empty = spark.createDataFrame([], T.StructType([*SCHEMA_A.fields, *more]))
        return canonical_schema_a(empty)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
