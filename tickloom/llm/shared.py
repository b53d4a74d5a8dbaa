"""Shared folders, written tables and small helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.lineage import saved, scratch, shared_base

__all__ = ["ROW", "attach_groups", "ascii_lower", "lean", "open_folder", "saved", "scratch", "shared_base", "text_of", "with_row_key", "word_count", "write_file"]

#: Characters that separate words and that normalised texts drop: space and \x09 to \x0D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Rows of a batch of texts, in Parquet's reader and on the way to Python; Spark's own defaults (4096 and 10000) make batches of tens of MB.
BATCH_ROWS = 500
BATCH_CONFS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def lean(df: DataFrame) -> DataFrame:
    """df, after bounding the session's batches to BATCH_ROWS rows: for plans over whole texts."""
    conf = df.sparkSession.conf
    for key in BATCH_CONFS:
        if not 0 < int(conf.get(key)) <= BATCH_ROWS:
            conf.set(key, str(BATCH_ROWS))
    return df


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


#: Column of row keys; named so that no column of a table is likely to clash.
ROW = "_tickloom_row"


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a key of each row in ROW: doc_id if no row lacks or repeats it, else a number that is written with the rows."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 OR id IS NULL").limit(1).count():
        return saved(lean(docs).withColumn(ROW, F.monotonically_increasing_id()), name)
    return docs.withColumn(ROW, F.col("doc_id").cast("long"))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-join groups (one row per key, with its number of rows) to rows without moving a hot key's rows to one task.

    Keys with over a thousandth of all rows number under 1000, whatever the input: their group rows are broadcast.
    All other rows join by shuffle, no key holding more than a thousandth. Null keys match nothing. rows is read twice: a saved table, best.
    """
    limit = total / 1000
    whole = F.struct(*groups.columns).alias("_group")
    hot = F.broadcast(groups.where(F.col(size) > limit).select(F.col(key).alias("_key"), whole))
    cold = groups.where(F.col(size) <= limit).select(F.col(key).alias("_key"), whole)
    same = F.col(key) == F.col("_key")
    apart = rows.join(hot, same).drop("_key")
    rest = rows.join(hot.select("_key"), same, "left_anti").join(cold, same, "left").drop("_key")
    return apart.unionByName(rest)


def open_folder(uri: str):
    """pyarrow file system and path of a folder given as a path or as a URI that pyarrow knows (file, hdfs, s3, gs); for use on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, name: str, parts) -> int:
    """Write the parts to folder/name under another name first, so that a reader never sees half a file; returns the bytes written."""
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    written = 0
    with system.open_output_stream(f"{folder}/.{name}.partial", compression=None) as out:
        for part in parts:
            out.write(part)
            written += len(part)
    system.move(f"{folder}/.{name}.partial", f"{folder}/{name}")
    return written
