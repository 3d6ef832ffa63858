"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between two of these is a word.
SPACE = r"[\x09-\x0D\x20]+"
BLANK = r"[\x09-\x0D\x20]"
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes, so that tasks in Python hold a few MB at a time however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder. Where neither is set
    a temporary one serves a local session; on a cluster that is an error, since executors could not see it."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terraspan-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run inside go when it ends. Otherwise they stay until the driver happens to
    collect its garbage, which it does by what it allocates itself: on large inputs those of many steps pile up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Folders of staged tables.
PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut in the lineage that survives lost
    executors. Folders stay until they are given to ``discard`` or the caller clears the shared folder."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/terraspan/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    PLACES[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of staged tables that nothing reads any more."""
    for each in tables:
        if path := PLACES.pop(each, None):
            remove(each.sparkSession, path)


def counted(df: DataFrame) -> int:
    with shuffles_removed(df.sparkSession):
        return df.count()


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hand_back() -> None:
    """At the end of a task: give memory that a worker process no longer uses back to the system. Workers live on between
    tasks and stages, and what they hold counts against their executor."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def fold_of(doc_id):
    """crc32 of the id as text, modulo 5; rows with remainder 0 are held out from training."""
    return F.crc32(doc_id.cast("string")) % 5


#: Bytes of a value in a broadcast relation, about; strings and binaries are taken as keys of some length.
WIDTH = {"boolean": 1, "int": 4, "float": 4, "string": 64, "binary": 64}


def checked_broadcast(df: DataFrame, rows: int, most: int = 32 << 20) -> DataFrame:
    """Broadcast ``df`` when its counted ``rows`` take at most ``most`` bytes; beyond that Spark joins it by a shuffle."""
    width = 16 + sum(WIDTH.get(kind, 8) for _, kind in df.dtypes)
    return F.broadcast(df) if rows * width <= most else df


LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text) -> Column:
    """Lower-cased runs of letters, as :func:`words_of` finds them on the Python side."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def bounded_rows(rows: DataFrame, by: str, most: int, seed: int, even: bool = False, counts: dict | None = None) -> DataFrame:
    """A sample of about ``most`` rows at most for each value of ``by`` (not null), chosen by a hash of ``doc_id``: counts
    come from one aggregation over ids and ``by`` alone, unless given, then each row decides by itself, so nothing is
    sorted or moved. even: no value gets more than the rarest one has."""
    counts = counts_by(rows, by) if counts is None else counts
    most = min([most, *counts.values()]) if even else most
    rate = f"rate_{seed}"
    kind = rows.schema[by].dataType.simpleString()
    rates = rows.sparkSession.createDataFrame([(v, min(1.0, most / n)) for v, n in counts.items()], f"`{by}` {kind}, {rate} double")
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)
    return rows.join(checked_broadcast(rates, len(counts)), by).where(uniform < F.col(rate)).select(*rows.columns)


def counts_by(rows: DataFrame, by: str) -> dict:
    return {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
