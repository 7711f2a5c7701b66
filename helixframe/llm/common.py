"""Small helpers that every corpus operator uses."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound, in bytes, of anything that an operator broadcasts.  A side whose
#: counted rows could exceed it is shuffled instead.
BROADCAST_BYTES = 32 << 20
#: Characters of the texts that a worker has in hand at once, unless one text has more.
PIECE_CHARS = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only if none is configured and all is one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="helixframe-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    It cuts the lineage, so that a lost executor costs at most the stages since
    the last table, and later readers prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete idle shuffle files.

    Spark's cleaner removes the files of a shuffle once the driver's JVM has
    collected its plan; a long job would else keep all of them until its end.
    """
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote (or unions of such) and nothing reads any more, and idle shuffle files."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("table-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        free_shuffles(spark)


def give_back() -> None:
    """At the end of a Python worker's task: hand freed memory back, as the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own counsel
        pass


def pieces(texts: Iterable[str | None], rows: int, chars: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds (from, to) of runs of at most ``rows`` texts and, where that is more than one text, ``chars`` characters."""
    lo = hi = total = 0
    for hi, text in enumerate(texts):
        n = len(text) if isinstance(text, str) else 0
        if hi > lo and (hi - lo >= rows or total + n > chars):
            yield lo, hi
            lo, total = hi, 0
        total += n
        hi += 1
    if lo < hi:
        yield lo, hi


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit BROADCAST_BYTES, else unchanged.

    ``df`` must be cheap to count (a table made by ``cut``).
    """
    rows = df.limit(BROADCAST_BYTES // row_bytes + 1).count()
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_of(name: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def held_out():
    """True for the fold whose labels are never learned from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, conflict) -> list[tuple[str, int]]:
    """At most ``per_class`` training rows of each label, as (text, label), on the driver.

    Only rows outside the held-out fold, of a doc_id that ``docs`` has, count.  The rows are those whose doc_id
    hashes lowest, so the sample depends neither on order nor on partitions.  A
    doc_id with several labels gets ``conflict`` (an aggregate) of them; of a
    doc_id with several rows the text of the lowest hash counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(conflict(label).alias("__y")).where(~held_out())
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    found = docs.select("doc_id", text_of().alias("__text")).join(F.broadcast(picked), "doc_id")
    # Two texts of one hash are ordered by themselves, so that runs agree.
    found = found.groupBy("doc_id", "__y").agg(F.min(F.struct(F.xxhash64("__text"), F.col("__text").alias("t"))).alias("__t"))
    rows = found.select("doc_id", F.col("__t.t").alias("__text"), "__y").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [(r["__text"], int(r["__y"])) for r in rows]
