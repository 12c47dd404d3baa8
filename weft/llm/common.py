"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.runtime import ship_package

#: Characters between words everywhere in this folder: ``[\x20\x09-\x0D]``.
#: ``bytes.split()`` cuts at exactly these.
BLANKS = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch, where the session has Spark's default.
BATCH_SETTING, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", 1024


def in_workers(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package importable in the workers.

    Batches are kept small unless the session says otherwise: texts may be long,
    and both sides hold whole batches.
    """
    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_ROWS)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where all run on one
    machine (tests) and it is unset, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="weft-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return base.rstrip("/")


#: Folders that ``cut`` has written and nobody has deleted, with their sessions.
_folders: dict[str, SparkSession] = {}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a rerun, and
    results used twice are computed once. The folder goes with ``discard`` or at
    the end of the driver's process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _folders:
        atexit.register(_discard_all)
    _folders[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``cut`` gave and that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            for path in [p for p in _folders if p.split(":")[-1].lstrip("/") + "/" in file]:
                _delete(path)


def _delete(path: str) -> None:
    spark = _folders.pop(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _discard_all() -> None:
    for path in list(_folders):
        if _folders[path].sparkContext._jsc is not None:
            _delete(path)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller slices, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_hash(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, the same ones every time: those with the least hashes of ``columns``.

    The share of hashes that is looked at follows from the number of rows, so few
    rows leave their tasks, however many tasks there are.
    """
    share = min(1.0, 4 * rows / max(df.count(), 1))
    order = F.xxhash64(*columns)
    few = df.filter(F.pmod(order, F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    return few.orderBy(F.pmod(order, F.lit(1 << 40)), order).limit(rows)


def crc32_of_id(id_col: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def _bit(keys: list[Column], filter_bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << filter_bits))


#: Bits for each key of a bitmap, the most that one has (8 MB), and those that go into a plan as they are.
BITS_A_KEY, MOST_BITS, PLAIN_BITS = 16, 26, 16


def bitmap_of(groups: DataFrame, keys: list[str], plain: bool = True) -> Column:
    """Whether a row's ``keys`` may be among those of ``groups``: a bitmap, probed per row.

    True for all of them and for few others, so a join or a hash may follow on
    less rows. The bitmap grows with the number of groups, which are counted here,
    up to ``2**MOST_BITS`` bits. Beyond, more rows pass, at last all: what follows
    has more work then, and the same results. A small one is a literal of the plan,
    unless ``plain`` is false; a larger one is a scalar subquery.
    """
    filter_bits = max(12, min(MOST_BITS, (BITS_A_KEY * groups.count()).bit_length()))
    bit = _bit([F.col(k) for k in keys], filter_bits)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    place = F.shiftright(bit, 6).cast("int")
    if plain and filter_bits <= PLAIN_BITS:  # a bounded number of keys
        bitmap = np.zeros(1 << (filter_bits - 6), np.int64)
        for r in groups.select(place.alias("place"), mask.alias("mask")).collect():
            bitmap[r["place"]] |= r["mask"]
        return F.get(F.lit(bitmap), place).bitwiseAND(mask) != 0
    words = groups.select(_bit([F.col(k) for k in keys], filter_bits).alias("bit")).select(
        F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))").alias("bits")
    )
    every = groups.sparkSession.range(1 << (filter_bits - 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = (
        every.unionByName(words)
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
        .select(F.col("w.bits").alias("bitmap"))
    )
    return F.get(dense.scalar(), place).bitwiseAND(mask) != 0


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` has not (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


class Spread:
    """Joins many rows to one by a key, with hot keys dealt to several tasks.

    ``sizes`` has the number of rows by key, in column ``size``. Rows of keys with
    more than ``HEAVY`` are dealt by a hash of another column, and what they are
    joined with is repeated so often. Which keys those are is told by a bitmap,
    and both sides ask the same one.
    """

    #: Rows of a key that one task may have, and into how many parts a key is dealt at most.
    HEAVY, PARTS = 128, 256

    def __init__(self, sizes: DataFrame, keys: list[str], size: str, top: int | None = None, plain: bool = True):
        """``top`` is the largest size, where it is known."""
        if top is None:
            top = sizes.agg(F.max(size)).first()[0] or 0
        self.keys, self.parts = keys, min(self.PARTS, -(-top // self.HEAVY))
        self.hot = bitmap_of(sizes.filter(F.col(size) > self.HEAVY), keys, plain) if self.parts > 1 else None

    def many(self, rows: DataFrame, by: str) -> DataFrame:
        """``rows`` with ``part``."""
        part = F.lit(0) if self.hot is None else F.when(self.hot, F.pmod(F.xxhash64(by), F.lit(self.parts)).cast("int")).otherwise(0)
        return rows.withColumn("part", part)

    def one(self, rows: DataFrame) -> DataFrame:
        """``rows``, once for each ``part`` of their key."""
        if self.hot is None:
            return rows.withColumn("part", F.lit(0))
        parts = F.when(self.hot, F.sequence(F.lit(0), F.lit(self.parts - 1))).otherwise(F.array(F.lit(0)))
        return rows.withColumn("part", F.explode(parts))

    def join(self, rows: DataFrame, facts: DataFrame, by: str, how: str = "inner") -> DataFrame:
        """``rows`` with the columns of ``facts``, which has a row for each key."""
        if self.hot is None:
            return rows.join(facts, self.keys, how)
        return self.many(rows, by).join(self.one(facts), [*self.keys, "part"], how).drop("part")
