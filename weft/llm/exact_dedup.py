"""Exact deduplication by progressive refinement, in built-in expressions only.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted. Three levels, each for what the one before left:

1. group by normalised length: a length that only one row has is settled;
2. group by a hash of the normalised prefix within the lengths that are left;
3. group by a hash of the full text within the prefixes that are left. Full
   texts are hashed in a second scan, of surviving rows only; where the caller
   wants every row's digest, the first scan gives it.

To the scans that need them, surviving keys travel as bitmaps of a bounded size,
so no text is shuffled and no key set is broadcast. A bitmap only saves work: a
key that shares another's bit is settled at level 3, where the full hash decides.

Defined cases: null texts count as empty; empty texts are equal to each other
and to texts of blanks; a null id sorts after all others; each row counts, so of
rows with the same id and the same text one stays; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import BLANKS, Spread, bitmap_of, cut, free_name, table, text_or_empty


def normalised(text_col: str) -> Column:
    """The text without blanks; a chain of byte-wise replacements."""
    return reduce(lambda c, b: F.replace(c, F.lit(b), F.lit("")), BLANKS, text_or_empty(text_col))


def _hashed(df: DataFrame, id_col: str, text_col: str, prefix: int, digest: bool) -> DataFrame:
    """Per row: ``_id``, ``_points``, ``_open`` (an equal text may exist) and ``_sha`` of open rows, or of all."""
    # the columns have names of their own, so others of df can't clash
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.char_length(text_or_empty(text_col)).alias("_points"),
        normalised(text_col).alias("_norm"),
    )
    sha = F.sha2("_norm", 256)
    keyed = rows.select(
        "_id", "_points", "_norm",
        F.octet_length("_norm").alias("_len"),
        F.xxhash64(F.substring("_norm", 1, prefix)).alias("_head"),
    )
    # a written table is what keeps Catalyst from normalising the text again in
    # each filter and branch below; it holds some 50 bytes a row
    facts = cut(
        keyed.select("_id", "_points", "_len", "_head", *([sha.alias("_sha")] if digest else [])),
        "exact-facts",
    )
    # level 1: lengths; level 2: prefixes within the lengths that are left
    by_length = cut(facts.groupBy("_len").count().filter("count > 1"), "exact-lengths")
    long_enough = facts.filter(bitmap_of(by_length, ["_len"], plain=False))
    by_head = cut(long_enough.groupBy("_len", "_head").count().filter("count > 1"), "exact-heads")
    survives = bitmap_of(by_head, ["_len", "_head"], plain=False)
    if digest:
        return facts.select("_id", "_points", survives.alias("_open"), "_sha")
    full = keyed.withColumn("_open", survives).withColumn("_sha", F.when(F.col("_open"), sha))
    return cut(full.select("_id", "_points", "_open", "_sha"), "exact-hashes")


def _order() -> Column:
    """The least of a group stays."""
    return F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id"))


def _grouped(hashed: DataFrame) -> DataFrame:
    """Level 3: documents, of ``_copies`` rows each, with their groups; both summed before the shuffle as well."""
    documents = cut(
        hashed.filter("_open").groupBy("_sha", "_id", "_points").agg(F.count("*").alias("_copies")), "exact-documents"
    )
    groups = documents.groupBy("_sha").agg(
        F.min(_order()).alias("_best"), F.sum("_copies").alias("_size"), F.count("*").alias("_documents")
    )
    # a large group's documents meet its one row in several tasks
    return Spread(groups, ["_sha"], "_documents", plain=False).join(documents, groups, "_id")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest: bool = False) -> DataFrame:
    """One row per row of ``df``: which equal text stays.

    Columns: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.
    Of equal texts the row with the most code points in the original text
    stays, then the smallest id. ``text_sha256`` is null for texts that the first
    two levels already showed to be single, unless ``digest`` asks for it on
    every row.
    """
    hashed = _hashed(df, id_col, text_col, prefix, digest)
    best = F.col("_best")
    found = _grouped(hashed).withColumn("_stays", _order() == best)

    def out(rows: DataFrame, kept: Column) -> DataFrame:
        return rows.select(
            F.col("_id").alias(id_col),
            best.getField("_id").alias("keep_id"),
            F.col("_size").alias("group_size"),
            kept.alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )

    # one row for each document, then those that repeat it
    repeats = found.filter("_copies > 1").withColumn("_copy", F.explode(F.sequence(F.lit(2).cast("long"), F.col("_copies"))))
    single = hashed.filter(~F.col("_open")).select(
        F.col("_id").alias(id_col),
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    return out(found, F.col("_stays")).unionByName(out(repeats, F.lit(False))).unionByName(single)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """The rows of ``df`` that stay: one of each group of equal texts.

    The columns are those of ``df``. What goes is looked up: rows that can't be
    among it, by id and length, pass without being hashed or shuffled.
    """
    marks = (
        _grouped(_hashed(df, id_col, text_col, prefix, False))
        .select("_sha", "_id", "_points", (_order() == F.col("_best")).alias("_stays"), "_copies")
        .filter("NOT _stays OR _copies > 1")
    )
    marks = cut(marks, "exact-marks")
    points, maybe, sha = (free_name(df, n) for n in ("points", "maybe", "sha"))
    key = df.select("*", F.char_length(text_or_empty(text_col)).alias(points))
    found = bitmap_of(marks.select(F.col("_id").alias(id_col), F.col("_points").alias(points)), [id_col, points], plain=False)
    rows = key.withColumn(maybe, found)
    asked = rows.filter(F.col(maybe)).withColumn(sha, F.sha2(normalised(text_col), 256))
    same = asked[id_col].eqNullSafe(marks["_id"]) & (asked[points] == marks["_points"]) & (asked[sha] == marks["_sha"])
    rest = asked.join(marks.filter("NOT _stays OR _copies > 1"), same, "left_anti")
    # of rows that repeat one that stays, one stays
    again = asked.join(marks.filter("_stays"), same, "left_semi").dropDuplicates([id_col, sha])
    return rows.filter(~F.col(maybe)).select(*df.columns).unionByName(rest.select(*df.columns)).unionByName(again.select(*df.columns))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), digest=True)


#: DuckDB SQL for the rows of ``op10_exact_dedup``.
OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
