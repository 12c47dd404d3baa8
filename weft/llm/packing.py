"""Best-fit packing planned on the histogram of lengths.

1. Texts are encoded (an end id after each) and cut into pieces of at most
   ``capacity`` tokens.
2. The driver plans over counts by length, at most ``capacity`` numbers: best
   fit, longest first. Bins with the same room are kept as ranges of numbers,
   so the plan is a list of runs: "items number a to b of length n go k to a
   bin, from bin c on, at offset o". A run's bins lose at least half of their
   room, and a length splits a bounded number of ranges, so the plan is bounded
   by the capacity alone, whatever the number of documents.
3. Each piece takes its slot by its rank within its length. Ranks come from
   counts by (length, bucket) and a window within each, so that no length's
   rows meet in one task.

Defined cases: a null text counts as empty and is one piece with the end id
alone; a null id is an id like others; repeated rows are packed one by one;
other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import cut, in_workers, sliced, table

#: How a byte-level BPE of this kind cuts texts into pre-tokens.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs without a blank that are left to the vocabulary file's own library.
LONG_RUN = 2000


class Ids:
    """Ids of a text, as little-endian 32-bit numbers.

    The vocabulary file's merges are run by the faster of two libraries that
    give the same ids for it. Texts on which their expressions could differ go
    to the file's own library: texts with a special token's string, with
    characters beyond those that every Unicode version of late classes alike,
    or with very long runs without a blank.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("weft", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        strings = "|".join(map(re.escape, special))
        self.odd = re.compile(rf"[^\x00-\u036f\u2010-\u2027]|\S{{{LONG_RUN}}}" + f"|{strings}" * bool(strings))

    def of(self, text: str) -> bytes:
        if self.odd.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def byte_alphabet() -> dict[str, int]:
    """Bytes by the character that stands for them in a byte-level vocabulary:
    printable ones for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: One per worker process and vocabulary, kept from task to task.
_kept: dict[str, Ids] = {}


def encode_pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32. The first piece may be shorter."""
    end = np.array([end_id], "<u4").tobytes()
    id_type = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _kept.get(path)
        if ids is None:
            ids = _kept[path] = Ids(path)
        for batch in sliced(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = ids.of(text or "") + end
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    to = at + (n - at - 1) % capacity + 1 if k == 0 else at + capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(data[4 * at : 4 * to]))
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return in_workers(source, encode, f"id {id_type}, piece long, start long, length long, ids_crc32 long")


def plan_best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit, longest first, over counts by length.

    Rows (length, first rank, items, items a bin, first bin, offset), by length
    and rank. Placing items one by one gives the same bins: the fullest bin with
    room takes items until none fits.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # ranges of bins by the room they have
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fits = sorted(r for r in room if r >= length)
        while left:
            if fits:
                r = fits.pop(0)
                ranges = room.pop(r)
            else:  # new bins, as many as the rest needs
                r, need = capacity, -(-left // (capacity // length))
                ranges, bins = [(bins, bins + need)], bins + need
            per = r // length
            while ranges and left:
                a, b = ranges.pop(0)
                full = min(b - a, left // per)
                if full:
                    runs.append((length, rank, full * per, per, a, capacity - r))
                    if r - per * length:
                        room.setdefault(r - per * length, []).append((a, a + full))
                    rank, left, a = rank + full * per, left - full * per, a + full
                if left and a < b:  # the last bin of this length takes fewer
                    runs.append((length, rank, left, left, a, capacity - r))
                    if r - left * length:
                        room.setdefault(r - left * length, []).append((a, a + 1))
                    left, a = 0, a + 1
                if a < b:
                    ranges.insert(0, (a, b))
            if ranges:
                room.setdefault(r, []).extend(ranges)
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def rank_within_length(pieces: DataFrame, buckets: int) -> DataFrame:
    """``pieces`` with ``rank``, from 0 within each length."""
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1)
    return ranked.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))


def pack(
    df: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    ``buckets`` deals the rows of each length; by default as many as the
    session has shuffle partitions.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut(encode_pieces(df, path, capacity, end_id, id_col, text_col), "pieces")
    # at most `capacity` rows come to the driver
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(plan_best_fit(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        # (length, rank) as one ordered number
        wide = int(runs[:, 1].max() + 1) + int(runs[:, 2].max()) if len(runs) else 1
        keys = runs[:, 0] * wide + runs[:, 1]
        for batch in batches:
            *columns, rank = batch.columns
            rank, length = rank.to_numpy(), batch.column(3).to_numpy()
            run = runs[np.searchsorted(keys, length * wide + rank, "right") - 1]
            k = rank - run[:, 1]
            sequence = run[:, 4] + k // run[:, 3]
            offset = run[:, 5] + k % run[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    ranked = rank_within_length(pieces, buckets).select("id", "piece", "start", "length", "ids_crc32", "rank")
    schema = f"id {id_type}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return in_workers(ranked, place, schema).withColumnRenamed("id", id_col)


def op7_best_fit_packing(spark, sf_dir, vocabulary: str | None = None):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
