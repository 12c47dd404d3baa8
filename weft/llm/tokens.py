"""Token counts without a pre-token shuffle: a two-tier lookup on the map side.

Texts are cut at blanks, ``[\x20\x09-\x0D]``, across which the tokenizer's
pre-tokens never reach. The first tier is a compact broadcast table with the
lengths of frequent chunks; a chunk that is not in it is encoded by the library
once and then kept in its worker's cache. Nothing is shuffled.

The table is taken from a bounded sample (``sample_rows``). It decides only
where a length is looked up, never its value. Its size is bounded by
``table_size`` chunks of at most ``CHUNK_BYTES`` bytes.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
and ids are counted one by one; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import by_hash, in_workers, sliced, table

#: Longer chunks are encoded each time: they rarely repeat and would fill caches.
CHUNK_BYTES = 64
#: Chunks that a worker's cache may hold; it is emptied when full.
CACHE_CHUNKS = 1_000_000


class Lengths(dict):
    """Tokens by chunk (bytes): the frequent table, then what was encoded here."""

    def __init__(self, path: str, frequent: tuple[bytes, bytes] = (b"", b"")):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        chunks, lengths = frequent
        self.frequent = dict(zip(chunks.split(), lengths, strict=True))
        self.update(self.frequent)

    def encoded(self, chunk: bytes) -> int:
        return len(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids)

    def __missing__(self, chunk: bytes) -> int:
        n = self.encoded(chunk)
        if len(chunk) <= CHUNK_BYTES:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
                self.update(self.frequent)
            self[chunk] = n
        return n

    def of(self, text: bytes) -> int:
        return sum(map(self.__getitem__, text.split()))


#: One per worker process and vocabulary, kept from task to task.
_kept: dict[str, Lengths] = {}


def frequent_lengths(df: DataFrame, path: str, sample_rows: int, table_size: int) -> tuple[bytes, bytes]:
    """Frequent chunks of ``df`` (id, text), joined by blanks, and a byte for each length.

    Chunks of at most ``sample_rows`` rows are counted, in one task; the driver gets the table only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches, 64):
            for text in batch.column(1).to_pylist():
                counts.update(x for x in (text or "").encode().split() if len(x) <= CHUNK_BYTES)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in counts.most_common(table_size)], pa.binary())], ["chunk"])

    sample = by_hash(df, ["id", "text"], sample_rows)
    lengths = Lengths(path)
    found = [(x, lengths[x]) for x in (bytes(r[0]) for r in in_workers(sample, count, "chunk binary").limit(table_size).collect())]
    found = [(x, n) for x, n in found if n < 256]
    return b" ".join(x for x, _ in found), bytes(n for _, n in found)


def count_tokens(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    sample_rows: int = 2000,
    table_size: int = 65_536,
) -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    spark = df.sparkSession
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_lengths(source, path, sample_rows, table_size))
    id_type = df.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _kept.get(path)
        if lengths is None:
            lengths = _kept[path] = Lengths(path, frequent.value)
        for batch in sliced(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            n = [lengths.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array((x > limit for x in n), pa.bool_()),
                ],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"id {id_type.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return in_workers(source, count, schema).withColumnRenamed("id", id_col)


def op8_token_counts(spark, sf_dir, vocabulary: str | None = None):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
