"""Quality by compression: dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled text, one from each class.
A text is compressed with both, block by block so that the dictionaries, not the
text's own past, explain each block; the difference of the sizes, divided by
their sum, tells which class it resembles. A logistic curve, fitted on labelled
texts and dictionaries that have not seen them, makes the difference a score.

Learnt from at most ``most`` labelled rows of each class (a documented bound)
outside the held-out remainder; scores read whole texts and nothing else.

Defined cases: null and empty texts, and all texts where a class has no labelled
rows, get the score of no evidence, ``EMPTY``; repeated rows and ids are scored
one by one; labels of unknown documents or other values are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import in_workers, sliced, table
from weft.llm.labelled import fit_logistic, logistic, remainder, training_rows

#: Bytes that are compressed at a time.
BLOCK = 2048
DICTIONARY = 64 * 1024
#: The score of an empty text: nothing speaks for quality.
EMPTY = 0.0


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: np.ndarray


def build_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; from too few texts, their raw content."""
    import zstandard

    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[-DICTIONARY:]


def _blocks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Sizes:
    """Compressed sizes of a text with either dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int = 1):
        import zstandard

        def compressor(data: bytes):
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(level=level)
            return zstandard.ZstdCompressor(
                level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False
            )

        self.by = [compressor(good), compressor(bad)]

    def features(self, text: str | None) -> tuple[float, ...]:
        """The normalised difference (positive: like good text), what a short text
        takes off it, and how far the text shrinks at all: repetition explains a
        small size, not either dictionary."""
        blocks = _blocks(text or "")
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.by)
        d = (bad - good) / max(good + bad, 1)
        short = max(0.0, 1 - len(blocks[0]) / 400) if blocks else 1.0
        ratio = good / max(sum(map(len, blocks)), 1)
        return 10 * d, 10 * d * short, short, ratio, min(ratio, 0.35) * 10


def fit(texts: list[str], y: np.ndarray, share: float) -> Model | None:
    """Dictionaries from all texts; the curve from each half, measured with the other half's dictionaries."""

    def both(use: np.ndarray) -> tuple[bytes, bytes]:
        return tuple(build_dictionary([t for t, c, u in zip(texts, y, use, strict=True) if u and c == k]) for k in (1, 0))

    if len(set(y.tolist())) < 2:
        return None
    everything = np.ones(len(y), bool)
    place = np.empty(len(y), int)  # halves of either class
    for k in (0, 1):
        place[y == k] = np.arange((y == k).sum())
    halves = [place % 2 == k for k in (0, 1)]
    if any(len(set(y[h].tolist())) < 2 for h in halves):
        halves = [everything]
    x = np.empty((len(y), 5))
    for h in halves:
        sizes = Sizes(*both(~h if len(halves) == 2 else h))
        x[h] = [sizes.features(t) for t, u in zip(texts, h, strict=True) if u]
    return Model(*both(everything), fit_logistic(x, y, share))


def score_quality(df: DataFrame, model: Model | None, id_col: str, text_col: str, threshold: float = 0.7) -> DataFrame:
    """Per row: the id, ``score`` and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sizes = Sizes(model.good, model.bad) if model else None
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            if sizes:
                x = np.array([sizes.features(t) for t in texts])
                p = logistic(np.c_[x, np.ones(len(x))] @ model.weights)
                p = np.where([bool(t) for t in texts], p, EMPTY)
            else:
                p = np.full(len(texts), EMPTY)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                ["id", "score", "predicted"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return in_workers(source, score, f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)


def op2_compression_quality(spark, sf_dir, most: int = 2000):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(*training_rows(docs, labels, "quality", 4, 2, most))
    scored = score_quality(docs, model, "doc_id", "text")
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
