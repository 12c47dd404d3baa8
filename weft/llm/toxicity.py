"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words, in lower case and without marks and
symbols at the ends, and the word's beginnings, hashed to ``2**BITS`` places.
Besides a weight, each place has a short vector; products of two vectors weigh
pairs of terms, such as an insult with the mention of a group, that no sum of
single weights can tell from the two terms apart.

Places enter if their classes differ beyond chance or if they are frequent, so
that the many chance words of a long text add no noise; weights and vectors are
learnt with Adagrad. Learnt from at most ``most``
labelled rows of each class (a documented bound) outside the held-out remainder;
scores read whole texts and nothing else.

Defined cases: null and empty texts, and all texts where a class has no labelled
rows, get the score of the constant alone; repeated rows and ids are scored one
by one; labels of unknown documents or other values are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from weft.llm.common import in_workers, sliced, table
from weft.llm.labelled import class_weights, fit_logistic, logistic, remainder, training_rows

BITS = 20
#: Components of a vector.
FACTORS = 4
ENDS = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—"
_ENDS = ENDS.encode()


class Model(NamedTuple):
    constant: float
    weights: np.ndarray  # by row
    vectors: np.ndarray
    rows: dict[int, int]  # rows by place
    curve: tuple[float, float]  # from the machine's sum to a calibrated one


def places(word: bytes) -> tuple[int, ...]:
    """Hashed places of a word and, for longer ones, of its first letters."""
    term = word.decode().lower().strip(ENDS)
    if not term:
        return ()
    found = [term]
    if len(term) > 5:
        found.append(f"{term[:5]}-")
    return tuple(xxhash.xxh3_64_intdigest(x) >> (64 - BITS) for x in found)


class Terms(dict):
    """Known rows of a model by word; emptied when full."""

    def __init__(self, rows: dict[int, int]):
        self.rows = rows

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(r for p in places(word) if (r := self.rows.get(p)) is not None)
        if len(word) <= 48:
            if len(self) >= 500_000:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = set((text or "").encode().split())
        return np.array(sorted({r for w in words for r in self[w]}), np.int64)


def raw_score(model: Model, x: np.ndarray) -> float:
    if not len(x):
        return model.constant
    v = model.vectors[x]
    total = v.sum(0)
    return model.constant + model.weights[x].sum() + 0.5 * float((total * total).sum() - (v * v).sum())


def _choose(bags: list[set[int]], y: np.ndarray, least_df: int, least_z: float, frequent: int) -> dict[int, int]:
    """Rows by place: terms whose classes differ beyond chance, and the most
    frequent ones, which matter in pairs if at all. A chance word is neither."""
    df: dict[int, int] = {}
    toxic: dict[int, int] = {}
    for bag, c in zip(bags, y.tolist(), strict=True):
        for p in bag:
            df[p] = df.get(p, 0) + 1
            if c:
                toxic[p] = toxic.get(p, 0) + 1
    share = float(y.mean())
    enough = [p for p, n in df.items() if n >= least_df]
    z = {p: (toxic.get(p, 0) - df[p] * share) / (df[p] * share * (1 - share)) ** 0.5 for p in enough}
    chosen = {p for p in enough if abs(z[p]) >= least_z}
    chosen |= set(sorted(enough, key=lambda p: (-df[p], p))[:frequent])
    return {p: i for i, p in enumerate(sorted(chosen))}


def fit(
    texts: list[str],
    y: np.ndarray,
    share: float,
    epochs: int = 12,
    least_df: int = 3,
    least_z: float = 3.5,
    frequent: int = 300,
    l2: float = 0.002,
    rate: float = 0.2,
) -> Model | None:
    if len(set(y.tolist())) < 2:
        return None
    bags = [{p for w in set(t.encode().split()) for p in places(w)} for t in texts]
    learn = np.arange(len(y)) % 5 != 0  # the others fit the curve
    if len(set(y[~learn].tolist())) < 2 or len(set(y[learn].tolist())) < 2:
        learn[:] = True
    rows = _choose([b for b, k in zip(bags, learn, strict=True) if k], y[learn], least_df, least_z, frequent)
    x = [np.array(sorted(rows[p] for p in bag if p in rows), np.int64) for bag in bags]
    rng = np.random.default_rng(7)
    weight = class_weights(y, max(share, 0.25))
    n = len(rows)
    w, w2 = np.zeros(n), np.full(n, 0.1)
    v, v2 = rng.normal(0, 0.01, (n, FACTORS)), np.full((n, FACTORS), 1.0)
    constant, c2 = -1.0, 0.1
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(learn)):
            at = x[i]
            va = v[at]
            total = va.sum(0)
            s = constant + w[at].sum() + 0.5 * float((total * total).sum() - (va * va).sum())
            g = float(logistic(np.array(s)) - y[i]) * weight[i]
            c2 += g * g
            constant -= rate * g / c2**0.5
            gw = g + l2 * w[at]
            w2[at] += gw * gw
            w[at] -= rate * gw / np.sqrt(w2[at])
            gv = g * (total - va) + 5 * l2 * va
            v2[at] += gv * gv
            v[at] = va - 0.25 * rate * gv / np.sqrt(v2[at])
    model = Model(constant, w, v, rows, (1.0, 0.0))
    terms = Terms(rows)
    rest = ~learn if (~learn).any() else learn
    raw = np.array([raw_score(model, terms.of(t)) for t, r in zip(texts, rest, strict=True) if r])
    a, b = fit_logistic(np.clip(raw, -8, 8)[:, None], y[rest], max(share, 0.2))
    return model._replace(curve=(float(a), float(b)))


def score_toxicity(df: DataFrame, model: Model | None, id_col: str, text_col: str, threshold: float = 0.7) -> DataFrame:
    """Per row: the id, ``score`` and ``predicted``. The model has at most ``2**BITS`` rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        terms = Terms(model.rows) if model else None
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            if model:
                raw = np.array([raw_score(model, terms.of(t)) for t in texts])
                p = logistic(model.curve[0] * np.clip(raw, -8, 8) + model.curve[1])
            else:
                p = np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                ["id", "score", "predicted"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return in_workers(source, score, f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)


def op9_factorization_toxicity(spark, sf_dir, most: int = 2000):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(*training_rows(docs, labels, "toxic", 3, 1, most))
    scored = score_toxicity(docs, model, "doc_id", "text")
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
