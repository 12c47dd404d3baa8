"""Quality rules: base counts and distance from language references.

A document's character classes and common words are compared, by
Jensen-Shannon distance (the divergence's square root; base 2, from 0 to 1), with references that are
counted over the whole corpus, one for each language. A document may follow any
of the references; it is rejected where it is far from all of them. The guards
are lengths: a histogram of few draws differs by chance, so characters are
compared from ``min_chars`` on and words from ``min_words`` on.

References take two scans. The first counts character classes exactly and finds
candidates: each task keeps ``KEPT_WORDS`` counters a language, and when they are
full all are lowered together, so a counter is short of its word's count by at
most the task's words / ``KEPT_WORDS``. A word with a share of 1/``SHARE`` in the
corpus has that share in some task, and no such word can be missed there, as long
as KEPT_WORDS is greater than SHARE. The second scan counts the candidates
exactly. Both send a bounded number of rows for each language from each task and
are summed by Spark. Every language counts, however many there are: references
hold at most 48 words and 8 class counts each, and are broadcast; a document's
comparison grows with their number. A language in which no word has that share
(say, one written without blanks) has no reference, and distance doesn't reject
its documents.

Defined cases: null texts have no words and fail the base rules; a null language
counts as the language ''; repeated rows are judged one by one and count each
time; an empty table has no references and no rows. Other columns pass through
``keep_good`` untouched and are not read otherwise.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import cut, in_workers, sliced, table

SYMBOLS = "#*$%&|<>"
MARKS = b".,;:!?'\"()-"
CLASSES = ("vowel", "consonant", "upper", "digit", "blank", "mark", "symbol", "beyond", "tail")

#: Common words of a reference, without the rest.
COMMON = 48
SHARE = 2000
#: Candidates of a language that are counted exactly; at most SHARE words can have that share.
CANDIDATES = 2 * SHARE
KEPT_WORDS = 50_000


def _class_table() -> np.ndarray:
    """Class by byte; the tails of UTF-8 sequences have their own, which isn't compared."""
    by = np.full(256, CLASSES.index("symbol"), np.uint8)
    by[0x80:0xC0] = CLASSES.index("tail")
    by[0xC0:] = CLASSES.index("beyond")
    for c in range(128):
        if chr(c) in "aeiouy":
            by[c] = CLASSES.index("vowel")
        elif chr(c).islower():
            by[c] = CLASSES.index("consonant")
        elif chr(c).isupper():
            by[c] = CLASSES.index("upper")
        elif chr(c).isdigit():
            by[c] = CLASSES.index("digit")
        elif chr(c) in " \t\n\x0b\x0c\r":
            by[c] = CLASSES.index("blank")
        elif c in MARKS:
            by[c] = CLASSES.index("mark")
    return by


_CLASS = _class_table()


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=len(CLASSES))[:-1]


def bare(words: list[bytes]) -> list[bytes]:
    """Words as they are compared: lower case, without sentence marks at the ends."""
    return [w.strip(MARKS) for w in b" ".join(words).lower().split(b" ")]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of counts ``p``, one row or as many as ``q``'s, from each row of ``q``."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1)
    m = (p + q) / 2

    def part(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    return np.sqrt(np.maximum((part(np.broadcast_to(p, q.shape)) + part(q)) / 2, 0))


def _rows(counts: dict) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.binary()),
            pa.array([int(counts[k]) for k in keys], pa.int64()),
        ],
        ["lang", "key", "n"],
    )


_ROWS = "lang string, key binary, n long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes: dict = defaultdict(lambda: np.zeros(len(CLASSES) - 1, np.int64))
    words: dict = defaultdict(Counter)
    total: Counter = Counter()
    short: Counter = Counter()
    for batch in sliced(batches):
        for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            data = text.encode()
            classes[lang] += class_counts(data)
            found = data.split()
            total[lang] += len(found)
            words[lang].update(bare(found))
            if len(c := words[lang]) > 2 * KEPT_WORDS:
                # at most KEPT_WORDS counters are greater than this, and each loses as much as those that go had
                lost = sorted(c.values(), reverse=True)[KEPT_WORDS]
                words[lang] = Counter({w: n - lost for w, n in c.items() if n > lost})
                short[lang] += lost
    out = {(lang, b"\0" + bytes([i])): n for lang, c in classes.items() for i, n in enumerate(c)}
    for lang, c in words.items():
        out |= {(lang, w): n + short[lang] for w, n in c.items() if w and SHARE * (n + short[lang]) >= total[lang]}
    yield _rows(out)


def references(df: DataFrame, text_col: str, lang_col: str) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """By language: counts of character classes, common words' places, their counts (the last: all others).

    Languages without a common word aren't there.
    """
    source = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # written, since ranks by language are asked of it in more than one branch of the plan
    first = cut(in_workers(source, _candidates, _ROWS).groupBy("lang", "key").agg(F.sum("n").alias("n")), "candidates")
    is_class = F.substring("key", 1, 1) == F.lit(b"\0")
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("lang", is_class).orderBy(F.desc("n"), "key")))
    # at most CANDIDATES + 8 rows of a language come to the driver
    rows = ranked.filter(F.col("r") <= CANDIDATES).collect()
    classes: dict = defaultdict(lambda: np.zeros(len(CLASSES) - 1, np.int64))
    candidates: dict = defaultdict(set)
    for r in rows:
        key = bytes(r["key"])
        if key[:1] == b"\0":
            classes[r["lang"]][key[1]] = r["n"]
        else:
            candidates[r["lang"]].add(key)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for batch in sliced(batches):
            for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if lang in candidates:
                    known, found = candidates[lang], bare(text.encode().split())
                    out[lang, b""] += len(found)
                    for w, n in Counter(filter(known.__contains__, found)).items():
                        out[lang, w] += n
        yield _rows(out)

    candidates = dict(candidates)
    rows = in_workers(source, exact, _ROWS).groupBy("lang", "key").agg(F.sum("n").alias("n")).collect() if candidates else []
    counts: dict = defaultdict(dict)
    for r in rows:
        counts[r["lang"]][bytes(r["key"])] = r["n"]
    out = {}
    for lang, found in counts.items():
        all_words = found.pop(b"", 0)
        # what is common in a task only isn't common
        best = sorted((w for w, n in found.items() if SHARE * n >= all_words), key=lambda w: (-found[w], w))[:COMMON]
        if not best:
            continue
        n = np.array([found[w] for w in best] + [all_words - sum(found[w] for w in best)])
        out[lang] = (classes[lang], {w: i for i, w in enumerate(best)}, n)
    return out


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        number: dict = {}
        ids = np.array([number.setdefault(w, len(number)) for w in windows])
        at = np.flatnonzero(np.bincount(ids)[ids] > 1)
        inside = np.zeros(len(words), bool)
        for k in range(3):
            inside[at + k] = True
        repeated = int(inside.sum())
    return word_chars, n_symbols, len(lines) - len(set(lines)), repeated


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 100,
    min_chars: int = 300,
    far_words: float = 0.39,
    far_chars: float = 0.28,
    noise: float = 0.7,
    rows: bool = False,
) -> DataFrame:
    """Per row: the id, base counts, ``base_failed``, ``kept``, the two distances and the nearest language.

    ``far_words`` widens by what chance adds to the distance of few draws: to its
    square, ``noise * (words in the histogram) / (8 * n_words)``. With ``rows``, the kept
    rows of ``df`` come back instead of verdicts. A document whose language has
    no reference is never rejected for its distance.
    """
    at = df.columns.index(text_col) if rows else 1
    own_lang = F.coalesce(df[lang_col].cast("string"), F.lit(""))
    found = references(df, text_col, lang_col)
    shared = df.sparkSession.sparkContext.broadcast(found)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        langs = sorted(refs)
        classes = np.array([refs[x][0] for x in langs], float).reshape(-1, len(CLASSES) - 1)
        # a row for each language: its common words' counts, and all others' in the last column
        common = np.zeros((len(langs), COMMON + 1))
        places: dict = defaultdict(list)
        for i, x in enumerate(langs):
            _, place, counts = refs[x]
            common[i, : len(place)], common[i, -1] = counts[:-1], counts[-1]
            for w, k in place.items():
                places[w].append(i * (COMMON + 1) + k)
        for batch in sliced(batches):
            out: list = [[] for _ in range(10)]
            for text, lang in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                text = text or ""
                data = text.encode()
                words = data.split()
                n = len(words)
                base = base_counts(text, words)
                failed = n < 50 or 100 * base[3] > 50 * n
                near, by_words, by_chars = None, None, None
                if langs:
                    plain = Counter(bare(words))
                    chars = distance(class_counts(data), classes)
                    own = np.zeros(common.shape)
                    for w in plain.keys() & places.keys():
                        own.flat[places[w]] = plain[w]
                    own[:, -1] = n - own.sum(-1)
                    each = distance(own, common)
                    k = int(np.argmin(each + chars))
                    near, by_words, by_chars = langs[k], float(each[k]), float(chars[k])
                kept = not failed
                if kept and lang in refs:
                    if n >= min_words and by_words > (far_words**2 + noise * COMMON / n / 8) ** 0.5:
                        kept = False
                    if base[0] >= min_chars and by_chars > far_chars:
                        kept = False
                for column, v in zip(out, (n, *base, failed, kept, by_words, by_chars, near), strict=True):
                    column.append(v)
            if rows:
                kept_rows = batch.filter(pa.array(out[6], pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept_rows.columns[:-1], schema=pa.schema(list(kept_rows.schema)[:-1]))
                continue
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=_NAMES
            )

    if rows:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return in_workers(df.select("*", own_lang.alias("_lang")), score, kinds)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = ", ".join(f"{n} {t}" for n, t in zip(_NAMES, [id_type, *_TYPES], strict=True))
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"), own_lang.alias("lang"))
    return in_workers(source, score, schema).withColumnRenamed("id", id_col)


_NAMES = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_distance", "char_distance", "nearest"]
_TYPES = ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2 + ["string"]


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that the rules keep, with its columns.

    The verdict is given in the same pass that reads the row, so rows need no
    id, and no text is shuffled.
    """
    return judge(df, text_col=text_col, lang_col=lang_col, rows=True)


def op4_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
