"""Secrets by fixed patterns and a linear-chain conditional random field.

The patterns find assignments, access keys and hexadecimal strings; their spans
always stay. A CRF tags words as begin, inside or outside of a secret and adds
spans where no pattern matched. A word's scores come from its shape, length,
letters and mark-up, from its neighbours' words, and from features of the file:
its size, and its share of words that look like code.

The CRF is trained on the driver: background from a bounded sample of documents
(``sample_rows``), with secrets of many formats written into half of its
windows. Training maximises the likelihood by stochastic gradients over
forward-backward sums.

Decoding is exact Viterbi. Where "outside" beats the other tags by more than all
transitions can make up for, it is part of every best path; so only the short
runs between such words need the recursion.

Defined cases: null texts count as empty; rows are scanned one by one, so
repeated rows and ids give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from weft.llm.common import by_hash, in_workers, sliced, table

# Fixed patterns of the base kinds. Letters of the keywords count in either case, in ASCII only.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
PLACES = 1 << 14
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'`,.;:()[]{}<>"
#: Words that tell of a secret nearby; other plain words are alike.
TRIGGERS = frozenset(
    "password passwd secret token apikey api_key key auth authorization bearer credential credentials private pwd login client access aws signing".split()
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def plain(word: str) -> bool:
    """Words of letters with a mark at the end at most: all of a shape and length are alike."""
    return word.isalpha() or word[:-1].isalpha()


def shape(word: str) -> str:
    out = []
    for c in word[:40]:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if c.isascii() else "u"
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:12])


def features(word: str) -> tuple[list[str], list[str]]:
    """A word's features for itself, and those it gives its neighbours."""
    core = word.strip(_EDGES)
    low = core.lower()
    size = min(len(core).bit_length(), 8)
    trigger = low.rstrip("=:") if low.rstrip("=:") in TRIGGERS else ""
    last = word[-1:] if word[-1:] in "=:" else ""
    if plain(word) and not trigger:
        kind = "A" if word.isupper() else "Aa" if word[:1].isupper() else "a"
        return [f"plain {kind} {size}"], [f"plain {kind}"]
    distinct = len(set(core))
    digits = sum(map(str.isdigit, core))
    capitals = sum(map(str.isupper, core))
    mixed = (digits > 0) + (capitals > 0) + (len(core) - digits - capitals > 0)
    own = [
        f"shape {shape(core)}",
        f"size {size} mixed {mixed}",
        f"distinct {min(distinct // 4, 6)} size {size}",
        f"digits {4 * digits // max(len(core), 1)} size {size}",
        f"start {core[:4] if len(core) > 12 else ''}",
        f"marks {''.join(sorted(set(c for c in core if not c.isalnum())))[:4]} size {size}",
        f"trigger {trigger}{last}",
        "assigned" if re.search(r"[=:]\S{8,}", core) else "bare",
    ]
    return own, [f"trigger {trigger}{last}", f"mark {last}", f"size {size}"]


def file_features(n: int, coded: int) -> list[str]:
    return [f"words {min(n.bit_length(), 12)}", f"code {min(20 * coded // max(n, 1), 5)}"]


def _place(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % PLACES


class Crf(NamedTuple):
    own: np.ndarray  # PLACES x 3; likewise for the word after and before, and the file
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    moves: np.ndarray  # 3 x 3

    def open_words(self, e: np.ndarray) -> np.ndarray:
        """Places where "outside" need not be part of the best path.

        Elsewhere a path with another tag x there is beaten by the one with
        "outside" there: it differs by the word's own scores, and by at most
        what transitions make up for. If the next word is inside, which can't
        follow "outside", it becomes a beginning in that other path.
        """
        t, tags = self.moves, range(3)
        ends = (BEGIN, OUTSIDE)
        into = {x: max(t[a, x] - t[a, OUTSIDE] for a in tags) for x in (BEGIN, INSIDE)}
        plainly = max(into[x] + max(t[x, b] - t[OUTSIDE, b] for b in ends) for x in into)
        instead = max(into[x] + t[x, INSIDE] - t[OUTSIDE, BEGIN] for x in into) + max(t[INSIDE, c] - t[BEGIN, c] for c in tags)
        gain = np.full(len(e), plainly)
        gain[:-1] = np.maximum(gain[:-1], instead + e[1:, INSIDE] - e[1:, BEGIN])
        return np.flatnonzero(e[:, OUTSIDE] - np.maximum(e[:, BEGIN], e[:, INSIDE]) <= np.maximum(gain, 0))


FORBIDDEN = -1e4


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tags of a run with "outside" on both sides."""
    best = scores[0] + moves[OUTSIDE]
    back = []
    for row in scores[1:]:
        paths = best[:, None] + moves
        back.append(paths.argmax(0))
        best = paths.max(0) + row
    tag = int((best + moves[:, OUTSIDE]).argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return tags[::-1]


class Scores(dict):
    """Rows of a word's three kinds of scores, by word; emptied when full."""

    LIMIT = 300_000

    def __init__(self, crf: Crf):
        self.crf = crf
        self.alike: dict = {}
        self.rows = np.zeros((1024, 9))
        self.coded = np.zeros(1024, bool)
        self.used = 0

    def __missing__(self, word: str) -> int:
        if alike := plain(word) and word.strip(_EDGES).lower() not in TRIGGERS:
            key = (len(word.strip(_EDGES)).bit_length(), word.isupper(), word[:1].isupper())
            if key in self.alike:
                return self.alike[key]
        elif len(self) >= self.LIMIT:
            raise OverflowError
        own, near = features(word)
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.coded = np.concatenate([self.coded, np.zeros_like(self.coded)])
        i = self.used
        self.used += 1
        near = [_place(f) for f in near]
        self.rows[i, :3] = self.crf.own[[_place(f) for f in own]].sum(0)
        self.rows[i, 3:6] = self.crf.before[near].sum(0)
        self.rows[i, 6:] = self.crf.after[near].sum(0)
        self.coded[i] = not alike
        if alike:
            self.alike[key] = i
        else:
            self[word] = i
        return i

    def forget(self) -> None:
        self.clear()
        self.alike.clear()
        self.used = 0

    def rows_of(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        except OverflowError:
            self.forget()
            limit, self.LIMIT = self.LIMIT, len(words) + 1  # one text may need more, this once
            try:
                return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            finally:
                self.LIMIT = limit


class Tagger:
    def __init__(self, crf: Crf):
        self.crf, self.scores = crf, Scores(crf)

    def secret_words(self, words: list[str]) -> list[tuple[int, int]]:
        """Ranges of words that the best path tags as secrets."""
        if not words:
            return []
        at = self.scores.rows_of(words)
        rows = self.scores.rows[at]
        e = rows[:, :3].copy()
        e[1:] += rows[:-1, 3:6]
        e[:-1] += rows[1:, 6:]
        e += self.crf.file[[_place(f) for f in file_features(len(words), int(self.scores.coded[at].sum()))]].sum(0)
        open_ = self.crf.open_words(e)
        out = []
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
            for k, tag in enumerate(viterbi(e[run], self.crf.moves)):
                w = int(run[0]) + k
                if tag == BEGIN:
                    out.append((w, w + 1))
                elif tag == INSIDE:
                    out[-1] = (out[-1][0], w + 1)
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans: the patterns', and the model's that overlap none of them."""
        base = base_spans(text)
        found = self.secret_words(_words(text))
        if not found:
            return base
        places = [m.span() for m in _WORD.finditer(text)]
        added = []
        for a, b in found:
            start, end = places[a][0], places[b - 1][1]
            inner = text[start:end]
            if m := re.search(r"[=:][\"']?(?=\S{8,}$)", inner):
                start, inner = start + m.end(), inner[m.end() :]
            start += len(inner) - len(inner.lstrip(_EDGES))
            end = start + len(inner.strip(_EDGES))
            if end > start and not any(x < end and start < y for x, y, _ in base):
                added.append((start, end, "model"))
        return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _words(text: str) -> list[str]:
    """Words between ASCII blanks; like ``_WORD.findall``, through bytes where the text has other white space."""
    return text.split() if text.isascii() and not _SEPARATORS.search(text) else _WORD.findall(text)


_SEPARATORS = re.compile(r"[\x1c-\x1f]")

# --- training ---------------------------------------------------------------

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def made_up_secret(rng: random.Random) -> list[str]:
    """Words of a made-up secret, with what stands before it; the tagged ones start with a NUL."""

    def some(n: int, letters: str = _ALNUM) -> str:
        return "".join(rng.choice(letters) for _ in range(n))

    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = rng.choice(["password", "secret", "token", "api_key", "apikey", "client_secret", "auth_token", "SECRET_KEY", "passwd"])
    q = rng.choice(["", '"', "'"])
    kinds = [
        lambda: [word, rng.choice("=:"), f"\0{q}{some(rng.randint(16, 44), rng.choice([hexa, _ALNUM]))}{q}"],
        lambda: [f"\0{word}{rng.choice('=:')}{q}{some(rng.randint(16, 44))}{q}"],
        lambda: [f"\0AKIA{some(16, upper)}"],
        lambda: [f"\0{rng.choice(['ghp', 'gho', 'ghs'])}_{some(36)}"],
        lambda: [f"\0{rng.choice(['sk', 'pk', 'rk'])}_{rng.choice(['live', 'test'])}_{some(rng.randint(20, 32))}"],
        lambda: [f"\0xox{rng.choice('bpa')}-{some(12, '0123456789')}-{some(24)}"],
        lambda: ["Authorization:", "Bearer", f"\0eyJ{some(30)}.{some(40)}.{some(30)}"],
        lambda: [f"\0AIza{some(35)}"],
        lambda: [f"\0{some(rng.randint(32, 48), _ALNUM + '+/')}="],
        lambda: [f"\0{some(rng.choice([32, 40, 64]), hexa)}"],
        lambda: ["-----BEGIN", "PRIVATE", "KEY-----", f"\0{some(48, _ALNUM + '+/')}", f"\0{some(48, _ALNUM + '+/')}"],
    ]
    return rng.choice(kinds)()


def made_up_other(rng: random.Random) -> list[str]:
    """Words that are long or odd, but no secrets."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéèñó") for _ in range(k))

    def url() -> list[str]:
        path = "".join("/" + letters(rng.randint(1, 10)) for _ in range(rng.randint(0, 4)))
        query = rng.choice(["", "", f"?{letters(rng.randint(1, 4))}={n(rng.randint(1, 5))}", f"#{letters(5)}", ".html"])
        end = rng.choice(["", "", ".", ",", ")"])
        return [f"{rng.choice(['https://', 'http://', 'www.'])}{letters(rng.randint(3, 12))}.{rng.choice(['org', 'com', 'net', 'io', 'example.org'])}{path}{query}{end}"]

    kinds = [
        lambda: [f"{letters(6)}.{n(2)}@mail{n(1)}.example.com"],
        url,
        url,
        lambda: [f"{n(3)}.{n(2)}.{n(3)}.{n(2)}"],
        lambda: ["+1", f"({n(3)})", f"{n(3)}-{n(4)}"],
        lambda: [letters(rng.randint(12, 40))],
        lambda: [f"{letters(5)}_{letters(6)}_{letters(4)}", "=", n(2)],
        lambda: [letters(rng.randint(5, 24)).capitalize() + rng.choice([".", ",", ""]) + rng.choice(["***", "###", "$$$", "&&&", "%%%", "!!", "|"])],
        lambda: [letters(rng.randint(5, 24)).upper() + rng.choice([".", ",", ""]) + rng.choice(["***", "###", "!!", "!!", "..."])],
        lambda: [letters(rng.randint(3, 20)) + rng.choice(["***", "###", "$$$", "&&&", "%%%", "!!"])],
        lambda: [f"20{n(2)}-0{n(1)}-1{n(1)}T0{n(1)}:{n(2)}:{n(2)}"],
        lambda: [f"/{letters(5)}/{letters(7)}/{letters(9)}.py"],
        lambda: [letters(9).upper(), n(rng.randint(1, 8))],
        lambda: [f"{letters(7)}-{letters(6)}-{letters(5)}", "token", letters(4)],
    ]
    return rng.choice(kinds)()


def training_windows(texts: list[str], per_text: int = 4, seed: int = 5) -> list[tuple[list[str], list[int], int, int]]:
    """(words, tags, words in the file, coded words in the file)."""
    rng = random.Random(seed)
    out = []
    for text in texts or [""]:
        words = _words(text) or ["the", "and", "of"]
        clean = [w for w in words if not HEX.search(w) and "AKIA" not in w]
        for _ in range(per_text):
            at = rng.randrange(max(len(clean) - 16, 1))
            window, tags = clean[at : at + 16], []
            put = rng.random()
            new = made_up_secret(rng) if put < 0.45 else made_up_other(rng) if put < 0.85 else []
            k = rng.randrange(len(window) + 1)
            window = window[:k] + new + window[k:]
            for w in window:
                inside = w.startswith("\0")
                tags.append((INSIDE if tags and tags[-1] != OUTSIDE else BEGIN) if inside else OUTSIDE)
            coded = sum(not plain(w) for w in words)
            out.append(([w.lstrip("\0") for w in window], tags, len(words), coded))
    return out


def train(windows: list, epochs: int = 4, rate: float = 0.2, l2: float = 1e-4, seed: int = 3) -> Crf:
    own, before, after, file = (np.zeros((PLACES, 3)) for _ in range(4))
    moves = np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = FORBIDDEN
    allowed = moves == 0
    squares = [np.full(x.shape, 1e-3) for x in (own, before, after, file, moves)]
    rng = np.random.default_rng(seed)
    made = []
    for words, tags, n, coded in windows:
        f = [features(w) for w in words]
        made.append(([[_place(x) for x in o] for o, _ in f], [[_place(x) for x in k] for _, k in f], [_place(x) for x in file_features(n, coded)], np.array(tags)))

    def step(table, square, at, g):
        at = np.asarray(at)
        g = g + l2 * table[at]
        np.add.at(square, at, g * g)
        table[at] -= rate * g / np.sqrt(square[at])

    for _ in range(epochs):
        for i in rng.permutation(len(made)):
            o, near, whole, tags = made[i]
            n = len(tags)
            e = np.array([own[x].sum(0) for x in o])
            around = np.array([before[x].sum(0) for x in near]), np.array([after[x].sum(0) for x in near])
            e[1:] += around[0][:-1]
            e[:-1] += around[1][1:]
            e += file[whole].sum(0)
            # forward-backward in logarithms, "outside" on both sides
            f, b = np.empty((n, 3)), np.empty((n, 3))
            f[0] = e[0] + moves[OUTSIDE]
            for t in range(1, n):
                x = f[t - 1][:, None] + moves
                m = x.max(0)
                f[t] = e[t] + m + np.log(np.exp(x - m).sum(0))
            b[-1] = moves[:, OUTSIDE]
            for t in range(n - 2, -1, -1):
                x = moves + (e[t + 1] + b[t + 1])[None, :]
                m = x.max(1)
                b[t] = m + np.log(np.exp(x - m[:, None]).sum(1))
            end = f[-1] + b[-1]
            z = end.max() + np.log(np.exp(end - end.max()).sum())
            p = np.exp(f + b - z)
            g = p.copy()
            g[np.arange(n), tags] -= 1
            gm = np.zeros((3, 3))
            for t in range(1, n):
                gm += np.exp(np.clip(f[t - 1][:, None] + moves + (e[t] + b[t])[None, :] - z, -700, 0))
                gm[tags[t - 1], tags[t]] -= 1
            for t in range(n):
                step(own, squares[0], o[t], g[t])
                if t:
                    step(before, squares[1], near[t - 1], g[t])
                if t + 1 < n:
                    step(after, squares[2], near[t + 1], g[t])
            step(file, squares[3], whole, g.sum(0) / n)
            squares[4] += gm * gm
            moves -= np.where(allowed, rate * gm / np.sqrt(squares[4]), 0)
    return Crf(own, before, after, file, moves)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 300) -> DataFrame:
    """Per row: the id, n_assign, n_access, n_hex, base_sha256, spans and n_model.

    The model's background is cut anywhere from the whole texts of ``sample_rows``
    rows, those of the whole table with the least hashes of id and text.
    """
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    sample = [r["text"] or "" for r in by_hash(source, ["id", "text"], sample_rows).collect()]
    shared = df.sparkSession.sparkContext.broadcast(train(training_windows(sample)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in sliced(batches):
            out = []
            for text in batch.column(1).to_pylist():
                spans = tagger.spans(text or "")
                base = joined([s for s in spans if s[2] != "model"])
                kinds = [s[2] for s in spans]
                out.append((*map(kinds.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                ["id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"
    return in_workers(source, scan, schema).withColumnRenamed("id", id_col)


def op6_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))
