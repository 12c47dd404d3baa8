"""SentencePiece encoding and decoding with N-best segmentations.

A text's pieces form a lattice. Forward Viterbi scores give, for each place, the
best score of any way there; they are the exact heuristic of a backward A-star
search, which therefore takes up only places on the N best paths, best first.

The lattice is cut where no piece of the vocabulary holds the two characters on
either side together: every path passes there. So each distinct run is searched
once and cached, and a text's N best paths are put together from its runs' lists.
Only the N - 1 runs whose second choice costs least can differ from their best.

New runs of a batch take the forward pass together: columns of a NumPy table are
the places, rows the runs, and a trie in arrays is walked by all runs at once.

Characters outside the vocabulary become byte pieces, as in the library. Besides
the lattice's paths, ``merged`` ids are those that the library itself gives: for
a model of merges they may differ from the path with the best score.

Defined cases: null and empty texts have no pieces and one empty path; fewer
paths than asked for are fewer results; repeated rows are encoded one by one;
other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import struct
import sys
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import chain, zip_longest
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import in_workers, sliced, table

SPACE = "▁"
#: What an unknown character costs beyond the rarest piece.
UNKNOWN_COST = 10.0
#: Runs that a worker's cache may hold; it is emptied when full.
CACHE_RUNS = 400_000
#: Runs up to this length take the forward pass together, so many at once.
SHORT, TOGETHER = 48, 8192
#: Characters of a text that are cut into runs at once.
SLICE = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = struct.unpack("<f" if n == 4 else "<d", data[i : i + n])[0], i + n
        yield key >> 3, value


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    NORMAL, USER_DEFINED, BYTE = 1, 4, 6

    def __init__(self, path: str):
        pieces = [dict(_fields(v)) for k, v in _fields(Path(path).read_bytes()) if k == 1]
        self.text = [p[1].decode() for p in pieces]
        kinds = [p.get(3, self.NORMAL) for p in pieces]
        self.kinds = kinds
        usable = [i for i, k in enumerate(kinds) if k in (self.NORMAL, self.USER_DEFINED)]
        self.score = {self.text[i]: (i, float(pieces[i].get(2, 0.0))) for i in usable}
        self.bytes = {int(self.text[i][1:-1], 16): i for i, k in enumerate(kinds) if k == self.BYTE}
        # some models mark pieces with a score far below all ranks; they aren't a measure of rarity
        self.unknown = min((s for _, s in self.score.values() if s > -1e8), default=0.0) - UNKNOWN_COST
        self.longest = max(map(len, self.score), default=1)
        # one table to walk: a piece's id and score, or None for what only begins pieces
        self.walk = {p[:k]: self.score.get(p[:k]) for p in self.score for k in range(1, len(p) + 1)}
        self.together = {(p[k], p[k + 1]) for p in self.score for k in range(len(p) - 1)}
        self.data = [
            bytes([int(t[1:-1], 16)]) if k == self.BYTE else t.replace(SPACE, " ").encode() if k in (1, 4) else b""
            for t, k in zip(self.text, kinds, strict=True)
        ]
        self._trie: Trie | None = None

    def trie(self) -> Trie:
        if self._trie is None:
            self._trie = Trie(self.score)
        return self._trie

    def forward(self, run: str) -> tuple[list[float], list[float], list]:
        """By place: the two best scores of any way there, and the best one's last step.

        The second best way to a place is one of the two best ways to some place
        before, and an edge. A step is (start, id), of unknown characters (start, -1).
        """
        n, walk, longest = len(run), self.walk.get, self.longest
        low = float("-inf")
        first, second = [low] * (n + 1), [low] * (n + 1)
        back: list = [None] * (n + 1)
        first[0] = 0.0
        for a in range(n):
            one, two = first[a], second[a]
            known = False
            for b in range(a + 1, min(n, a + longest) + 1):
                hit = walk(run[a:b], low)
                if hit is low:
                    break
                if not hit:
                    continue
                if b == a + 1:
                    known = True
                s = one + hit[1]
                if s > first[b]:
                    second[b] = first[b]
                    first[b] = s
                    back[b] = (a, hit[0])
                elif s > second[b]:
                    second[b] = s
                s = two + hit[1]
                if s > second[b]:
                    second[b] = s
            if not known:
                b, s = a + 1, one + self.unknown
                if s > first[b]:
                    second[b] = first[b]
                    first[b] = s
                    back[b] = (a, -1)
                elif s > second[b]:
                    second[b] = s
                if two + self.unknown > second[b]:
                    second[b] = two + self.unknown
        return first, second, back

    def spelt(self, c: str) -> tuple[int, ...]:
        """The ids of a character without a piece: its bytes."""
        return tuple(self.bytes[x] for x in c.encode()) if self.bytes else (0,)

    def best(self, run: str) -> tuple[float, float, list[int]]:
        """Score of the best path, what the second best costs more, and the best's ids."""
        first, second, back = self.forward(run)
        ids, at = [], len(run)
        while at:
            a, i = back[at]
            ids += [i] if i >= 0 else reversed(self.spelt(run[a]))
            at = a
        ids.reverse()
        return first[-1], first[-1] - second[-1], ids

    def best_of_many(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of short runs, longest first: scores, costs, numbers of ids, all ids."""
        trie = self.trie()
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        count, wide = len(runs), int(sizes[0])
        # a column for each character, so that what one step touches lies together
        codes = np.zeros((count, wide), np.int32)
        codes[np.arange(wide) < sizes[:, None]] = codes_of("".join(runs))
        codes = np.ascontiguousarray(codes.T)
        classes = trie.class_of[codes]
        first = np.full((wide + 1, count), -np.inf)
        second = np.full((wide + 1, count), -np.inf)
        start, step = np.zeros((wide + 1, count), np.int32), np.zeros((wide + 1, count), np.int32)
        first[0] = 0.0
        every = np.arange(count)
        # runs that have a character at each place: the first so many
        longer = np.searchsorted(-sizes, -np.arange(wide + 1), "left")
        for a in range(wide):
            rows = every[: longer[a]]
            node = trie.roots[classes[a, : longer[a]]]
            if len(r := np.flatnonzero(node == 0)):  # characters without a piece, as the negatives of their codes
                s, b = first[a, r] + self.unknown, a + 1
                better = s > first[b, r]
                runner = np.maximum(np.where(better, first[b, r], s), second[a, r] + self.unknown)
                second[b, r] = np.maximum(second[b, r], runner)
                r = r[better]
                first[b, r], start[b, r], step[b, r] = s[better], a, -2 - codes[a, r]
                rows = np.flatnonzero(node)
                node = node[rows]
            for b in range(a + 1, min(wide, a + self.longest) + 1):
                piece = trie.piece[node]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    r, i = rows[hit], piece[hit]
                    gain = trie.score[i]
                    s, had = first[a, r] + gain, first[b, r]
                    better = s > had
                    runner = np.maximum(np.where(better, had, s), second[a, r] + gain)
                    second[b, r] = np.maximum(second[b, r], runner)
                    r = r[better]
                    first[b, r], start[b, r], step[b, r] = s[better], a, i[better]
                if b == wide:
                    break
                on = np.searchsorted(rows, longer[b])
                rows, node = rows[:on], node[:on]
                node = trie.next(node, classes[b, rows])
                alive = np.flatnonzero(node)
                if not len(alive):
                    break
                rows, node = rows[alive], node[alive]
        # back from the ends, all runs at once; ids are filled from the right
        found = np.full((count, wide), -1, np.int32)
        rows, at, k = every, sizes, wide
        while len(rows):
            k -= 1
            found[rows, k] = step[at, rows]
            at = start[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        n, ids = (found != -1).sum(1), found[found != -1]
        if (found < -1).any():
            places = np.flatnonzero(ids < -1)
            spelt = {int(c): self.spelt(chr(-2 - c)) for c in np.unique(ids[places])}
            times = np.ones(len(ids), np.int64)
            times[places] = [len(spelt[c]) for c in ids[places].tolist()]
            n = n + np.bincount(np.nonzero(found < -1)[0], times[places] - 1, count).astype(np.int64)
            wide_ids = np.repeat(ids, times)
            starts = np.cumsum(times) - times
            for c, x in spelt.items():
                at = starts[places[ids[places] == c]]
                for k, i in enumerate(x):
                    wide_ids[at + k] = i
            ids = wide_ids
        best = first[sizes, every]
        return best, best - second[sizes, every], n, ids

    def n_best(self, run: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the best ``n`` paths, best first; ties by fewer and then smaller ids.

        An entry of the agenda has the score of a whole path, and different entries
        stand for different paths. So what is worse than ``n`` others needn't be kept.
        """
        best = self.forward(run)[0]
        scores, longest = self.score.get, self.longest
        agenda = [(-best[-1], len(run), Suffix((), None), 0.0)]
        limits = [-best[-1]]
        found: list = []
        while agenda and len(found) < n:
            total, at, suffix, tail = heapq.heappop(agenda)
            if at == 0:
                found.append((tail, suffix.all()))
                continue
            steps = [(a, (hit[0],), hit[1]) for a in range(max(0, at - longest), at) if (hit := scores(run[a:at]))]
            if not (steps and steps[-1][0] == at - 1):
                steps.append((at - 1, self.spelt(run[at - 1]), self.unknown))
            inherited = False
            for a, ids, s in steps:
                cost = -(best[a] + s + tail)
                if not inherited and cost == total:
                    inherited = True
                elif len(limits) < n or cost <= limits[-1]:
                    insort(limits, cost)
                    del limits[n:]
                else:
                    continue
                heapq.heappush(agenda, (cost, a, Suffix(ids, suffix), s + tail))
        return found


class Suffix:
    """The last ids of a path, as a chain; compared from the front."""

    __slots__ = ("ids", "rest")

    def __init__(self, ids: tuple[int, ...], rest: Suffix | None):
        self.ids, self.rest = ids, rest

    def steps(self) -> Iterator[tuple[int, ...]]:
        x: Suffix | None = self
        while x is not None:
            yield x.ids
            x = x.rest

    def all(self) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.steps()))

    def __lt__(self, other: Suffix) -> bool:
        pairs = zip_longest(chain.from_iterable(self.steps()), chain.from_iterable(other.steps()), fillvalue=-1)
        return next((x < y for x, y in pairs if x != y), False)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Trie:
    """Pieces in arrays: a node's child for a class of characters is at the node's base plus the class.

    Nodes are places of the arrays; 0 is none. ``class_of`` has 0 for characters that
    aren't pieces themselves.
    """

    def __init__(self, score: dict[str, tuple[int, float]]):
        letters = sorted(p for p in score if len(p) == 1)
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[codes_of("".join(letters))] = np.arange(1, len(letters) + 1)
        number = {c: i for i, c in enumerate(letters, 1)}
        children: dict[str, set[str]] = {}
        for p in score:
            if all(c in number for c in p):
                for k in range(1, len(p) + 1):
                    children.setdefault(p[: k - 1], set()).add(p[k - 1])
        room = 4 * sum(map(len, children.values())) + 2 * len(letters) + 64
        self.base, self.owner = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        self.piece = np.full(room, -1, np.int32)
        self.score = np.zeros(1 + max((i for i, _ in score.values()), default=0))
        for i, s in score.values():
            self.score[i] = s
        self.roots = np.zeros(len(letters) + 1, np.int32)
        taken = bytearray(room)
        taken[0] = 1
        free = 1
        level = [("", 0)]
        while level:
            below = []
            for text, node in level:
                if text not in children:
                    continue
                inside = sorted(number[c] for c in children[text])
                while taken[free]:
                    free += 1
                at = max(free, inside[0])
                while taken[at] or any(taken[at - inside[0] + c] for c in inside[1:]):
                    at += 1
                base = at - inside[0]
                self.base[node] = base
                for c in inside:
                    taken[base + c] = 1
                    self.owner[base + c] = node
                    part = text + letters[c - 1]
                    if part in score:
                        self.piece[base + c] = score[part][0]
                    if not text:
                        self.roots[c] = base + c
                    below.append((part, base + c))
            level = below

    def next(self, node: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The children, 0 where there is none."""
        child = self.base[node] + classes
        return np.where(self.owner[child] == node, child, 0)


def _packed(ids) -> bytes:
    """Little-endian 32-bit numbers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Pool:
    """Lists of ids end to end; grows."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 16, "<u4"), 0

    def add(self, ids: np.ndarray) -> int:
        """Where ``ids`` are from now on."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(ids)), "<u4")])
        self.ids[at : self.used] = ids
        return at

    def gather(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The lists at ``at`` with ``n`` ids each, one after another."""
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(at - ends + n, n) + np.arange(total)]


class Encoder:
    """Encodes and decodes texts; keeps the runs it has seen, by their text without the blank before."""

    def __init__(self, path: str):
        import sentencepiece

        self.vocabulary = Vocabulary(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.blank = self.library.piece_to_id(SPACE)
        self.begins = np.array([t.startswith(SPACE) for t in self.vocabulary.text])
        self.forget()

    def forget(self) -> None:
        """Starts the caches anew. Numbers of runs lose their meaning."""
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.best, self.merged = Pool(), Pool()
        #: By run: best score, what the second choice costs more, place and number
        #: of the best path's ids, the same of the library's, whether both decode to it.
        self.facts = np.empty(
            1 << 12,
            [("score", "f8"), ("cost", "f8"), ("at", "i8"), ("n", "i4"), ("merged_at", "i8"), ("merged_n", "i4"), ("decodes", "?")],
        )
        self.parts: dict[str, tuple[float, bytes]] = {}
        self.lists: dict = {}

    def numbers(self, words: list[str]) -> np.ndarray:
        """The runs' numbers; those that are new are encoded first."""
        try:
            return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn([w for w in dict.fromkeys(words) if w not in self.number])
            return self.numbers(words)

    def learn(self, new: list[str]) -> None:
        plain, other = [], []
        for w in new:
            (plain if 0 < len(w) < SHORT and SPACE not in w else other).append(w)
        plain.sort(key=len, reverse=True)
        for at in range(0, len(plain), TOGETHER):
            self.learn_plain(plain[at : at + TOGETHER])
        for w in other:
            merged = np.array(self.library.encode(w.replace(SPACE, " ")), "<u4") if w else np.array([self.blank], "<u4")
            score, cost, data = self.part(SPACE + w)
            self.keep([w], [score], [cost], np.frombuffer(data, "<u4"), [len(data) // 4], merged, [len(merged)])

    def learn_plain(self, words: list[str]) -> None:
        score, cost, n, ids = self.vocabulary.best_of_many([SPACE + w for w in words])
        # no piece reaches over a blank into the next word, so the library may have them all at once
        merged = np.array(self.library.encode(" ".join(words)), "<u4")
        starts = np.flatnonzero(self.begins[merged])
        if len(starts) == len(words):
            merged_n = np.diff(np.r_[starts, len(merged)])
        else:
            each = self.library.encode(words, num_threads=1)
            merged_n = np.fromiter(map(len, each), np.int64, len(each))
            merged = np.fromiter(chain.from_iterable(each), "<u4", int(merged_n.sum()))
        self.keep(words, score, cost, ids, n, merged, merged_n)

    def keep(self, words: list[str], score, cost, ids, n, merged, merged_n) -> None:
        a = len(self.texts)
        if a + len(words) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.empty(max(len(self.facts), len(words)), self.facts.dtype)])
        self.texts += [SPACE + w for w in words]
        self.number.update(zip(words, range(a, a + len(words)), strict=True))
        f = self.facts[a : a + len(words)]
        f["score"], f["cost"], f["n"], f["merged_n"] = score, cost, n, merged_n
        f["at"] = self.best.add(ids) + np.r_[0, np.cumsum(n)[:-1]]
        f["merged_at"] = self.merged.add(merged) + np.r_[0, np.cumsum(merged_n)[:-1]]
        f["decodes"] = self.all_decode(words, ids, n) and self.all_decode(words, merged, merged_n)
        if not f["decodes"].all():
            for i, w in enumerate(words):
                both = [p.gather(f[at][i : i + 1], f[size][i : i + 1]) for p, at, size in ((self.best, "at", "n"), (self.merged, "merged_at", "merged_n"))]
                f["decodes"][i] = all(self.bytes_of(x) == (" " + w).encode() for x in both)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.data.__getitem__, ids.tolist()))

    def all_decode(self, words: list[str], ids: np.ndarray, n) -> bool:
        """Whether each run's ids decode to it: all do together, and each begins with its blank, which it has once."""
        n, text = np.asarray(n), " " + " ".join(words)
        starts = np.cumsum(n) - n
        begins = self.begins[ids]
        return (
            bool(n.all() and begins[starts].all() and begins.sum() == len(words))
            and text.count(" ") == len(words)
            and SPACE not in text
            and self.bytes_of(ids) == text.encode()
        )

    def part(self, text: str) -> tuple[float, float, bytes]:
        """(score, cost of the second choice, ids) of any run; cut where it can be."""
        if len(parts := self.cut(text)) > 1:
            found = [self.part(p) for p in parts]
            return sum(x[0] for x in found), min(x[1] for x in found), b"".join([x[2] for x in found])
        hit = self.parts.get(text)
        if hit is None:
            score, cost, ids = self.vocabulary.best(text)
            hit = score, cost, _packed(ids)
            if len(text) <= SHORT:
                if len(self.parts) > CACHE_RUNS // 4:
                    self.parts.clear()
                self.parts[text] = hit
        return hit

    def cut(self, text: str) -> list[str]:
        """The text's parts: no piece reaches over their ends."""
        if text[1:].isalpha() and len(text) <= SHORT:  # words of letters are rarely cut, and needn't be
            return [text]
        together = self.vocabulary.together
        cuts = [i for i, pair in enumerate(zip(text, text[1:], strict=False), 1) if pair not in together]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def list_of(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """(cost beyond the best, ids) of a run's best ``n`` paths."""
        found = self.lists.get((text, n))
        if found is None:
            if len(parts := self.cut(text)) > 1:
                each = [self.part(p) for p in parts]
                costs = np.array([x[1] for x in each])
                size = np.array([len(x[2]) for x in each])
                found = self.combined(b"".join([x[2] for x in each]), costs, size, parts.__getitem__, n)
            else:
                paths = self.vocabulary.n_best(text, n)
                found = [(paths[0][0] - s, _packed(ids)) for s, ids in paths]
            for _, ids in found:
                if self.plain(ids) != text.replace(SPACE, " "):
                    raise ValueError(f"a path of {text!r} does not decode to it")
            if len(text) <= SHORT:
                if len(self.lists) > 50_000:
                    self.lists.clear()
                self.lists[text, n] = found
        return found

    def combined(self, best: bytes, costs: np.ndarray, size: np.ndarray, text_of, n: int) -> list[tuple[float, bytes]]:
        """The best ``n`` ways through runs, as (cost beyond the best, ids).

        ``best`` has the ids of the runs' best ways; ``costs``, ``size`` in bytes and
        ``text_of`` are by run.
        """
        order = np.argsort(costs, kind="stable")[: n - 1]
        order = np.sort(order[np.isfinite(costs[order])])
        ends = np.cumsum(size)
        places = [(int(ends[i] - size[i]), int(ends[i])) for i in order]
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        lists = [self.list_of(text_of(i), n) for i in order]
        for choices in lists:
            ways = heapq.nsmallest(
                n, ((c + d, (*picks, k)) for c, picks in ways for k, (d, _) in enumerate(choices)), key=lambda w: w
            )
        out = []
        for cost, picks in ways:
            mine, at = [], 0
            for (a, b), choices, k in zip(places, lists, picks, strict=True):
                if k:
                    mine += [best[at:a], choices[k][1]]
                    at = b
            out.append((cost, b"".join([*mine, best[at:]])))
        return out

    def words_of(self, text: str) -> list[str]:
        """A text's runs without the blank before each."""
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        escaped = SPACE + text.replace(" ", SPACE)
        return [r[1:] for r in re.findall(f"{SPACE}+[^{SPACE}]*", escaped)]

    def runs_of(self, text: str) -> np.ndarray:
        """Numbers of a text's runs. A long text is taken in slices; they end before a blank after another character."""
        found, at = [], 0
        ends = re.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")
        while True:
            end = m.start() if len(text) - at > SLICE and (m := ends.search(text, at + SLICE)) else len(text)
            if at < end:
                found.append(self.numbers(self.words_of(text[at:end])))
            if end == len(text):
                return np.concatenate(found)
            at = end + 1

    def encode_many(self, texts: list[str], n: int) -> Iterator[tuple[list[tuple[float, bytes]], bytes, bool]]:
        """Per text: (score, ids) of the best ``n`` paths, the library's ids, and whether its
        and the best path's decode to the text. New runs of short texts are learnt together."""
        at = 0
        while at < len(texts):
            group = [texts[at]]
            size = len(texts[at])
            while at + len(group) < len(texts) and (size := size + len(texts[at + len(group)])) <= SLICE:
                group.append(texts[at + len(group)])
            at += len(group)
            if len(self.number) >= CACHE_RUNS:
                self.forget()
            if len(group) == 1:
                runs = [self.runs_of(t) if t else None for t in group]
            else:
                words = [self.words_of(t) if t else [] for t in group]
                every = self.numbers(list(chain.from_iterable(words)))
                runs = np.split(every, np.cumsum(list(map(len, words)))[:-1])
            for text, numbers in zip(group, runs, strict=True):
                yield self.put_together(text, numbers, n) if text else ([(0.0, b"")], b"", True)

    def encode(self, text: str, n: int) -> tuple[list[tuple[float, bytes]], bytes]:
        """(score, ids) of the best ``n`` paths, and the library's ids."""
        return next(self.encode_many([text], n))[:2]

    def put_together(self, text: str, runs: np.ndarray, n: int) -> tuple[list[tuple[float, bytes]], bytes, bool]:
        f = self.facts[runs]
        best = self.best.gather(f["at"], f["n"].astype(np.int64)).tobytes()
        merged = self.merged.gather(f["merged_at"], f["merged_n"].astype(np.int64)).tobytes()
        score = float(f["score"].sum())
        ways = self.combined(best, f["cost"], f["n"].astype(np.int64) * 4, lambda i: self.texts[runs[i]], n)
        # runs that decode to themselves do so together
        decodes = bool(f["decodes"].all()) or all(self.decode(x) == text for x in (best, merged))
        return [(score - c, ids) for c, ids in ways], merged, decodes

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; the blank that encoding put before it comes off."""
        return self.plain(ids).removeprefix(" ")

    def plain(self, ids: bytes) -> str:
        numbers = struct.unpack(f"<{len(ids) // 4}I", ids)
        return b"".join(map(self.vocabulary.data.__getitem__, numbers)).decode(errors="replace")


_kept: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def encode_n_best(df: DataFrame, path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``paths`` (array of score and ids, best first) and ``merged`` ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for batch in sliced(batches, 128):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = list(encoder.encode_many(texts, n))
            paths = [[{"score": s, "ids": np.frombuffer(i, "<i4").tolist()} for s, i in p] for p, *_ in found]
            merged = [np.frombuffer(m, "<i4") for _, m, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(paths, kind), pa.array(merged, pa.list_(pa.int32()))], ["id", "paths", "merged"]
            )

    id_type = df.schema[id_col].dataType.simpleString()
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    schema = f"id {id_type}, paths array<struct<score:double,ids:array<int>>>, merged array<int>"
    return in_workers(source, encode, schema).withColumnRenamed("id", id_col)


def decode_pieces(df: DataFrame, path: str, ids_col: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id and the ``text`` of its ids; null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in sliced(batches):
            texts = [None if x is None else encoder.decode(_packed(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    id_type = df.schema[id_col].dataType.simpleString()
    source = df.select(df[id_col].alias("id"), df[ids_col].cast("array<int>").alias("ids"))
    return in_workers(source, decode, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def summarise(df: DataFrame, path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, digests of what ``encode_n_best`` gives and of its decoding.

    ``scores``, ``n_ids`` and ``ids_crc32`` are arrays over the best paths;
    ``merged_n_ids`` and ``merged_crc32`` are those of the library's ids;
    ``decoded`` tells whether the best path and the library's ids decode to the
    text. Other paths differ from the best in single runs, and a run's paths are
    all decoded when they are found.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in sliced(batches):
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for paths, merged, decodes in encoder.encode_many(texts, n):
                rows.append(
                    (
                        [s for s, _ in paths],
                        [len(i) // 4 for _, i in paths],
                        [zlib.crc32(i) for _, i in paths],
                        len(merged) // 4,
                        zlib.crc32(merged),
                        decodes,
                    )
                )
            types = [pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["id", "scores", "n_ids", "ids_crc32", "merged_n_ids", "merged_crc32", "decoded"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    schema = f"id {id_type}, scores array<double>, n_ids array<long>, ids_crc32 array<long>, merged_n_ids long, merged_crc32 long, decoded boolean"
    return in_workers(source, digest, schema).withColumnRenamed("id", id_col)


def op1_sentencepiece_nbest(spark, sf_dir, model: str | None = None):
    import public_tokenizers

    return summarise(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))
