"""Near-duplicates by SetSketch registers, with links confirmed on full sets.

1. Each text becomes a set of hashed five-word shingles; its registers are
   exponentially spaced truncated minima. Texts with equal sets are one class
   from here on, so copies cost nothing further.
2. Bands of register values deal classes into buckets. Each class is compared
   with its buckets' leaders first: the similarity is estimated jointly, by
   likelihood, from the registers that are greater, less and equal, and where it
   isn't far below the threshold the full sets are intersected. A group of near
   copies, however large, becomes one component here, by a number of comparisons
   in proportion to its size.
3. What is left are buckets with members of several components. Only pairs of
   different components are estimated; they give candidate clusters of components.
4. The full sets of the members that had such a pair meet by cluster, and again
   only pairs of different components are intersected. Confirmed links are given
   as spanning trees, whose components are the result.

Hot leaders, buckets and clusters are dealt out: a leader to parts of its
members; a bucket or cluster to pairs of blocks, of which one component's own
blocks never meet. So a task never holds more than two blocks, and no pair that
could join two components is left out.

With 28 bands of 6 registers a pair at the threshold (similarity 0.85) is missed
with probability below 1e-6, and one at 0.9 below 1e-9.

Defined cases: texts without words (also null ones) are linked with nothing;
rows without an id take no part, have no component and stay; rows that share an
id are one node, with the links of all their texts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import Spread, bitmap_of, cut, discard, in_workers, sliced, table
from weft.llm.components import components
from weft.llm.sketches import SetSketch, WordHashes, set_digest, shingle_set

BANDS, ROWS = 28, 6
SKETCH = {"m": BANDS * ROWS, "b": 1.08, "a": 20.0}
#: Similarity that linked pairs have, in hundredths.
LEAST = 85
#: Estimates below are given up: five standard errors below the threshold.
LEAST_ESTIMATE = 0.71
#: Classes, and shingles, that a block of a bucket or cluster has about.
BLOCK_CLASSES, BLOCK_SHINGLES = 128, 500_000

_hashes = WordHashes()


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n (shingles), digest of the set, registers."""
    id_type = df.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(**SKETCH)
        for batch in sliced(batches):
            sets = [shingle_set(t, _hashes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array(map(set_digest, sets), pa.binary()),
                    pa.array([sketch.registers(s) if len(s) else b"" for s in sets], pa.binary()),
                ],
                ["id", "n", "digest", "regs"],
            )

    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return in_workers(source, sign, f"id {id_type}, n long, digest binary, regs binary")


class Forest:
    """Union-find over 0..n-1 that tells which unions were new."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def by_group(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Runs of equal values in the sorted column ``key``, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(comp: np.ndarray, side: np.ndarray | None, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of different components in slabs; with ``side``, only pairs from both sides."""
    n = len(comp)
    for at in range(0, n, rows):
        i = np.arange(at, min(n, at + rows))
        wanted = (i[:, None] < np.arange(n)[None, :]) & (comp[i][:, None] != comp[None, :])
        if side is not None:
            wanted &= side[i][:, None] != side[None, :]
        a, b = np.nonzero(wanted)
        yield i[a], b


def _likely(sketch: SetSketch, rx: np.ndarray, ry: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Places of the pairs whose estimated similarity isn't far below the threshold."""
    # sizes alone rule out a similarity; so do few equal registers
    at = np.flatnonzero(np.minimum(nx, ny) * 100 >= LEAST * np.maximum(nx, ny))
    at = at[(rx[at] == ry[at]).sum(1) >= 0.6 * sketch.m]
    if not len(at):
        return at
    rx, ry = rx[at], ry[at]
    return at[sketch.similarity((rx > ry).sum(1), (rx < ry).sum(1), nx[at], ny[at]) >= LEAST_ESTIMATE]


def _registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns leader, part, role, c, n, regs, sorted by the first three: a leader (role 0), then its members."""
    sketch = SetSketch(**SKETCH)
    leader_n, leader_regs = 0, None
    for batch in filter(len, batches):
        leads, role, c, n = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
        regs = _registers(batch.column(5))
        # the row of each row's leader; -1 is the last one of an earlier batch
        own = np.maximum.accumulate(np.where(role == 0, np.arange(len(role)), -1))
        if leader_regs is None:
            leader_n, leader_regs = n[0], regs[0]
        ln = np.where(own < 0, leader_n, n[own])
        lregs = np.where((own < 0)[:, None], leader_regs, regs[own])
        at = np.flatnonzero(role == 1)
        at = at[_likely(sketch, lregs[at], regs[at], ln[at], n[at])] if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(leads[at]), pa.array(c[at])], ["a", "b"])
        leader_n, leader_regs = ln[-1], lregs[-1].copy()


def _enough(both: int | np.ndarray, x: int | np.ndarray, y: int | np.ndarray):
    """Whether sets of these sizes with such an intersection are linked."""
    return 100 * both >= LEAST * (x + y - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns leader, part, role, c, items, sorted like those of ``_estimates``; gives the links."""
    leader = np.empty(0, np.uint64)
    for batch in sliced(batches, 256):
        a, b = [], []
        for lead, role, c, items in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            found = np.frombuffer(items, "<u8")
            if role == 0:
                leader = found
            elif _enough(len(np.intersect1d(leader, found, assume_unique=True)), len(leader), len(found)):
                a.append(lead)
                b.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_inverse=True)


def _sides(column) -> np.ndarray | None:
    """Sides of a pair of blocks; None where all pairs of the group are meant."""
    sides = column.to_numpy()
    return sides if (sides >= 0).all() else None


def _bucket_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, side, c, comp, n, regs, sorted by key.

    Gives trees of components whose members are similar, and the members that
    have such a pair (in b; their component in a).
    """
    sketch = SetSketch(**SKETCH)
    for group in by_group(batches, 0):
        c, n = group.column(2).to_numpy(), group.column(4).to_numpy()
        names, comp = _numbered(group.column(3).to_numpy())
        regs = _registers(group.column(5))
        forest, a, b = Forest(len(names)), [], []
        touched = np.zeros(len(c), bool)
        for i, j in _pairs(comp, _sides(group.column(1))):
            for at in range(0, len(i), 2048):
                x, y = i[at : at + 2048], j[at : at + 2048]
                likely = _likely(sketch, regs[x], regs[y], n[x], n[y])
                x, y = x[likely], y[likely]
                touched[x] = touched[y] = True
                for p, q in zip(comp[x].tolist(), comp[y].tolist(), strict=True):
                    if forest.join(p, q):
                        a.append(p)
                        b.append(q)
        if a:
            kind = np.r_[np.zeros(len(a), bool), np.ones(int(touched.sum()), bool)]
            left, right = np.r_[names[a], names[comp[touched]]], np.r_[names[b], c[touched]]
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(kind)], ["a", "b", "member"])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections: a product of incidence matrices, in slabs of columns."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    everything = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(everything, kind="stable")
    everything, row = everything[order], row[order]
    column = np.cumsum(np.r_[0, everything[1:] != everything[:-1]])
    shared = np.bincount(column)[column] > 1
    row = row[shared]
    column = np.unique(column[shared], return_inverse=True)[1] if shared.any() else column[:0]
    out = np.zeros((n, n), np.float32)
    width = max(256, 2_000_000 // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out


def _cluster_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, side, comp, items, sorted by key; gives trees of linked components."""
    for group in by_group(sliced(batches), 0):
        names, comp = _numbered(group.column(2).to_numpy())
        if len(names) < 2:
            continue
        sets = [np.frombuffer(x, "<u8") for x in group.column(3).to_pylist()]
        size = np.array([len(s) for s in sets])
        both = _intersections(sets)
        linked = _enough(both, size[:, None], size[None, :]) & (comp[:, None] != comp[None, :])
        if (side := _sides(group.column(1))) is not None:
            linked &= side[:, None] != side[None, :]
        forest, a, b = Forest(len(names)), [], []
        for p, q in np.argwhere(np.triu(linked, 1)).tolist():
            if forest.join(int(comp[p]), int(comp[q])):
                a.append(comp[p])
                b.append(comp[q])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (key, comp, c, n) with ``key`` and ``side`` for groups of at most two blocks each.

    A component with a block's size or more has blocks of its own; the others
    share blocks, each whole in one. A row goes where its block meets another,
    but for those of its own component; ``side`` tells the blocks of a pair
    apart, and is -1 where all pairs of the group are meant.
    """
    rows = cut(rows, "grouped")
    weight = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    by_comp = cut(rows.groupBy("key", "comp").agg(weight.alias("own"), F.count("*").alias("size"), F.sum("n").alias("n")), "comps")
    shared = F.greatest(
        F.ceil(F.sum(F.when(F.col("own") == 1, F.col("size"))) / BLOCK_CLASSES),
        F.ceil(F.sum(F.when(F.col("own") == 1, F.col("n"))) / BLOCK_SHINGLES),
        F.lit(0),
    ).cast("long")
    groups = by_comp.groupBy("key").agg(
        shared.alias("shared"),
        F.sum(F.when(F.col("own") > 1, F.col("own")).otherwise(0)).alias("owned"),
        F.sum("size").alias("size"),
        F.count("*").alias("comps"),
    )
    # a group of one component has nothing to compare
    groups = cut(groups.filter("comps > 1"), "groups")
    top, most = groups.agg(F.max("size"), F.max(F.col("shared") + F.col("owned"))).first()
    if top is None:
        return rows.select("key", F.lit(-1).alias("side"), "c", "comp").limit(0)
    rows = rows.filter(bitmap_of(groups, ["key"]))
    rows = Spread(groups, ["key"], "size", top).join(rows, groups.select("key", "shared", "owned"), "c")
    plain = rows.filter("shared + owned = 1").select("key", F.lit(-1).alias("side"), "c", "comp")
    if most == 1:
        return plain
    # the blocks that a large component has for itself come after the shared ones
    large = by_comp.filter("own > 1")
    before = Window.partitionBy("key").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
    large = cut(large.select("key", "comp", "own", "size", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before")), "large")
    big = Spread(large, ["key", "comp"], "size", top).join(rows.filter("shared + owned > 1"), large.drop("size"), "c", "left")
    first = F.col("shared") + F.col("before")
    block = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("comp"), "shared")).otherwise(first + F.pmod(F.xxhash64("c"), "own"))
    every = F.sequence(F.lit(0).cast("long"), F.col("shared") + F.col("owned") - 1)
    others = F.when(F.col("own").isNull(), every).otherwise(F.filter(every, lambda x: (x < first) | (x >= first + F.col("own"))))
    dealt = big.withColumn("block", block).withColumn("other", F.explode(others))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") == low, 0).otherwise(1)
    # a key of its own may meet another's: then both share a group, and no pair is lost
    return plain.unionByName(dealt.select(F.xxhash64("key", low, high).alias("key"), side.alias("side"), "c", "comp"))


def _by_leader(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Leaders and their members with ``columns`` of ``facts``, ready for ``_estimates`` or ``_confirmed``."""
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("size"))
    spread = Spread(sizes, ["leader"], "size")
    members = spread.many(pairs, "c").join(facts.select("c", *columns), "c").withColumn("role", F.lit(1))
    leaders = sizes.join(facts.select(F.col("c").alias("leader"), *columns), "leader").withColumn("c", F.col("leader"))
    leaders = spread.one(leaders).withColumn("role", F.lit(0))
    order = ["leader", "part", "role"]
    both = members.select(*order, "c", *columns).unionByName(leaders.select(*order, "c", *columns))
    return both.repartition("leader", "part").sortWithinPartitions(*order)


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, repeated: bool) -> DataFrame:
    """Full sets (``items``) of the classes ``wanted`` (c, id, digest), from one text of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            c, items = [], []
            for number, digest, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                found = shingle_set(text, _hashes)
                if set_digest(found) == digest:  # an id may have other texts besides
                    c.append(number)
                    items.append(found.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(items, pa.binary())], ["c", "items"])

    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    rows = source.filter(bitmap_of(wanted, ["id"])).join(wanted, "id").select("c", "digest", "text")
    sets = in_workers(rows, read, "c long, items binary")
    return cut(sets.groupBy("c").agg(F.min("items").alias("items")) if repeated else sets, "sets")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id`` and ``kept``."""
    signed = cut(signatures(df, id_col, text_col), "signatures")

    # 1. classes of equal sets, with numbers; which number a class has doesn't matter
    known = signed.filter("n > 0 AND id IS NOT NULL")
    equal = known.groupBy("digest").agg(F.min(F.struct("id", "n", "regs")).alias("x"), F.count("*").alias("size"))
    classes = cut(equal.select(F.monotonically_increasing_id().alias("c"), "digest", "x.*", "size"), "classes")
    repeated = cut(known.groupBy("id").count().filter("count > 1"), "repeated")
    some_repeat = not repeated.isEmpty()

    # 2. buckets; members that are like their leaders
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring("regs", i * ROWS + 1, F.lit(ROWS))),
    )
    keys = classes.select("c", F.explode(bands).alias("key"))
    full = cut(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("leader")).filter("size > 1"), "bands")
    likely = keys.filter(bitmap_of(full, ["key"]))
    crowded = cut(Spread(full, ["key"], "size").join(likely, full.select("key", "leader"), "c"), "crowded")
    pairs = cut(crowded.filter("c <> leader").select("leader", "c").distinct(), "pairs")
    tried = in_workers(_by_leader(pairs, classes, ["n", "regs"]), _estimates, "a long, b long")
    tried = cut(tried.select(F.col("a").alias("leader"), F.col("b").alias("c")), "tried")
    named = classes.select("c", "id", "digest")
    ends = tried.select("c").unionByName(tried.select(F.col("leader").alias("c"))).distinct()
    sets = _sets(df, cut(ends.join(named, "c"), "wanted"), id_col, text_col, some_repeat)
    links = cut(in_workers(_by_leader(tried, sets, ["items"]), _confirmed, "a long, b long"), "links")
    found = components(links)

    # 3. pairs of different components
    own = F.coalesce("root", "c").alias("comp")
    rows = crowded.join(found, F.col("c") == F.col("node"), "left").select("key", "c", own)
    rows = in_blocks(rows.join(classes.select("c", "n"), "c"))
    rows = rows.join(classes.select("c", "n", "regs"), "c").select("key", "side", "c", "comp", "n", "regs")
    by_key = rows.repartition("key").sortWithinPartitions("key")
    similar = cut(in_workers(by_key, _bucket_trees, "a long, b long, member boolean"), "similar")
    clusters = components(similar.filter("NOT member"))

    # 4. their members' full sets
    members = similar.filter("member").select(F.col("a").alias("comp"), F.col("b").alias("c")).distinct()
    members = cut(members.join(named, "c"), "members")
    more = _sets(df, members.select("c", "id", "digest"), id_col, text_col, some_repeat)
    roots = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    rows = members.join(roots, F.col("comp") == F.col("node")).select(F.col("root").alias("key"), "comp", "c")
    rows = in_blocks(rows.join(classes.select("c", "n"), "c")).join(more, "c").select("key", "side", "comp", "items")
    by_key = rows.repartition("key").sortWithinPartitions("key")
    others = cut(in_workers(by_key, _cluster_trees, "a long, b long"), "links")
    if some_repeat:  # the classes of one id are one node
        of_id = known.join(repeated, "id").select("id", "digest").distinct().join(named.select("c", "digest"), "digest")
        least = of_id.groupBy("id").agg(F.min("c").alias("a"))
        others = cut(others.unionByName(of_id.join(least, "id").select("a", F.col("c").alias("b"))), "links")
    if not others.isEmpty():
        found = components(links.unionByName(others))

    # a component's name is its least id
    rooted = classes.join(found, F.col("c") == F.col("node"), "left").select("digest", "size", F.coalesce("root", "c").alias("root"), "id")
    by_root = cut(rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("classes")), "components")
    rooted = Spread(by_root, ["root"], "classes").join(rooted, by_root.drop("classes"), "digest")
    rooted = cut(rooted.select("digest", "size", "component_id"), "named")
    grouped = Spread(rooted, ["digest"], "size").join(known, rooted.drop("size"), "id").select("id", "n", "component_id")
    lone = signed.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return grouped.unionByName(lone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def op5_setsketch_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
