"""Exact and near deduplication against plain versions."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("weft.llm")
from oracle import connect, differences  # noqa: E402
from weft.llm import common, components, exact_dedup, near_dedup, registry  # noqa: E402
from weft.llm.sketches import SetSketch, WordHashes, shingle_set  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _id int"
HARD = [
    (1, "a  b\tc", "en", None, 5, "x", 1),
    (2, "abc ", None, "s", None, None, 2),
    (3, "ab", "en", "s", 2, None, None),
    (4, "", "en", "s", 0, None, None),
    (5, None, "en", "s", 0, None, None),
    (6, " \n", "en", "s", 2, None, None),
    (None, "abc", "en", "s", 3, None, None),
    (7, "x" * 300_000, "en", "s", 3, None, None),
    (7, "x" * 300_000, "en", "s", 3, None, None),
    (8, "abc ", "en", "s", 4, None, None),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.mark.parametrize("digest", [True, False])
def test_exact_dedup_on_hard_rows(hard, digest):
    rows = exact_dedup.exact_dedup(hard, digest=digest).collect()
    assert len(rows) == len(HARD) and sorted(r["kept"] for r in rows if r["doc_id"] == 7) == [False, True]
    got = {r["doc_id"]: r for r in rows if r["doc_id"] != 7 or r["kept"]}
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in got.items()} == {
        1: (1, 4, True), 2: (1, 4, False), 8: (1, 4, False), None: (1, 4, False), 3: (3, 1, True),
        6: (6, 3, True), 4: (6, 3, False), 5: (6, 3, False), 7: (7, 2, True),
    }
    assert (got[3]["text_sha256"] is None) == (not digest)


def test_exact_dedup_of_repeated_rows_equals_sql(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (2, "a b"), (3, None), (3, " "), (4, "x"), (4, "x"), (5, "yz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(exact_dedup.op10_exact_dedup(spark, str(tmp_path)), con, exact_dedup.OP10_SQL) == ""


def test_keep_one_passes_columns_of_any_name(spark):
    names = ["doc_id", "text", "_points", "points", "_sha", "sha", "maybe", "_id", "_copies", "_open"]
    rows = [(i % 3, "same" if i < 6 else f"t{i}", *(f"v{i}" for _ in names[2:])) for i in range(9)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == names
    got = sorted(tuple(r) for r in kept.collect())
    assert len(got) == 4 and set(got) <= set(rows) and {r[1] for r in got} == {"same", "t6", "t7", "t8"}


def test_keep_one(hard):
    kept = exact_dedup.keep_one(hard)
    assert kept.columns == hard.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [1, 3, 6, 7]
    assert exact_dedup.keep_one(hard.limit(0)).count() == 0


def test_keep_one_with_repeated_ids(spark):
    texts = [(1, "a b"), (1, "ab"), (2, "x"), (2, "x"), (2, " x"), (3, "c d"), (3, "c d"), (3, "cd"), (4, "e"), (4, "f"), (None, "g"), (None, "g ")]
    docs = spark.createDataFrame(texts + [(1, None), (1, " ")], "doc_id long, text string")
    kept = [tuple(r) for r in exact_dedup.keep_one(docs).collect()]
    assert sorted(kept, key=repr) == sorted(
        [(1, "a b"), (2, " x"), (3, "c d"), (4, "e"), (4, "f"), (None, "g "), (1, " ")], key=repr
    )


def test_exact_dedup_equals_sql(spark, data):
    con = connect(data)
    for name in registry.SQL:
        assert differences(registry.QUERIES[name](spark, data), con, registry.SQL[name]) == ""


def test_components(spark):
    random.seed(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + random.randrange(80), 100 + random.randrange(80)) for _ in range(70)]
    pairs += [(200, x) for x in range(201, 260)] + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    for x, r in root.items():
        assert got.get(x, x) == r
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows):
    """Components and set sizes by comparing all pairs."""
    sets, root = {}, {}
    for i, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
        root[i] = i
    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in ids}


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "É é"), (7, "é é")]
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([30, 120, 400]))
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, heavy", [(2048, 500), (5, 3)])
def test_near_duplicates_equal_brute_force(spark, near_rows, monkeypatch, block, heavy):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", block)  # 5: buckets and clusters in pairs of blocks
    monkeypatch.setattr(common.Spread, "HEAVY", heavy)  # 3: keys in parts
    df = spark.createDataFrame(near_rows, "doc_id long, text string").withColumn("root", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(near_rows)


def test_rows_that_share_an_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (6, b), (7, c), (9, c), (9, "alone here"), (8, "not like any")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [
        (1, 1, True), (5, 1, False), (5, 1, False), (6, 1, False), (7, 7, True), (8, 8, True), (9, 7, False), (9, 7, False),
    ]


def test_blocks_meet_but_for_a_component_s_own(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 4)
    comp = {c: 1 if c < 20 else 2 if c < 30 else c for c in range(45)}
    rows = spark.createDataFrame([(7, k, c, 5) for c, k in comp.items()], "key long, comp long, c long, n long")
    dealt = near_dedup.in_blocks(rows).collect()
    met, most = set(), Counter()
    for r in dealt:
        most[r["key"]] += 1
        for s in dealt:
            if r["key"] == s["key"] and r["comp"] != s["comp"] and (r["side"] == -1 or r["side"] != s["side"]):
                met.add((r["c"], s["c"]))
    assert met == {(x, y) for x in comp for y in comp if comp[x] != comp[y]}
    copies = Counter(r["c"] for r in dealt)
    assert max(copies[c] for c in range(20)) <= 8  # blocks of others, not its own five
    assert max(most.values()) < 30


def test_near_duplicates_on_hard_rows(hard):
    got = near_dedup.near_duplicates(hard).collect()
    assert len(got) == len(HARD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["component_id"], r["kept"]))
    assert by[2] == [(2, True)] and by[8] == [(2, False)] and by[None] == [(None, True)]
    assert by[7] == [(7, True)] * 2 and by[4] == [(4, True)]
    assert near_dedup.near_duplicates(hard.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    import numpy as np

    sketch = SetSketch(**near_dedup.SKETCH)
    rng = np.random.default_rng(12345)  # not the seed of the registers
    for share in (0.5, 0.85):
        n = 2000
        both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a, b = (np.r_[both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)] for _ in range(2))
        ra, rb = (np.frombuffer(sketch.registers(x), np.uint8) for x in (a, b))
        union = np.frombuffer(sketch.registers(np.r_[a, b]), np.uint8)
        assert (np.maximum(ra, rb) == union).all()
        true = len(both) / (2 * n - len(both))
        got = sketch.similarity(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([n]), np.array([n]))[0]
        assert abs(got - true) < 0.15
    assert len(shingle_set("a b c d e f", WordHashes())) == 2
