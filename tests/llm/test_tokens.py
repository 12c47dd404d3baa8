"""Pieces, counts and packing against the libraries themselves."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("weft.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402
from weft.llm import packing, pieces, tokens  # noqa: E402

TEXTS = [
    "", " ", None, "a  b", "x \n y", "\n\n a", "tok <|endoftext|> mid<|endoftext|>", "a　b  c", "don't  we'll\tgo ",
    "É́ ́x ΣΑΣ İ", "foo\x1c bar\x85 baz", "  lead", "trail  ", "1234 5 '5 's ' s", "▁a▁▁b", "𝔘nknown 你好吗 ", "y" * 5000, "a " * 3000,
]
any_text = st.text(st.one_of(st.sampled_from(" \n\t.,'1aZéß▁$"), st.characters(codec="utf-8")), max_size=40)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, id string")


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model"))


def test_counts(docs, word_bpe):
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(TEXTS):
        n = len(word_bpe.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
    assert tokens.count_tokens(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=200, deadline=None)
@given(any_text)
def test_encoders_equal_the_libraries(text):
    if "ids" not in _made:
        _made["ids"] = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
        _made["lengths"] = tokens.Lengths(public_tokenizers.path("word_bpe_49k.json"))
        _made["pieces"] = pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    ids, lengths, sp = _made["ids"], _made["lengths"], _made["pieces"]
    assert np.frombuffer(ids.of(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert lengths.of(text.encode()) == len(lengths.tokenizer.encode(text, add_special_tokens=False).ids)
    paths, merged = sp.encode(text, 3)
    assert np.frombuffer(merged, "<i4").tolist() == sp.library.encode(text)
    for packed in (merged, *(p for _, p in paths)):
        assert sp.decode(packed) == text.replace(pieces.SPACE, " ")


_made: dict = {}


def test_packing(docs, bpe):
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        ids = np.array([*bpe.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 2048)))
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 2048 for r in mine[1:])
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def one_by_one(lengths, capacity):
    """Best fit, longest first, item by item."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            best = min(fits, key=lambda i: rooms[i])
            rooms[best] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=80)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_equals_best_fit_one_by_one(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    used, placed = {}, {}
    for n, rank, items, per, first, offset in packing.plan_best_fit(counts, 20).tolist():
        for k in range(items):
            b = first + k // per
            used.setdefault(b, []).append((offset + k % per * n, n))
            placed[n, rank + k] = b
    assert len(placed) == len(lengths)
    rooms = []
    for slots in used.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        rooms.append(20 - at)
    assert sorted(rooms) == one_by_one(lengths, 20)


def test_n_best_equals_all_paths(encoder):
    vocabulary = encoder.vocabulary

    def every(run):
        def steps(b):
            for a in range(b):
                if run[a:b] in vocabulary.score:
                    i, s = vocabulary.score[run[a:b]]
                    yield a, (i,), s
                elif a == b - 1:
                    yield a, tuple(vocabulary.bytes[x] for x in run[a].encode()), vocabulary.unknown

        def paths(b):
            if b == 0:
                yield 0.0, ()
            for a, ids, s in steps(b):
                for q, i in paths(a):
                    yield q + s, i + ids

        return sorted(paths(len(run)), key=lambda p: -p[0])

    for text in ("hello the", "a b", "Étude.", "xx\nyy", "the theory", " two  in", "你 ok"):
        run = pieces.SPACE + text.replace(" ", pieces.SPACE)
        want, (got, _) = every(run), encoder.encode(text, 5)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:5]])
        allowed = {(round(s, 6), i) for s, i in want}
        found = [(round(s, 6), tuple(np.frombuffer(i, "<u4").tolist())) for s, i in got]
        assert set(found) <= allowed and len(set(found)) == len(found)


@settings(max_examples=60, deadline=None)
@given(st.lists(any_text.filter(lambda t: t and " " not in t and pieces.SPACE not in t), min_size=1, max_size=12))
def test_runs_together_equal_runs_alone(words):
    sp = _made.setdefault("runs", pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model")))
    runs = sorted((pieces.SPACE + w for w in words), key=len, reverse=True)
    score, cost, n, ids = sp.vocabulary.best_of_many(runs)
    at = np.r_[0, np.cumsum(n)]
    for i, run in enumerate(runs):
        assert (score[i], cost[i], ids[at[i] : at[i + 1]].tolist()) == sp.vocabulary.best(run)


def test_long_unbroken_text_is_linear(encoder):
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdeéß") for _ in range(300_000))
    for text in (letters, "y" * 300_000):
        paths, merged, decodes = next(encoder.encode_many([text], 4))
        assert decodes and len(paths) == 4
        assert all(encoder.decode(ids) == text for _, ids in paths)


def test_pieces_of_an_empty_table_and_repeated_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(1, "a b", 1.5), (1, "a b", 1.5), (None, None, 2.5), (None, "", None)], "doc_id long, text string, paths double")
    assert pieces.summarise(rows.limit(0), path).count() == pieces.encode_n_best(rows.limit(0), path).count() == 0
    got = [(r["doc_id"], [len(p["ids"]) for p in r["paths"]]) for r in pieces.encode_n_best(rows, path, 2).collect()]
    assert sorted(got, key=str) == sorted([(1, [2, 3]), (1, [2, 3]), (None, [0]), (None, [0])], key=str)


def test_pieces_round_trip(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_n_best(docs, path, 2)
    back = pieces.decode_pieces(encoded.selectExpr("doc_id", "paths[0].ids AS ids"), path, "ids")
    got = {r["doc_id"]: r["text"] for r in back.collect()}
    assert got == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r["doc_id"]: r["merged"] for r in encoded.collect()} == {i: library.encode(t or "") for i, t in enumerate(TEXTS)}
    summary = pieces.summarise(docs, path).collect()
    assert all(r["decoded"] or "▁" in (TEXTS[r["doc_id"]] or "") for r in summary)


def test_counts_and_ids_of_whole_documents(spark, data, word_bpe, bpe):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    counted = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), sample_rows=20).collect()}
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in texts.items():
        assert counted[i] == len(word_bpe.encode(t or "", add_special_tokens=False).ids)
        assert np.frombuffer(ids.of(t or ""), "<u4").tolist() == bpe.encode(t or "", add_special_tokens=False).ids


def test_counts_and_packing_of_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    counted = tokens.count_tokens(rows, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in counted) == [("1", 2), ("1", 2), ("None", 0), ("None", 1)]
    packed = packing.pack(rows, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(packed) == 4 and len({(r["sequence_id"], r["offset"]) for r in packed}) == 4
    assert sum(r["length"] for r in packed) == 3 + 3 + 2 + 1 and len({r["sequence_id"] for r in packed}) == 1


def test_caches_may_be_tiny(monkeypatch, encoder):
    monkeypatch.setattr(pieces, "CACHE_RUNS", 4)
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 4)
    small, lengths = pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model")), tokens.Lengths(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    text = " ".join(rng.choice(["some", "words.", "that", "repeat,", "here"]) for _ in range(60))
    assert small.encode(text, 3) == encoder.encode(text, 3)
    assert lengths.of(text.encode()) == len(lengths.tokenizer.encode(text, add_special_tokens=False).ids)
