"""The pipeline against its parts, done plainly."""

import pytest

pytest.importorskip("weft.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from weft.llm import pii, quality_rules  # noqa: E402
from weft.llm.common import cut  # noqa: E402

from test_dedup import brute  # noqa: E402  isort:skip


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], data), f"test-{name.replace(' ', '-')}"))
        if name != "packing":
            assert kept[-1].columns == columns
    texts = [dict(d.select("doc_id", "text").collect()) for d in kept[:5]]
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert set(texts[1]) == {i for i, k in verdicts.items() if k}
    groups = {}
    for i, t in texts[1].items():
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(key, []).append((-len(t), i))
    assert set(texts[2]) == {min(g)[1] for g in groups.values()}
    components = brute(list(texts[2].items()))
    assert set(texts[3]) == {i for i, (_, c) in components.items() if c == i}
    names = pii.Pseudonyms(pii.session_key(spark))
    assert texts[4] == {i: names.text(t)[0] for i, t in texts[3].items()}
    assert {r["doc_id"] for r in kept[5].collect()} == set(texts[4])
    assert corpus_pipeline.run(spark, data).count() == kept[5].count()


def test_hard_rows_pass_through_all_stages(spark, data):
    good = "the people of the town went to the market and they saw that all of it was good for them in the end . " * 4
    texts = [(1, good + "by ann@corp.io"), (1, good + "by ann@corp.io"), (None, good + "and no id"), (2, None), (3, ""), (4, good.replace(" ", "  ") + "by  ann@corp.io"), (5, "x" * 50_000)]
    rows = [(i, t, lang, f"v{k}", k, "p", "r") for k, ((i, t), lang) in enumerate(zip(texts, ["en", None, "en", "en", "xx", "en", "en"], strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, part int, points string, root string")
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = cut(stage(spark, kept, data), "hard")
            if name != "packing":
                assert kept.columns == docs.columns
            if name == "exact dedup" and table is docs:
                assert kept.filter("text LIKE '%ann@%'").count() <= 1
        assert table is docs or kept.count() == 0
