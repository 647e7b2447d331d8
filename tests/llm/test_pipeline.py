"""The pipeline against brute-force versions of its stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from panelcast.llm import simhash_dedup
from panelcast.session import Spool


def test_stages_follow_each_other(spark, small):
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination",
                                        "mixing sources"]
    sp, docs = Spool(spark), spark.read.parquet(f"{small}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        before, docs = docs, sp.put(stage(spark, docs, small))
        if name != P.STAGES[-1][0]:
            assert docs.dtypes == before.dtypes
        seen.append((before, docs))
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = seen
    assert d1.count() == d0.filter(F.col("text").rlike(r"\p{L}")).count()
    assert d2.filter("n_chars <> length(text)").count() == 0 and d2.count() == d1.count()
    # one document of each group: the rest are within a chain of copies of one that stayed
    fp = {r.doc_id: simhash_dedup.fingerprint(r.text.encode()) for r in d2.collect()}
    ids = np.array(sorted(fp))
    x = np.array([fp[i] for i in ids], np.int64).view(np.uint64)
    lab = ids.copy()
    while True:
        new = np.array([lab[np.bitwise_count(x ^ v) <= 4].min() for v in x])
        if (new == lab).all():
            break
        lab = new
    assert sorted(r.doc_id for r in d3.select("doc_id").collect()) == sorted(set(lab.tolist()))
    assert d4.join(d3, "doc_id", "left_anti").count() == 0 and 0 < d4.count() < d3.count()
    total = d4.select(F.size(F.split(F.trim("text"), r"\s+"))).count()
    taken = d5.agg(F.sum("taken"), F.sum("size")).first()
    assert total and d5.filter("taken not in (size, 2 * size)").count() == 0 and taken[0] >= taken[1]
    whole = sorted(map(tuple, P.run(spark, small).collect()))
    assert whole == sorted(map(tuple, d5.collect()))


@pytest.fixture
def odd(spark, tmp_path):
    rows = [(1, None, "en", "a", 5), (2, "", None, None, 0), (3, "?? 12", "en", "a", 5), (4, "plain words of text here", "en", "b", 24),
            (4, "plain words of text here", "en", "b", 24), (None, "words without an id here", "en", "b", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit("own") for c in ("score", "lang_pred", "n_lines", "n_hit", "contaminated", "items", "fp", "component", "size_")}
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs.withColumns(clash), str(tmp_path)


def test_stages_keep_odd_rows_and_clashing_columns(spark, odd):
    docs, d = odd
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in P.STAGES[:-1]:
            now = Spool(spark).put(stage(spark, now, d))
            assert now.columns == docs.columns
            assert now.filter("score <> 'own' or contaminated <> 'own' or items <> 'own'").count() == 0
        got = P.STAGES[-1][1](spark, now, d)
        assert now.count() == (0 if empty else 2) and got.count() <= 2
