"""Pairs that hold a large share of all tokens: same scores, bounded groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import katz_scores

from fieldgauge.llm import katz


@pytest.mark.parametrize("hot_pair", [None, 40])
def test_counting_pairs_beforehand_changes_no_score(spark, monkeypatch, hot_pair):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(words[int(x)] for x in np.minimum(rng.zipf(1.5, rng.integers(0, 40)) - 1, 29))) for i in range(160)]
    rows += [(i, "a a a a a a a a a a a") for i in range(200, 260)] + [(300, "a"), (301, ""), (302, "a b a b")]
    monkeypatch.setattr(katz, "BLOCK_DOCS", 20)
    got = {r["doc_id"]: r["score"] for r in katz.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket_tokens=700, hot_pair=hot_pair).collect()}
    assert got == pytest.approx(katz_scores(rows), abs=1e-6)


def test_corpus_of_one_pair(spark):
    rows = [(i, "a " * 50) for i in range(60)]
    got = {r["doc_id"]: r["score"] for r in katz.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket_tokens=100, hot_pair=6).collect()}
    assert got == pytest.approx(katz_scores(rows), abs=1e-6)


def test_a_pair_in_half_of_ten_million_tokens_fills_no_partition(spark, monkeypatch):
    """Entries of the largest partition, with the pair counted beforehand and without."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.expr("repeat('x y ', 6250)"), F.expr("array_join(transform(sequence(1, 12500), i -> concat('w', pmod(hash(i, id), 40000))), ' ')")).alias("text"))
    seen = {}
    send = katz._send

    def watched(words, buckets):
        seen["hot"] = words.hot_n.tolist()
        sent = docs.mapInArrow(send(words, buckets), katz._SENT)
        seen["largest"] = sent.groupBy("bucket").agg(F.sum(F.size("doc")).alias("n")).agg(F.max("n")).first()[0]
        seen["all"] = sent.agg(F.sum(F.size("doc"))).first()[0]
        raise KeyboardInterrupt
    monkeypatch.setattr(katz, "_send", watched)
    for least in (None, 10 ** 9):
        with pytest.raises(KeyboardInterrupt):
            katz.score_texts(docs, bucket_tokens=1_000_000, hot_pair=least)
        seen[least] = seen["largest"]
        if least is None:
            assert len(seen["hot"]) == 2 and min(seen["hot"]) > 1_900_000      # x y and y x, held-out texts apart
    assert seen[None] <= 1_000_000 and seen[10 ** 9] > 2_000_000
