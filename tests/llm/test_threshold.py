"""The threshold of the quality rules from every labelled document."""

import inspect

import numpy as np
import pytest

from quarry.llm import quality


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_threshold_of_all_scores(spark, n):
    rng = np.random.default_rng(n)
    good, bad = np.round(rng.normal(1, 1, n), 3), np.round(rng.normal(-1, 1.5, 4000), 3)
    known = spark.createDataFrame([(1, float(x)) for x in good] + [(0, float(x)) for x in bad], "trusted int, score double")
    assert quality.threshold_of(known) == quality.choose_threshold(good, bad)
    for loss in (0.0, 0.37, 0.9999):
        assert quality.threshold_of(known, loss) == quality.choose_threshold(good, bad, loss)


def test_every_label_counts(spark):
    """One good document of many among the rejected ones moves the threshold, whatever the hash of its id."""
    assert "most" not in inspect.signature(quality.fit).parameters
    good = [(i, "alpha beta " * 30 + f"w{i % 50} gamma") for i in range(21_000)]
    bad = [(100_000 + i, "%% ## " * (1 + i % 40) + "alpha") for i in range(400)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100_000)) for i, _ in good + bad], "doc_id long, quality int")
    rules = quality.fit(docs, labels, buckets=1 << 16)
    rest = docs.join(quality.clean_labels(labels), docs["doc_id"] == quality.F.col("__id")).filter("trusted = 0 OR pmod(xxhash64(doc_id, 7), 3) = 0")
    scores = quality.score(rest.select("doc_id", "text", "trusted"), rules, keep=["trusted"]).toPandas()
    assert len(scores) > 20_000 // 3 + 400
    assert rules.threshold == quality.choose_threshold(scores["score"].to_numpy()[scores["trusted"] == 1], scores["score"].to_numpy()[scores["trusted"] == 0])
