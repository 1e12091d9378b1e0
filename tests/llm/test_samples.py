"""The fits' input stays bounded, and copies weigh what they are, when a text is a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcorpus.llm import common, language_id, quality_classifier


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows: a third one text, a third null, a third all different."""
    n, k = F.col("id"), F.col("id") % 3
    text = F.when(k == 0, "the one text that is here very often").when(k == 1, F.concat(F.lit("the words of number "), n.cast("string"), F.lit(" and its own"), n.cast("string")))
    return spark.range(3000).select(n.alias("doc_id"), text.alias("text"), F.lit("x").alias("lang"))


@pytest.mark.parametrize("module", [quality_classifier, language_id])
def test_bounded(skewed, monkeypatch, module):
    seen = []
    monkeypatch.setattr(module, "materialize", lambda df: seen.append(common.materialize(df)) or seen[-1])
    if module is quality_classifier:
        assert module.classify(skewed, sample=200).count() == 3000
    else:
        module.train(skewed, per_language=200, id_col="doc_id")
    rows = seen[-1].collect()
    copies = sorted(r.copies for r in rows)
    assert sum(copies) == 200 and 70 <= copies[-1] <= 130 and set(copies[:-1]) == {1}


def test_equal_rows_are_drawn_one_by_one(spark):
    """All ids are null, half of the texts are null and most others are one text: the sample is bounded all the same."""
    text = F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 10 == 1, F.col("id").cast("string")).otherwise("one text")
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("id"), text.alias("text"), F.lit("x").alias("lang"))
    for by in (None, "lang"):
        found = {r.text: r.copies for r in common.sampled(rows, F.lit(0.1), 200, by).collect()}
        assert sum(found.values()) == 200 and 130 <= found.pop("one text") <= 185 and set(found.values()) == {1}


def test_repeats():
    assert common.repeats(np.array([1, 3, 1]), 10).tolist() == [0, 1, 1, 1, 2]
    assert len(common.repeats(np.array([1, 1, 10**9]), 100)) <= 102
