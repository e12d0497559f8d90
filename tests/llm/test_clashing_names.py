"""Pipeline stages on tables whose further columns have names that operators use themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelgrid.llm import kneser_ney, mixing, ngram_join

NAMES = [*"__size __target __base __s __order __words __id __source __row __bin __taken __times __i __n __k __key i k n key row __leak __lang __text __trusted lang2 model bits held trusted a.b".split()]


@pytest.fixture(scope="module")
def clash(documents):
    return documents.select("doc_id", "text", "lang", "source", *(F.lit(j).alias(x) for j, x in enumerate(NAMES)))


def test_mixing(clash, documents):
    got = mixing.mixed_documents(clash)
    assert got.columns == clash.columns and got.count() == mixing.mixed_documents(documents).count()
    assert got.select("`a.b`").distinct().collect()[0][0] == len(NAMES) - 1


def test_one_of_each(clash, documents):
    got = ngram_join.keep_one_of_each(clash)
    assert got.columns == clash.columns and got.count() == ngram_join.keep_one_of_each(documents).count()


def test_quality(spark, clash):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    got = kneser_ney.keep_good(clash, labels, least=5)
    assert got.columns == clash.columns and 0 < got.count() <= clash.count()
