"""Beyond the broadcast limit: documents that match nothing wanted stay out of the shuffles."""

import pytest
from pyspark.sql import functions as F

from stratafold.llm import minhash
from stratafold.llm.common import may_match
from stratafold.session import pin
from test_likely_rows import no_broadcast, shuffled  # noqa: F401


@pytest.fixture
def docs(spark):
    """Of 400 documents every fiftieth is like its neighbour but for the last word; one has no id,
    two share theirs."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.md5(
        F.concat_ws("-", F.col("of").cast("string"), i.cast("string")).cast("binary"))))
    rows = spark.range(400).withColumn("of", F.when(F.col("id") % 50 == 1, F.col("id") - 1).otherwise(F.col("id")))
    named = F.when(F.col("id") == 77, None).when(F.col("id") == 79, 78).otherwise(F.col("id"))
    text = F.concat_ws(" ", words, F.col("id").cast("string"))
    return pin(rows.select(named.alias("doc_id"), text.alias("text")), "docs")


def test_only_texts_of_wanted_documents_are_shuffled(spark, docs, no_broadcast):  # noqa: F811
    wanted = docs.where("doc_id % 100 = 0")
    nodes = minhash._signatures(wanted).select("node", "doc_id")
    found = minhash._sets(docs, nodes)
    assert len(found.collect()) == 4
    assert max(shuffled(found)) < 40


def test_few_wanted_documents_shuffle_no_text(spark, docs):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    classes = pin(minhash._signatures(docs).select("node", "doc_id"), "classes")
    spark.conf.set(name, str(40_000))  # what is wanted, but neither the classes nor the documents
    try:
        some = pin(classes.where("doc_id % 100 = 0").select("node"), "some")
        found = minhash._sets(docs, classes.hint("merge").join(some, "node", "left_semi"))
        assert len(found.collect()) == 4
        assert max(shuffled(found)) < 40
    finally:
        spark.conf.set(name, before)


def test_duplicates_are_the_same_beyond_the_broadcast_limit(docs, spark):
    rows = sorted(map(str, minhash.deduplicated(docs).collect()))
    assert len(rows) == 392
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        apart = minhash.deduplicated(docs)
        assert sorted(map(str, apart.collect())) == rows
        assert max(shuffled(apart)) < 100
    finally:
        spark.conf.set(name, before)


def test_a_value_without_a_mark_is_not_wanted(spark, docs, no_broadcast):  # noqa: F811
    wanted = pin(docs.where("doc_id is null or doc_id in (5, 399)").select("doc_id"), "wanted")
    left = docs.where(may_match("doc_id", wanted))
    found = {r.doc_id for r in left.collect()}
    assert found >= {None, 5, 399} and len(found) < 10
