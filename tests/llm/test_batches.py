"""What tasks hold outside the heap: whole texts go to Python, and back, in bounded batches."""

import uuid

import pytest
from pyspark.sql import functions as F

from stratafold.llm import common, decontaminate, minhash, quality
from stratafold.session import pin

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BOUND = 50_000


@pytest.fixture
def docs(spark):
    """600 texts of 2 kB in one partition; every tenth is that of the document before it."""
    of = F.when(F.col("id") % 10 == 1, F.col("id") - 1).otherwise(F.col("id"))
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.md5(F.concat_ws("-", of, i).cast("binary")))
    rows = spark.range(0, 600, 1, 1)
    return pin(rows.select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text")), "docs")


@pytest.fixture
def batches(tmp_path, monkeypatch):
    """Notes (bytes in, rows in, rows out of each yield) of every batch that Python gets."""
    monkeypatch.setattr(common, "BATCH_BYTES", BOUND, raising=False)
    folder, real = str(tmp_path), common.arrow_rows

    def watched(df, make, schema):
        def noting():
            work = make()

            def noted(batch):
                for columns in work(batch):
                    name = f"{folder}/{uuid.uuid4().hex}"
                    with open(name, "w") as f:
                        f.write(f"{batch.nbytes} {batch.num_rows} {len(next(iter(columns.values())))}")
                    yield columns

            return noted

        return real(df, noting, schema)

    for module in (decontaminate, minhash, quality):
        monkeypatch.setattr(module, "arrow_rows", watched)
    return lambda: [[int(x) for x in p.read_text().split()] for p in tmp_path.iterdir()]


def test_decontamination_reads_texts_in_bounded_batches(spark, docs, batches):
    benchmark = spark.createDataFrame([("a", docs.first().text)], "item_id string, text string")
    before = spark.conf.get(LIMIT)
    assert decontaminate.clean(docs, benchmark).count() == 598
    assert max(size for size, _, _ in batches()) < 2 * BOUND
    assert spark.conf.get(LIMIT) == before


def test_decontamination_compares_some_documents_at_once(spark, docs, batches, monkeypatch):
    monkeypatch.setattr(decontaminate, "TOGETHER", 5, raising=False)
    benchmark = docs.where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("item_id"), "text")
    found = decontaminate.search(docs, benchmark)
    already = len(batches())
    assert found.where("size(found) = 1").count() == 120
    assert 0 < already < len(batches())
    assert sum(rows > made == 5 for _, rows, made in batches()) >= 20


def test_near_duplicates_read_texts_in_bounded_batches(spark, docs, batches):
    before = spark.conf.get(LIMIT)
    assert minhash.deduplicated(docs).count() == 540
    assert max(size for size, _, _ in batches()) < 2 * BOUND
    assert spark.conf.get(LIMIT) == before


def test_quality_hands_texts_back_a_block_at_a_time(spark, docs, batches):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    given = quality.score(docs, labels)
    learned = len(batches())  # that one hands back vectors, not texts
    scored = pin(given, "scored")
    assert scored.select("doc_id", "text").exceptAll(docs).isEmpty() and scored.count() == 600
    assert sum(made > quality.BLOCK for _, _, made in batches()) <= learned == 1


def test_a_lower_limit_of_the_session_stays(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "64k")
    try:
        with pytest.raises(KeyError), common.bounded_batches(spark):
            assert spark.conf.get(LIMIT) == "64k"
            raise KeyError
        assert spark.conf.get(LIMIT) == "64k"
    finally:
        spark.conf.set(LIMIT, before)
