"""Samples, profiles and prejoins that follow a growing fact, against building them anew."""

import pytest
from pyspark.sql import functions as F

from stratafold.engine import Engine
from stratafold.functions.state import appended, files_of, is_row_wise, rows_of, state_of
from stratafold.operators.approx import rescaled
from stratafold.operators.sampling import min_row_sample, stratified_sample
from stratafold.operators.sketch import Shape, Sketch, build_sketch, merge_sketch
from stratafold.operators.strata import stratum_sizes
from stratafold.functions.sizing import at_least, cochran
from stratafold.session import literal_rows
from stratafold.sources.store import Store
from stratafold.spec import MIN_ROW, STRATIFIED, UNIFORM, PrejoinSpec, QuerySpec, SampleSpec
from stratafold.workloads.star import star_query


def sales(spark, first, rows):
    """A hot stratum, one of NULL, small ones and, from 4,000 on, new ones; copies of rows."""
    stratum = (
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN CAST(id % 40 AS string) "
        "WHEN id >= 4000 AND id % 7 = 0 THEN concat('new', id % 50) END"
    )
    plain = spark.range(first, first + rows).selectExpr(
        "id", f"{stratum} AS k", "id % 2 AS g", "CAST(id % 9 AS double) AS v", "id % 5 AS d"
    )
    copies = spark.range(first, first + rows // 20).selectExpr(
        "1L AS id", "'hot' AS k", "1L AS g", "CAST(id % 9 AS double) AS v", "1L AS d"
    )
    return plain.union(copies).coalesce(2)


def dims(spark):
    return spark.range(5).selectExpr("id AS d_id", "CAST(id % 2 AS string) AS colour")


def query(qcs=("k",), joined=False):
    tables, pairs = (["dim"], ["d = d_id"]) if joined else ([], [])
    return star_query(
        "q", "f", pairs, tables, list(qcs), groups=["g"], sums={"total": F.col("v")}, counts=["n"]
    )


class Growing:
    def __init__(self, spark, folder):
        self.spark, self.path, self.folder = spark, str(folder / "f"), folder
        dims(spark).write.parquet(str(folder / "dim"))
        self.rows = 0

    def add(self, rows):
        sales(self.spark, self.rows, rows).write.mode("append").parquet(self.path)
        self.rows += rows

    def engine(self, name="grow", **tables):
        frames = {"f": self.spark.read.parquet(self.path), "dim": self.spark.read.parquet(str(self.folder / "dim"))}
        store = Store(self.spark, str(self.folder / "store"), name)
        return Engine({**frames, **tables}, store, {"f": ["id"]}, {"f": ["v"]})


@pytest.fixture
def growing(spark, tmp_path):
    return Growing(spark, tmp_path)


def rows(df):
    return sorted(map(repr, df.collect()))


def spec(kind, joined=False, **more):
    qcs = ("colour", "k") if joined else ("k",)
    tables, pairs = ({"dim"}, {"d = d_id"}) if joined else ((), ())
    return SampleSpec(kind, "f", qcs, frozenset(tables), frozenset(pairs), **more)


def not_whole(*_):
    raise AssertionError("the whole source is read")


SAMPLES = [
    spec(STRATIFIED, e=0.05),
    spec(MIN_ROW, min_rows=30),
    spec(MIN_ROW, joined=True, min_rows=20),
    spec(UNIFORM, ratio=0.1),
]


@pytest.mark.parametrize("sample", SAMPLES, ids=lambda s: f"{s.kind}-{len(s.tables)}")
def test_merged_sample_equals_a_full_build(growing, monkeypatch, sample):
    growing.add(3000)
    made = growing.engine()
    if len(sample.tables) > 1:
        made.build_prejoins([sample.as_query()])
    assert made.create_sample(sample, ["q"])
    for added in (40, 2000):
        growing.add(added)
        made = growing.engine()
        if len(sample.tables) > 1:
            made.build_prejoins([sample.as_query()])
        with monkeypatch.context() as patch:
            patch.setattr(made, "source_of", not_whole)
            assert made.create_sample(sample)
            assert not made.create_sample(sample)
        fresh = growing.engine(f"fresh{added}")
        fresh.build_prejoins([sample.as_query()] if sample.qcs and len(sample.tables) > 1 else [])
        fresh.create_sample(sample)
        assert rows(made.sample_rows(sample)) == rows(fresh.sample_rows(sample))
        if sample.kind != UNIFORM:
            assert rows(made.sizes(sample.as_query())) == rows(fresh.sizes(sample.as_query()))
    assert growing.engine().samples()[0][1] == ("q",)


def test_only_new_files_are_read(growing):
    growing.add(500)
    was = files_of(growing.engine().tables["f"]).collect()
    growing.add(100)
    fact = growing.engine().tables["f"]
    listed = literal_rows(growing.spark, [tuple(r) for r in was], files_of(fact).schema)
    new = rows_of(fact, appended(listed, files_of(fact)))
    assert new.count() == 105
    new.collect()
    scan = new._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert 0 < scan.metrics().apply("numFiles").value() < len(fact.inputFiles())


def test_removed_file_builds_anew(growing, monkeypatch):
    growing.add(1000)
    sample = spec(MIN_ROW, min_rows=30)
    growing.engine().create_sample(sample)
    sales(growing.spark, 500, 700).write.mode("overwrite").parquet(growing.path)
    made = growing.engine()
    monkeypatch.setattr("stratafold.engine.merge_sketch", not_whole)
    assert made.create_sample(sample)
    expected = min_row_sample(made.tables["f"], ["k"], 30, ["id"], order=["v"])
    assert rows(made.sample_rows(sample)) == rows(expected)


def test_a_changed_dimension_or_computation_builds_anew(growing, monkeypatch):
    growing.add(1000)
    sample = spec(MIN_ROW, joined=True, min_rows=20)
    made = growing.engine()
    made.build_prejoins([sample.as_query()])
    made.create_sample(sample)
    other = dims(growing.spark).withColumn("colour", F.lit("red"))
    other.write.parquet(str(growing.folder / "dim2"))
    monkeypatch.setattr("stratafold.engine.merge_sketch", not_whole)
    later = growing.engine(dim=growing.spark.read.parquet(str(growing.folder / "dim2")))
    later.build_prejoins([sample.as_query()])
    assert later.create_sample(sample)
    assert [r.colour for r in later.sizes(sample.as_query()).select("colour").distinct().collect()] == ["red"]
    growing.add(100)
    plain = spec(MIN_ROW, min_rows=30)
    growing.engine().create_sample(plain)
    doubled = growing.engine(f=growing.spark.read.parquet(growing.path).withColumn("v", F.col("v") * 2))
    assert doubled.create_sample(plain)
    assert doubled.sample_rows(plain).where("v > 8").count()


def test_answers_follow_the_fact(growing):
    growing.add(3000)
    sample = spec(STRATIFIED)
    growing.engine().create_sample(sample, ["q"])
    growing.add(3000)
    made = growing.engine()
    truth = {r.g: r for r in made.answer(query()).collect()}
    for row in made.approximate(query(), sample).collect():
        assert row.n == pytest.approx(truth[row.g].n, rel=0.1)
    report = made.evaluate(query(), sample).first()
    assert report.missing_group_ratio == 0 and report.avg_rel_error < 0.1
    new = made.sizes(sample.as_query()).where("k LIKE 'new%'").count()
    assert new and new == made.sample_rows(sample).where("k LIKE 'new%'").select("k").distinct().count()


def test_prejoin_grows_by_a_folder(growing, monkeypatch):
    growing.add(1000)
    wanted = PrejoinSpec.of("grow", query(("colour",), joined=True))
    growing.engine().build_prejoin(wanted)
    growing.add(50)
    made = growing.engine()
    monkeypatch.setattr(made, "build_prejoin", not_whole)
    made.refresh_prejoin(wanted)
    assert len(made.store.folders(wanted.name)) == 2
    assert made.store.read(wanted.name).count() == made.tables["f"].count()
    assert made.lossy_joins()[wanted.name] == () and made._stale_prejoins() == []
    # a row without a partner among the new ones makes the join lossy
    growing.spark.range(1).selectExpr(
        "-1L AS id", "'x' AS k", "0L AS g", "1.0D AS v", "99L AS d"
    ).write.mode("append").parquet(growing.path)
    later = growing.engine()
    later.refresh_prejoin(wanted)
    assert later.lossy_joins()[wanted.name] == ("dim",)
    assert growing.spark.table(later.store.register(wanted.name)).count() == made.tables["f"].count()
    assert len(later.store.folders(wanted.name)) == 1


def test_profile_counts_only_new_rows(growing, monkeypatch):
    growing.add(1000)
    wanted = [QuerySpec("a", "f", ("k",)), QuerySpec("b", "f", ("d", "g"))]
    growing.engine().profile(wanted)
    growing.add(4000)
    made = growing.engine()
    monkeypatch.setattr(made, "source_of", not_whole)
    made.profile(wanted)
    for q in wanted:
        got = made.sizes(q).select(*q.qcs, "groupsize")
        assert rows(got) == rows(stratum_sizes(made.tables["f"], list(q.qcs)).select(*q.qcs, "groupsize"))
        assert made.store.latest("stat", q.profile_name)["population_size"] == made.tables["f"].count()
    before = made.store.log().count()
    made.profile(wanted)
    assert made.store.log().count() == before


# -- sketches -----------------------------------------------------------------------------------


def merged(spark, shape, parts):
    """The sketch of all parts, merged one after the other; each part a DataFrame."""
    seen, sketch = parts[0], build_sketch(shape, parts[0], stratum_sizes(parts[0], shape.qcs))
    for part in parts[1:]:
        seen = seen.unionByName(part)
        sketch = merge_sketch(shape, sketch, part, stratum_sizes(seen, shape.qcs))
        if sketch is None:
            return None, seen
    return sketch, seen


@pytest.mark.parametrize("rule", [at_least(25), cochran(e=0.08)], ids=["min_row", "cochran"])
def test_many_small_merges(spark, rule):
    parts = [sales(spark, 0, 2000), *(sales(spark, 2000 + 300 * i, 300) for i in range(4))]
    shape = Shape(["k"], ["id"], rule, parts[0].columns, ["v"])
    sketch, seen = merged(spark, shape, parts)
    expected = stratified_sample(seen, ["k"], ["id"], rule=rule, order=["v"])
    assert rows(sketch.sample.select(*shape.columns)) == rows(expected)
    assert sketch.sample.count() < sketch.rows.count() < seen.count()


def test_copies_that_fit_in_part(spark):
    """A third of a stratum are copies of one row, of which only some fit before and after."""
    def part(first, n):
        key = "CASE WHEN id % 2 = 0 THEN 7 ELSE id END"
        return spark.range(first, first + n).selectExpr(f"{key} AS id", "'s' AS k", "CAST(id AS double) AS v")

    parts = [part(0, 600), part(600, 50), part(650, 600)]
    shape = Shape(["k"], ["id"], at_least(200), parts[0].columns, ["v"], tail=False)
    sketch, seen = merged(spark, shape, parts)
    if sketch is None:
        pytest.fail("the reserve holds enough copies")
    expected = min_row_sample(seen, ["k"], 200, ["id"], order=["v"], tail=False)
    assert rows(sketch.sample.select(*shape.columns)) == rows(expected)


def test_a_reserve_that_does_not_reach_is_noticed(spark):
    old, new = sales(spark, 0, 3000), sales(spark, 3000, 500)
    shape = Shape(["k"], ["id"], at_least(50), old.columns, ["v"])
    sketch = build_sketch(shape, old, stratum_sizes(old, ["k"]))
    low = Sketch(sketch.rows.where("_kept"), sketch.bounds.withColumn("_bound", F.lit("01")))
    assert merge_sketch(shape, low, new, stratum_sizes(old.union(new), ["k"])) is None


# -- mismatched sizes ---------------------------------------------------------------------------


def test_sizes_that_lack_a_stratum_are_an_error(spark):
    source = sales(spark, 0, 500)
    sizes = stratum_sizes(source, ["k"]).where("k = 'hot'")
    with pytest.raises(Exception, match="stratum has no size"):
        stratified_sample(source, ["k"], ["id"], sizes=sizes).collect()
    with pytest.raises(Exception, match="stratum has no size"):
        min_row_sample(source, ["k"], 5, ["id"], sizes=sizes).count()


@pytest.mark.parametrize("groups", [["k"], ["g"]])
def test_sizes_without_a_sampled_row_are_an_error(spark, groups):
    source = sales(spark, 0, 500)
    sizes = stratum_sizes(source, ["k"])
    more = sizes.unionByName(sizes.limit(1).withColumn("k", F.lit("unseen")))
    sums = {"total": F.col("v")}
    assert rescaled(source, sizes, ["k"], groups, sums, whole_strata=True).count()
    with pytest.raises(Exception, match="no sampled row"):
        rescaled(source, more, ["k"], groups, sums, whole_strata=True).collect()
    assert rescaled(source, more, ["k"], groups, sums).count()
    with pytest.raises(Exception, match="has no size"):
        rescaled(source, sizes.where("k <> 'hot'"), ["k"], groups, sums).collect()
    pinned = rescaled(source, more, ["k"], groups, sums, pinned={"k": "hot"}, whole_strata=True)
    assert pinned.count()


# -- states -------------------------------------------------------------------------------------


def test_state_of_computed_frames(growing, spark):
    growing.add(100)
    frame = spark.read.parquet(growing.path)
    again = spark.read.parquet(growing.path)
    states = [
        state_of(f)
        for f in (
            frame,
            frame.withColumn("v", F.col("v") * 2),
            frame.where("id % 2 = 0"),
            frame.where("id % 3 = 0"),
            frame.join(frame.where("id < 9").select("id"), "id", "left_anti"),
            frame.limit(3),
        )
    ]
    assert len(set(states)) == len(states)
    assert state_of(frame) == state_of(again)
    assert state_of(frame.where("id % 2 = 0")) == state_of(again.where("id % 2 = 0"))

    def tens(factor):
        return frame.withColumn("v", F.udf(lambda x: x * factor, "double")("v"))

    assert state_of(tens(1.0)) != state_of(tens(10.0))
    assert is_row_wise(frame.where("id > 3").withColumn("w", F.col("v") + 1))
    assert not any(map(is_row_wise, (tens(1.0), frame.groupBy("k").count(), frame.limit(2), frame.withColumn("r", F.rand()), spark.range(2))))


def test_state_reads_no_rows(growing, spark):
    """Files that are no Parquet at all have a state: nothing opens them."""
    growing.add(100)
    frame = spark.read.parquet(growing.path)
    before = state_of(frame)
    for path in (growing.folder / "f").glob("part-*"):
        path.write_bytes(b"no table")
    assert state_of(frame) != before
