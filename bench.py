"""Benchmark: every registered query, and exact answers beside answers from stored samples.

Prints one JSON line. ``queries`` holds seconds per query with all rows
computed, ``value`` their sum. ``samples`` compares, per query of the workload,
the exact answer with the answer from a sample that was stored beforehand.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stratafold.operators import joins, sampling, strata  # noqa: E402
from stratafold.operators.evaluate import compare_answers  # noqa: E402
from stratafold.session import compact, local_session, pin  # noqa: E402
from stratafold.spec import STRATIFIED, SampleSpec  # noqa: E402
from stratafold.workloads import registry, tpch  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COMPARED = ("flag", "42", "43", "47", "65", "88")



def timed(build) -> float:
    start = time.perf_counter()
    df = build()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def compare_with_sample(spark, query) -> dict:
    tables = tpch.load(spark, SF_DIR)
    fact = tables[query.fact]
    source = joins.star_join(query.fact, tables, query.dims, query.pairs)
    start = time.perf_counter()
    sizes = pin(strata.stratum_sizes(source, query.qcs), "sizes")
    sample = sampling.stratified_sample(
        source,
        query.qcs,
        tpch.KEYS[query.fact],
        order=tpch.ORDERS.get(query.fact, ()),
        sizes=sizes,
        columns=fact.columns,
    )
    stored = pin(compact(sample), "sample")
    build = time.perf_counter() - start
    made = SampleSpec(STRATIFIED, query.fact, query.qcs, query.tables, query.pairs)

    def exact():
        return query.template(fact, tables)

    def approx():
        return query.sample_template(stored, tables, sizes, made)

    report = compare_answers(exact(), approx(), query.groups, query.aggs).first()
    exact_seconds = min(timed(exact) for _ in range(3))
    sample_seconds = min(timed(approx) for _ in range(3))
    return {
        "build_sec": round(build, 3),
        "exact_sec": round(exact_seconds, 3),
        "sample_sec": round(sample_seconds, 3),
        "sample_rows_ratio": round(stored.count() / fact.count(), 4),
        "avg_rel_error": round(report["avg_rel_error"], 5),
        "missing_group_ratio": report["missing_group_ratio"],
    }


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = local_session(CPUS, "bench", **{"spark.checkpoint.dir": scratch})
    # one unmeasured pass over the flagship, so the first query does not pay for start-up
    registry.flagship(spark, SF_DIR).collect()
    seconds = {}
    for name, query in registry.QUERIES.items():
        seconds[name] = round(timed(lambda: query(spark, SF_DIR)), 3)
    samples = {
        q.id: compare_with_sample(spark, q) for q in tpch.workload() if q.id in COMPARED
    }
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "samples": samples,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": CPUS,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
