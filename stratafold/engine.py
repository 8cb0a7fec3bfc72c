"""The workflow: prejoin, profile, advise, sample, evaluate, remember."""

from __future__ import annotations

import hashlib
import time
from collections import ChainMap
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratafold.functions.sizing import at_least, cochran
from stratafold.functions.state import appended, files_of, is_row_wise, rows_of, state_of
from stratafold.operators.approx import self_scaled
from stratafold.operators.evaluate import compare_answers
from stratafold.operators.joins import join_losses, star_join
from stratafold.operators.sampling import min_row_sample, stratified_sample, uniform_sample
from stratafold.operators.sketch import KEPT, Shape, Sketch, build_sketch, merge_sketch
from stratafold.operators.strata import (
    SUMMARY,
    add_counts,
    profile_many,
    summarise_profiles,
    with_targets,
)
from stratafold.plans.advisor import decide, samples_to_create
from stratafold.plans.prejoins import best_prejoin, prejoins_to_build
from stratafold.session import compact, literal_rows
from stratafold.sources.prejoin_file import prejoin_specs, read_prejoin_file
from stratafold.sources.store import Store
from stratafold.spec import (
    MIN_ROW,
    STRATIFIED,
    UNIFORM,
    JoinPair,
    PrejoinSpec,
    QuerySpec,
    SampleSpec,
)


#: Samples or answers that are computed side by side.
AT_ONCE = 4


def digest(content: str) -> str:
    return hashlib.md5(content.encode()).hexdigest()[:12]


class _Asked(Mapping):
    """Tables, with the names of those that were asked for."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self._tables, self.names = tables, set()

    def __getitem__(self, name: str) -> DataFrame:
        table = self._tables[name]
        self.names.add(name)
        return table

    def __iter__(self):
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)


class Engine:
    """Sampling for one database of tables.

    ``keys`` names the columns that identify a row of each fact; ``orders`` an
    optional order among rows that share a key.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        store: Store,
        keys: Mapping[str, Sequence[str]],
        orders: Mapping[str, Sequence[str]] | None = None,
        seed: int | str = 0,
    ):
        self.tables = tables
        self.store = store
        self.keys = dict(keys)
        self.orders = dict(orders or {})
        self.seed = seed
        self.spark = store.spark
        self._prejoins: tuple[int, list] = (-1, [])
        self._states: dict[str, tuple[DataFrame, str]] = {}

    # -- states --------------------------------------------------------------

    def _state_of(self, table: str) -> str:
        """The state of a table; a frame's files are listed once, when it is first asked for."""
        frame = self.tables[table]
        if table not in self._states or self._states[table][0] is not frame:
            self._states[table] = (frame, state_of(frame))
        return self._states[table][1]

    def _state(self, tables: Iterable[str]) -> str:
        return ",".join(f"{name}:{self._state_of(name)}" for name in sorted(tables))

    def _listing(self, fact: str) -> str:
        return f"files_{digest(f'{fact}:{self._state_of(fact)}')}"

    def _remember_files(self, fact: str) -> None:
        """Store which files a fact has now, so that later ones can be told from them."""
        name = self._listing(fact)
        if not self.store.exists(name) and is_row_wise(self.tables[fact]):
            self.store.write(name, files_of(self.tables[fact]))

    def _grown(self, was: str | None, fact: str, tables: Iterable[str]) -> DataFrame | None:
        """The fact's rows from files added since state ``was``; None if anything else changed."""
        if was is None:
            return None
        old = dict(part.split(":") for part in was.split(","))
        now = {name: self._state_of(name) for name in tables}
        if set(old) != set(now) or {t for t in now if now[t] != old[t]} != {fact}:
            return None
        listing = f"files_{digest(f'{fact}:{old[fact]}')}"
        # the part before the files' digest says what the frame computes
        if old[fact].split("-")[0] != now[fact].split("-")[0] or not self.store.exists(listing):
            return None
        self._remember_files(fact)
        paths = appended(self.store.read(listing), self.store.read(self._listing(fact)))
        return None if paths is None else rows_of(self.tables[fact], paths)

    def _source_state(self, query: QuerySpec | SampleSpec) -> str:
        return self._state({query.fact, *query.tables})

    def _joined(self, fact_rows: DataFrame, spec: QuerySpec | PrejoinSpec) -> DataFrame:
        """Some rows of the fact with the dimensions of a query or prejoin."""
        dims = spec.tables - {spec.fact}
        if not dims:
            return fact_rows
        return star_join(spec.fact, ChainMap({spec.fact: fact_rows}, self.tables), dims, spec.pairs)

    # -- prejoins ------------------------------------------------------------

    def _logged_prejoins(self) -> list[tuple[PrejoinSpec, tuple[str, ...]]]:
        """Prejoins with their lossy joins; looked up again only after the log changed."""
        if self._prejoins[0] != self.store.version:
            found = []
            for name, value in self.store.entries("prejoin"):
                if value["database"] == self.store.database and self.store.exists(name):
                    pairs = frozenset(JoinPair.parse(p) for p in value["pairs"])
                    tables = frozenset(value["tables"])
                    spec = PrejoinSpec(value["database"], value["fact"], tables, pairs, name)
                    found.append((spec, tuple(value["lossy"])))
            self._prejoins = (self.store.version, found)
        return self._prejoins[1]

    def prejoins(self) -> list[PrejoinSpec]:
        """Logged prejoins whose table still exists, newest first."""
        return [spec for spec, _ in self._logged_prejoins()]

    def lossy_joins(self) -> dict[str, tuple[str, ...]]:
        return {spec.name: lossy for spec, lossy in self._logged_prejoins()}

    def _prejoin_entry(
        self, prejoin: PrejoinSpec, rows: DataFrame | None = None, lossy: Iterable[str] = ()
    ) -> tuple[str, str, dict]:
        """The log entry of a prejoin; ``rows`` are those of the fact to check, all by default."""
        dims = prejoin.tables - {prejoin.fact}
        tables = self.tables if rows is None else ChainMap({prejoin.fact: rows}, self.tables)
        losses = join_losses(prejoin.fact, tables, dims, prejoin.pairs)
        # an unknown number is NULL and counts as harmful
        harmless = "coalesce(dropped_rows + multiplied_rows = 0, false)"
        harmful = losses.where(f"NOT {harmless}").select("dim").collect()
        value = {
            "database": prejoin.database,
            "fact": prejoin.fact,
            "tables": sorted(prejoin.tables),
            "pairs": sorted(map(str, prejoin.pairs)),
            "lossy": sorted({*lossy, *(row["dim"] for row in harmful)}),
            "state": self._state(prejoin.tables),
        }
        return ("prejoin", prejoin.name, value)

    def build_prejoin(self, prejoin: PrejoinSpec, overwrite: bool = False) -> bool:
        if not overwrite and self.store.exists(prejoin.name):
            return False
        self._remember_files(prejoin.fact)
        written = self.store.written(
            prejoin.name, self._joined(self.tables[prejoin.fact], prejoin)
        )
        self.store.append(written, self._prejoin_entry(prejoin))
        return True

    def refresh_prejoin(self, prejoin: PrejoinSpec) -> None:
        """Bring a prejoin up to its tables: rows of files added to the fact are joined and added,
        any other change builds it anew."""
        was = self.store.latest("prejoin", prejoin.name)
        new = self._grown(was.get("state"), prejoin.fact, prejoin.tables)
        if new is None:
            self.build_prejoin(prejoin, overwrite=True)
            return
        added = self.store.extended(prejoin.name, self._joined(new, prejoin))
        self.store.append(added, self._prejoin_entry(prejoin, new, was["lossy"]))

    def build_prejoins(self, queries: Sequence[QuerySpec]) -> list[PrejoinSpec]:
        """Materialise what the workload needs, then whatever containment alone gets wrong.

        A prejoin that loses or multiplies fact rows cannot stand in for a
        smaller one; a query left without a source gets its own join.
        """
        built = self._stale_prejoins()
        for prejoin in built:
            self.refresh_prejoin(prejoin)
        chosen = prejoins_to_build(queries, self.prejoins(), self.store.database)
        built += [p for p in chosen if self.build_prejoin(p)]
        for query in sorted(queries, key=lambda q: -len(q.tables)):
            if query.dims and best_prejoin(query, self.prejoins(), self.lossy_joins()) is None:
                own = PrejoinSpec.of(self.store.database, query)
                if self.build_prejoin(own):
                    built.append(own)
        return built

    def _stale_prejoins(self) -> list[PrejoinSpec]:
        """Logged prejoins made of another state of their tables."""
        logged = dict(self.store.entries("prejoin"))
        known = [p for p in self.prejoins() if p.tables <= set(self.tables)]
        return [p for p in known if logged[p.name].get("state") != self._state(p.tables)]

    def load_prejoins(self, path: str, facts: Sequence[str] | None = None) -> list[PrejoinSpec]:
        """Register described prejoins whose table exists."""
        described = read_prejoin_file(self.spark, path, facts or list(self.keys))
        specs = [p for p in prejoin_specs(described) if self.store.exists(p.name)]
        self.store.append(*(self._prejoin_entry(spec) for spec in specs))
        return specs

    def _source_name(self, query: QuerySpec) -> str | None:
        """The smallest prejoin that serves the query, None for the bare fact."""
        if not query.dims:
            return None
        prejoin = best_prejoin(query, self.prejoins(), self.lossy_joins())
        if prejoin is None:
            raise LookupError(f"no prejoin supports query {query.id}; build prejoins first")
        if prejoin in self._stale_prejoins():
            self.refresh_prejoin(prejoin)
        return prejoin.name

    def source_of(self, query: QuerySpec) -> DataFrame:
        """The fact or a prejoin; never a stand-in that lacks columns or rows."""
        name = self._source_name(query)
        return self.tables[query.fact] if name is None else self.store.read(name)

    # -- profiles and advice -------------------------------------------------

    def profile(self, queries: Iterable[QuerySpec], overwrite: bool = False) -> None:
        """Store stratum sizes and their summary for queries that lack them.

        A profile of another state of its tables counts as lacking; if only files were added to the
        fact, their rows are counted and added to it. All missing column sets of one source are
        counted in one scan.
        """
        missing: dict[tuple, dict[str, QuerySpec]] = {}
        for query in queries:
            if not query.qcs:
                continue
            was = (self.store.latest("state", query.profile_name) or {}).get("tables")
            there = self.store.exists(query.profile_name) and not overwrite
            if not there or was != self._source_state(query):
                key = (query.fact, self._source_name(query), was if there else None)
                missing.setdefault(key, {}).setdefault(query.profile_name, query)
        for (_, source, was), group in missing.items():
            self._profile_source(list(group.values()), source, was)

    def _profile_source(
        self, queries: Sequence[QuerySpec], source: str | None, was: str | None
    ) -> None:
        """One scan, one write with a folder per column set, one summary, one log append."""
        first = queries[0]
        new = self._grown(was, first.fact, first.tables)
        if new is None:
            self._remember_files(first.fact)
            rows = self.source_of(first)
        else:
            prejoins = {p.name: p for p in self.prejoins()}
            rows = self._joined(new, first if source is None else prejoins[source])
        counted = profile_many(rows, [q.qcs for q in queries])
        if new is not None:
            counted = add_counts(counted, [self.sizes(q) for q in queries])
        counted = with_targets(counted, cochran())
        path = self.store.new_path(f"profiles_{first.fact}")
        counted.write.partitionBy("profile").parquet(path)
        profiles = self.spark.read.schema(counted.schema).parquet(path)
        summaries = {r["profile"]: r.asDict() for r in summarise_profiles(profiles).collect()}
        entries = []
        for position, query in enumerate(queries):
            columns = [*query.qcs, "groupsize", "target_group_sample_size"]
            schema = counted.select(*columns).schema
            folder = f"{path}/profile={position}"
            # an empty source has no strata and so no summary
            summary = {name: summaries.get(position, {}).get(name, 0) or 0 for name in SUMMARY}
            entries.append(Store.table_entry(query.profile_name, folder, schema))
            entries.append(("stat", query.profile_name, summary))
            state = {"tables": self._source_state(query)}
            entries.append(("state", query.profile_name, state))
        self.store.append(*entries)

    def sizes(self, query: QuerySpec) -> DataFrame:
        """Stored stratum sizes; asking for a profile that was never made is an error."""
        return self.store.read(query.profile_name)

    def advise(self, queries: Sequence[QuerySpec]) -> DataFrame:
        queries = [q for q in queries if q.qcs]
        self.profile(queries)
        stats = dict(self.store.entries("stat"))
        rows = [
            (q.id, *(stats[q.profile_name][name] for name in SUMMARY)) for q in queries
        ]
        types = ["bigint", "bigint", "double", "double", "bigint", "bigint"]
        fields = [f"{name} {kind}" for name, kind in zip(SUMMARY, types)]
        schema = StructType.fromDDL(", ".join(["query_id string", *fields]))
        return decide(literal_rows(self.spark, rows, schema))

    # -- samples -------------------------------------------------------------

    def build_sample(self, sample: SampleSpec) -> DataFrame:
        fact = self.tables[sample.fact]
        key, order = self.keys[sample.fact], self.orders.get(sample.fact, ())
        if sample.kind == UNIFORM:
            return uniform_sample(fact, sample.ratio, key, self.seed)
        options = dict(order=order, seed=self.seed, columns=fact.columns)
        query = sample.as_query()
        source = self.source_of(query)
        self.profile([query])
        options["sizes"] = self.sizes(query)
        if sample.kind == STRATIFIED:
            rule = cochran(sample.z, sample.e)
            return stratified_sample(source, sample.qcs, key, rule=rule, **options)
        return min_row_sample(source, sample.qcs, sample.min_rows, key, **options)

    def _expected_share(self, sample: SampleSpec) -> float:
        """About which share of the fact the sample keeps, from the stored summary."""
        if sample.kind == UNIFORM:
            return sample.ratio
        stat = self.store.latest("stat", sample.as_query().profile_name)
        wanted = stat["target_sample_size"]
        if sample.kind == MIN_ROW:
            wanted = sample.min_rows * stat["group_count"]
        return wanted / max(stat["population_size"], 1)

    def create_sample(
        self, sample: SampleSpec, query_ids: Sequence[str] = (), overwrite: bool = False
    ) -> bool:
        """Write, analyse and log a sample. A current one only gains queries.

        A sample of another state of its tables follows them: rows of files added to the fact
        are merged into it, any other change builds it anew. Both give the same rows.
        """
        logged = self.store.latest("sample", sample.name) if self.store.exists(sample.name) else None
        state = self._source_state(sample)
        made = overwrite or logged is None or logged.get("state") != state
        entries = []
        if made:
            was = None if overwrite or logged is None else logged.get("state")
            entries = [*self._drawn(sample, was), ("sample", sample.name, self._value(sample, state))]
        for query_id in query_ids:  # an entry each: sessions that add queries lose none
            key = f"{sample.name}/{query_id}"
            if self.store.latest("sample_query", key) is None:
                entries.append(("sample_query", key, {"query": query_id}))
        if entries:
            self.store.append(*entries)
        if made:
            self.store.analyze(sample.name)
        return made

    @staticmethod
    def _value(sample: SampleSpec, state: str) -> dict:
        value = asdict(sample)
        value["tables"] = sorted(sample.tables)
        value["pairs"] = sorted(map(str, sample.pairs))
        value["label"] = sample.label
        value["state"] = state
        return value

    def _drawn(self, sample: SampleSpec, was: str | None) -> list[tuple[str, str, dict]]:
        """Write the sample of the tables as they are; ``was`` is the state of the stored one."""
        new = self._grown(was, sample.fact, sample.tables)
        self._remember_files(sample.fact)
        fact = self.tables[sample.fact]
        if sample.kind == UNIFORM:
            rows = uniform_sample(
                fact if new is None else new, sample.ratio, self.keys[sample.fact], self.seed
            )
            rows = compact(rows, sample.ratio)
            if new is None:
                return [self.store.written(sample.name, rows)]
            return [self.store.extended(sample.name, rows)]
        if not is_row_wise(fact):  # nothing to follow: such a fact is only ever drawn whole
            rows = compact(self.build_sample(sample), self._expected_share(sample))
            return [self.store.written(sample.name, rows)]
        query = sample.as_query()
        self.profile([query])
        sizes, shape = self.sizes(query), self._shape(sample)
        share = self._expected_share(sample)
        paths = {part: self.store.new_path(f"{sample.name}_{part}") for part in ("cutoffs", "rows")}

        def save(df: DataFrame, part: str) -> DataFrame:
            by = [KEPT] if part == "rows" else []
            df.write.mode("overwrite").partitionBy(*by).parquet(paths[part])
            return self.spark.read.schema(df.schema).parquet(paths[part])

        sketch = None
        if new is not None and (old := self._sketch(sample)) is not None:
            sketch = merge_sketch(shape, old, self._joined(new, sample), sizes, share, save)
        if sketch is None:
            source = self.source_of(query)
            paths["cutoffs"] = self.store.new_path(f"{sample.name}_cutoffs")
            sketch = build_sketch(shape, source, sizes, share, save)
        schemas = {"rows": sketch.rows.schema, "cutoffs": sketch.bounds.schema}
        schemas = {part: schema.jsonValue() for part, schema in schemas.items()}
        # the sample has the fact's columns; its files also hold the strata's
        return [
            Store.table_entry(sample.name, paths["rows"], fact.schema, where=KEPT),
            ("sketch", sample.name, {**paths, "schemas": schemas}),
        ]

    def _shape(self, sample: SampleSpec) -> Shape:
        return Shape(
            sample.qcs,
            self.keys[sample.fact],
            cochran(sample.z, sample.e) if sample.kind == STRATIFIED else at_least(sample.min_rows),
            self.tables[sample.fact].columns,
            self.orders.get(sample.fact, ()),
            self.seed,
        )

    def _sketch(self, sample: SampleSpec) -> Sketch | None:
        value = self.store.latest("sketch", sample.name)
        if value is None or self.store.folders(sample.name) != [value["rows"]]:
            return None
        rows, bounds = (
            self.spark.read.schema(StructType.fromJson(value["schemas"][part])).parquet(value[part])
            for part in ("rows", "cutoffs")
        )
        return Sketch(rows, bounds)

    def create_advised(
        self, queries: Sequence[QuerySpec], overwrite: bool = False
    ) -> list[SampleSpec]:
        """Advise the workload and create what is advised, each sample once."""
        samples = samples_to_create(queries, self.advise(queries))
        users = [
            [
                q.id
                for q in queries
                if (q.fact, q.tables, q.pairs, q.qcs)
                == (sample.fact, sample.tables, sample.pairs, sample.qcs)
            ]
            for sample in samples
        ]
        self.create_samples(list(zip(samples, users)), overwrite)
        return samples

    def create_samples(
        self, wanted: Sequence[tuple[SampleSpec, Sequence[str]]], overwrite: bool = False
    ) -> None:
        """Create samples with the ids of their queries, side by side: the jobs of one don't wait
        for those of another. What they share, prejoins and profiles, is brought up to date first."""
        self.profile([s.as_query() for s, _ in wanted if s.kind != UNIFORM])
        for sample, _ in wanted:
            self._source_state(sample)
            self._remember_files(sample.fact)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(lambda one: self.create_sample(*one, overwrite), wanted))

    def create_min_row_sample(
        self,
        tables: Sequence[str],
        columns: Sequence[str],
        min_rows: int,
        pairs: Iterable[str] = (),
        overwrite: bool = False,
    ) -> SampleSpec:
        """A sample from table and column lists; the first table with a key is the fact."""
        fact = next((t for t in tables if t in self.keys), None)
        if fact is None:
            raise ValueError(f"none of {list(tables)} is a fact table")
        spec = SampleSpec(
            MIN_ROW, fact, tuple(columns), frozenset(tables), frozenset(pairs), min_rows=min_rows
        )
        self.create_sample(spec, overwrite=overwrite)
        return spec

    def samples(self) -> list[tuple[SampleSpec, tuple[str, ...]]]:
        """Live samples with the ids of their queries, newest first."""
        found = []
        for _, value in self.store.entries("sample"):
            spec = SampleSpec(
                value["kind"],
                value["fact"],
                tuple(value["qcs"]),
                frozenset(value["tables"]),
                frozenset(JoinPair.parse(p) for p in value["pairs"]),
                value["ratio"],
                value["z"],
                value["e"],
                value["min_rows"],
            )
            if self.store.exists(spec.name):
                users = self.store.entries("sample_query", f"{spec.name}/")
                found.append((spec, tuple(sorted(v["query"] for _, v in users))))
        return found

    def drop_sample(self, sample: SampleSpec) -> None:
        """Forget a sample and its queries; ``Store.vacuum`` frees its files."""
        for key, _ in self.store.entries("sample_query", f"{sample.name}/"):
            self.store.remove("sample_query", key)
        for kind in ("sample", "table", "sketch"):
            self.store.remove(kind, sample.name)

    def sample_rows(self, sample: SampleSpec) -> DataFrame:
        return self.store.read(sample.name)

    # -- evaluation ----------------------------------------------------------

    def answer(self, query: QuerySpec) -> DataFrame:
        return query.template(self.tables[query.fact], self.tables)

    def _answer_from_prejoin(self, query: QuerySpec) -> DataFrame:
        """The exact answer from a current prejoin that serves the query, whose join is stored
        already; from the tables if there is none."""
        if query.dims and query.joined_template is not None:
            prejoin = best_prejoin(query, self.prejoins(), self.lossy_joins())
            if prejoin is not None and prejoin not in self._stale_prejoins():
                return query.joined_template(self.store.read(prejoin.name))
        return self.answer(query)

    def approximate(self, query: QuerySpec, sample: SampleSpec) -> DataFrame:
        """The query's rescaled answer from a sample, which follows its tables first."""
        if query.sample_template is None:
            raise ValueError(f"query {query.id} has no rescaled form")
        made = sample.as_query()
        self.create_sample(sample)  # sizes and rows have to be of one state
        if sample.kind == UNIFORM:
            return query.sample_template(self.sample_rows(sample), self.tables, None, sample)
        self.profile([made])
        return query.sample_template(
            self.sample_rows(sample), self.tables, self.sizes(made), sample
        )

    def _reads(self, query: QuerySpec) -> set[str]:
        """The tables that a query's template asks for."""
        asked = _Asked(self.tables)
        query.template(asked[query.fact], asked)
        return asked.names

    def _timed(self, df: DataFrame) -> float:
        self.spark.catalog.clearCache()
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def _answer_names(self, query: QuerySpec, sample: SampleSpec) -> tuple[str, str]:
        """Names of the exact and the plain sampled answer: what they were made of."""
        content = f"{query!r}{query.groups}{query.aggs}{self._state(self._reads(query))}"
        made_of = str(self.store.folders(sample.name))
        return (
            f"q{query.id}_{digest(content)}_orig",
            f"q{query.id}_{digest(content + made_of)}_{sample.name}",
        )

    def _store_answers(
        self, pairs: Iterable[tuple[QuerySpec, SampleSpec]], measure_time: bool
    ) -> dict[str, float]:
        """Write the answers that are not stored yet, all if they are to be timed, and log them
        together. Untimed ones don't wait for each other, and exact ones read prejoins; timed ones
        read the tables. The seconds of timed ones by name."""
        missing: dict[str, DataFrame] = {}
        for query, sample in pairs:
            self.create_sample(sample)
            if measure_time and not self.store.analyzed(sample.name):
                self.store.analyze(sample.name)
            plain = query.template(self.sample_rows(sample), self.tables)
            exact = self.answer(query) if measure_time else self._answer_from_prejoin(query)
            for name, answer in zip(self._answer_names(query, sample), (exact, plain)):
                if measure_time or not self.store.exists(name):
                    missing[name] = answer
        seconds, entries = {}, []
        if measure_time:
            for name, answer in missing.items():
                self.spark.catalog.clearCache()
                start = time.perf_counter()
                entries.append(self.store.written(name, answer))
                seconds[name] = time.perf_counter() - start
        else:
            with ThreadPoolExecutor(AT_ONCE) as pool:
                entries += pool.map(self.store.written, missing.keys(), missing.values())
        if entries:
            self.store.append(*entries)
        return seconds

    def evaluate(
        self, query: QuerySpec, sample: SampleSpec, measure_time: bool = False
    ) -> DataFrame:
        """One row: groups, missing ratio, errors, and times if asked for.

        Both answers are stored under what they were made of, the query and the
        state of the tables it reads or the sample, and used again as long as that
        holds; timing computes them anew.
        """
        return self._report(query, sample, self._store_answers([(query, sample)], measure_time))

    def _report(
        self, query: QuerySpec, sample: SampleSpec, seconds: Mapping[str, float]
    ) -> DataFrame:
        exact_name, plain_name = self._answer_names(query, sample)
        exact, plain = self.store.read(exact_name), self.store.read(plain_name)
        own_scale = self_scaled(exact, plain, query.groups, query.aggs)
        estimate = own_scale
        if query.sample_template is not None:
            estimate = self.approximate(query, sample)
        report = compare_answers(
            exact,
            estimate,
            query.groups,
            query.aggs,
            other=own_scale,
            other_error="self_scaled_error",
        )

        exact_seconds = sample_seconds = None
        if seconds:
            exact_seconds, sample_seconds = seconds[exact_name], seconds[plain_name]
            if query.sample_template is not None:
                sample_seconds = self._timed(self.approximate(query, sample))
        return (
            report.withColumn("query_id", F.lit(query.id))
            .withColumn("sample", F.lit(sample.name))
            .withColumn("exact_seconds", F.lit(exact_seconds).cast("double"))
            .withColumn("sample_seconds", F.lit(sample_seconds).cast("double"))
        )

    def evaluate_all(
        self, queries: Sequence[QuerySpec], measure_time: bool = False
    ) -> DataFrame | None:
        """Every live sample against each query it was made for."""
        by_id = {q.id: q for q in queries if q.template is not None}
        pairs = [(by_id[i], s) for s, ids in self.samples() for i in ids if i in by_id]
        return self._reports(pairs, measure_time)

    def evaluate_sample(
        self,
        name: str,
        query_ids: Sequence[str],
        queries: Sequence[QuerySpec],
        measure_time: bool = False,
    ) -> DataFrame | None:
        """One sample, by name or label, against the listed queries."""
        named = [s for s, _ in self.samples() if name in (s.name, s.label)]
        if len(named) != 1:
            raise LookupError(f"{len(named) or 'no'} samples named {name}")
        sample = named[0]
        chosen = [q for q in queries if q.id in set(query_ids) and q.template is not None]
        return self._reports([(q, sample) for q in chosen], measure_time)

    def _reports(
        self, pairs: Sequence[tuple[QuerySpec, SampleSpec]], measure_time: bool
    ) -> DataFrame | None:
        seconds = self._store_answers(pairs, measure_time)
        reports = [self._report(query, sample, seconds) for query, sample in pairs]
        return reduce(DataFrame.unionByName, reports) if reports else None
