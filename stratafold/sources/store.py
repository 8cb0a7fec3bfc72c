"""Where prejoins, stratum sizes, samples and answers live, and the log that names them.

Every artefact is a Parquet table in a folder of its own. A new version is
written to a new folder and becomes visible with one log row appended after the
write, so readers never see a half-written table and a job that dies leaves the
old version in place.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from datetime import UTC, datetime, timedelta
from urllib.parse import unquote

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from stratafold.session import literal_rows
from stratafold.sources import files
from stratafold.sources.log import DELETED, LOG_SCHEMA, latest, newest


def _folders_in(value) -> list[str]:
    """The texts of a log value that may be folders."""
    if isinstance(value, str):
        return [value] if "/" in value else []
    if isinstance(value, dict):
        return _folders_in(list(value.values()))
    return [text for part in value for text in _folders_in(part)] if isinstance(value, list) else []


class Store:
    """Tables and log of one database below ``root``, a folder all executors reach.

    The live entries of the log are descriptions, a few per query of a workload.
    They are read once and kept up to date with own appends; ``refresh`` picks up
    what other sessions appended.
    """

    def __init__(self, spark: SparkSession, root: str, database: str = "default"):
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{database}"
        self.database = database
        self._clock = datetime.min.replace(tzinfo=UTC)
        folder = self.root.replace("'", "\\'")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{folder}'")
        self.version = 0  # changes with the log
        self._appending = threading.Lock()
        self._seen: set[tuple[str, str]] = set()  # entries whose files were there
        self._create_log()
        self.refresh()

    # -- log -----------------------------------------------------------------

    @property
    def log_path(self) -> str:
        return f"{self.root}/_log"

    def _create_log(self) -> None:
        try:
            self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path)
        except AnalysisException:
            empty = literal_rows(self.spark, [(None,) * len(LOG_SCHEMA)], LOG_SCHEMA).limit(0)
            empty.write.mode("append").parquet(self.log_path)

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path)

    def refresh(self) -> None:
        try:
            rows = latest(self.log()).orderBy("ts").collect()
        except PySparkException:  # another session compacted the log between listing and reading
            rows = latest(self.log()).orderBy("ts").collect()
        self._live = {(row["type"], row["key"]): row["value"] for row in rows}
        if rows:  # a clock that lags must not write entries older than those there are
            newest = self.log().agg(F.max("ts")).first()[0]
            self._clock = max(self._clock, newest.astimezone(UTC))
        self.version += 1

    def append(self, *entries: tuple[str, str, dict | str]) -> None:
        """Log ``(type, key, value)`` entries. Values travel as data, never inside SQL text.

        Threads of one session append one after the other.
        """
        with self._appending:
            rows = []
            for kind, key, value in entries:
                # two entries of one process never share a timestamp
                self._clock = max(datetime.now(UTC), self._clock + timedelta(microseconds=1))
                text = value if isinstance(value, str) else json.dumps(value, sort_keys=True)
                rows.append((kind, key, text, self._clock))
            literal_rows(self.spark, rows, LOG_SCHEMA).write.mode("append").parquet(self.log_path)
            live = dict(self._live)
            for kind, key, text, _ in rows:
                live.pop((kind, key), None)
                if text != DELETED:
                    live[kind, key] = text
            self._live = live  # readers keep the version they look at
            self.version += 1

    def compact_log(self) -> int:
        """Replace the log's files by one with the newest entry of every key; how many went.

        The new file is complete before it appears, under its final name, and the old ones are
        deleted after that: whoever reads in between sees entries twice, which changes nothing.
        Tombstones are kept, so a half-done deletion brings nothing back. Files that other sessions
        append meanwhile stay.
        """
        with self._appending:
            log = self.log()
            old = [unquote(path) for path in log.inputFiles()]
            if len(old) < 2:
                return 0
            made = f"{self.root}/_compacted/{uuid.uuid4().hex[:12]}"
            newest(log).coalesce(1).write.parquet(made)
            for status in files.children(self.spark, made):
                if status.endswith(".parquet"):
                    files.rename(self.spark, status, f"{self.log_path}/{status.rsplit('/', 1)[1]}")
            for path in [*old, made]:
                files.delete(self.spark, path)
        return len(old)

    def vacuum(self, grace_seconds: float = 86_400) -> list[str]:
        """Delete folders that no live entry names; returns their paths.

        Those changed within ``grace_seconds`` stay, as a session may be about to log them. Frames
        that were read from a version that was replaced since can't be read any more.
        """
        self.refresh()
        named = [found for text in self._live.values() for found in _folders_in(json.loads(text))]
        named = {files.plain(path) for path in named}
        before = time.time() - grace_seconds
        gone = []
        for name in files.children(self.spark, self.root):
            if name.rsplit("/", 1)[1] == "_log":
                continue
            for folder in files.children(self.spark, name):
                plain = files.plain(folder)
                live = any(path == plain or path.startswith(f"{plain}/") for path in named)
                if not live and files.changed(self.spark, folder) <= before:
                    files.delete(self.spark, folder)
                    gone.append(plain)
        self._seen.clear()
        return sorted(gone)

    def remove(self, kind: str, key: str) -> None:
        self.append((kind, key, DELETED))

    def latest(self, kind: str, key: str) -> dict | None:
        text = self._live.get((kind, key))
        return None if text is None else json.loads(text)

    def entries(self, kind: str, prefix: str = "") -> list[tuple[str, dict]]:
        """Live entries of one type, newest first."""
        return [
            (key, json.loads(text))
            for (type_, key), text in reversed(self._live.items())
            if type_ == kind and key.startswith(prefix)
        ]

    # -- tables --------------------------------------------------------------

    def new_path(self, name: str) -> str:
        return f"{self.root}/{name}/{uuid.uuid4().hex[:12]}"

    @staticmethod
    def table_entry(
        name: str, path: str | list[str], schema: StructType, where: str = ""
    ) -> tuple[str, str, dict]:
        """The log entry that makes the Parquet files at ``path``, a folder or several, table
        ``name``. Columns of the files that ``schema`` lacks are not part of the table. ``where``
        names a boolean column that the folder is partitioned by: rows with it make the table."""
        value = {"path": path, "schema": schema.jsonValue()}
        return ("table", name, {**value, "where": where} if where else value)

    def write(self, name: str, df: DataFrame, overwrite: bool = False) -> bool:
        """Write ``df`` as table ``name``; without ``overwrite`` an existing one stays."""
        if not overwrite and self.exists(name):
            return False
        self.append(self.written(name, df))
        return True

    def written(self, name: str, df: DataFrame) -> tuple[str, str, dict]:
        """Write ``df`` and return the entry that makes it table ``name`` once it is appended."""
        path = self.new_path(name)
        df.write.parquet(path)
        return self.table_entry(name, path, df.schema)

    def extended(self, name: str, df: DataFrame) -> tuple[str, str, dict]:
        """Write ``df`` and return the entry that adds it to table ``name``; what is there stays."""
        entry = self.latest("table", name)
        path = self.new_path(name)
        schema = StructType.fromJson(entry["schema"])
        df.select(*schema.fieldNames()).write.parquet(path)
        return self.table_entry(name, [*self.folders(name), path], schema)

    def folders(self, name: str) -> list[str]:
        path = self.latest("table", name)["path"]
        return [path] if isinstance(path, str) else list(path)

    def exists(self, name: str) -> bool:
        """Logged and there when first looked for: a table removed before that does not count."""
        entry = self._live.get(("table", name))
        if entry is None or (name, entry) in self._seen:
            return entry is not None
        try:
            self.read(name)
        except (LookupError, AnalysisException):
            return False
        self._seen.add((name, entry))
        return True

    def read(self, name: str) -> DataFrame:
        entry = self.latest("table", name)
        if entry is None:
            raise LookupError(f"no table {name} in {self.root}")
        schema = StructType.fromJson(entry["schema"])
        if where := entry.get("where"):
            rows = self.spark.read.schema(StructType([*schema, StructField(where, BooleanType())]))
            return rows.parquet(*self.folders(name)).where(F.col(where)).select(*schema.fieldNames())
        return self.spark.read.schema(schema).parquet(*self.folders(name))

    def columns(self, name: str) -> list[str]:
        return self.read(name).columns

    def _catalog_name(self, name: str) -> str:
        """Names carry the root, so stores that share a database don't share tables."""
        return f"{name}_{hashlib.md5(self.root.encode()).hexdigest()[:8]}"

    def register(self, name: str) -> str:
        """Make the current version a catalog table, for SQL and for statistics; returns its name.

        A table of that name that lies elsewhere is not ours to replace. A catalog table has one
        folder, so one that grew into several is first written as one.
        """
        own = self._catalog_name(name)
        full = f"`{self.database}`.`{own}`"
        if self.spark.catalog.tableExists(f"{self.database}.{own}") and not self._ours(own):
            raise ValueError(f"{full} exists outside {self.root}")
        folder, where = self.folders(name)[0], self.latest("table", name).get("where")
        if len(self.folders(name)) > 1 or (where and self.read(name).isEmpty()):
            self.write(name, self.read(name), overwrite=True)
            folder, where = self.folders(name)[0], None
        self.spark.sql(f"DROP TABLE IF EXISTS {full}")
        self.spark.catalog.createTable(
            f"{self.database}.{own}",
            path=f"{folder}/{where}=true" if where else folder,
            source="parquet",
            schema=self.read(name).schema,
        )
        return full

    def _ours(self, name: str) -> bool:
        rows = self.spark.sql(f"DESCRIBE EXTENDED `{self.database}`.`{name}`")
        place = rows.where("col_name = 'Location'").select("data_type").first()
        root = self.root.removeprefix("file:").lstrip("/")
        return place is not None and f"/{root}/" in place[0]

    def analyze(self, name: str) -> None:
        """Collect table and column statistics for the cost-based optimizer."""
        full = self.register(name)
        self.spark.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS FOR ALL COLUMNS")

    def analyzed(self, name: str) -> bool:
        own = self._catalog_name(name)
        if not self.spark.catalog.tableExists(f"{self.database}.{own}") or not self._ours(own):
            return False
        rows = self.spark.sql(f"DESCRIBE EXTENDED `{self.database}`.`{own}`")
        return not rows.where("col_name = 'Statistics' AND data_type LIKE '%rows%'").isEmpty()
