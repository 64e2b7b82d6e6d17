"""Table publishing on plain parquet: full refresh, keyed upsert, audit
append and all-or-nothing multi-table publish (K1-K7).

Layout under ``root`` (a shared filesystem path on a cluster)::

    root/<table>/<uuid>/...                 data, never overwritten
    root/_manifests/v=<n>/part-*.json       one row per (table, data path)

A commit writes one manifest version with Spark (``errorifexists``, so
two writers cannot both commit version ``n``).  Every manifest row
carries the number of rows of its version; a version only counts when
all its rows are present, so a crash during the manifest write leaves the
previous version current.  Readers take the version numbers from the
file listing and read only the newest complete version.  Data
directories of failed or rolled-back loads are simply never referenced.  Nothing is overwritten in place, so a
job can read a table while publishing its next version (Spark refuses to
overwrite a path it reads).

On clusters that ship a transactional table format this protocol can be
swapped for it; the operators only use ``read``/``publish``.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablework.operators.quality import ContractError, assert_unique

_MANIFEST_SCHEMA = (
    "table string, path string, part string, schema_json string, not_null string, "
    "primary_key string, partition_expr string, n_rows_in_version long, committed_at string, meta string"
)

# Directory value Spark writes for a NULL partition value.
_NULL_PART = "__HIVE_DEFAULT_PARTITION__"

# Sentinel: keep the include filter of the previous snapshot (K7).
KEEP = object()


@dataclass
class TableEntry:
    name: str
    schema: StructType
    paths: list[tuple[str | None, str]] = field(default_factory=list)  # (part, path)
    not_null: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    partition_expr: str | None = None


class TableStore:
    """Versioned table store rooted at a shared directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ------------------------------------------------------------ manifest
    def _versions(self) -> list[int]:
        """Committed-or-partial manifest versions, newest first, from the
        file listing alone (``inputFiles`` runs no job)."""
        try:
            files = self.spark.read.format("text").load(f"{self.root}/_manifests").inputFiles()
        except AnalysisException:
            return []
        found = {int(m.group(1)) for f in files if (m := re.search(r"/v=(\d+)/", f))}
        return sorted(found, reverse=True)

    def _read_manifest(self) -> tuple[int, dict[str, TableEntry], dict]:
        """The newest complete manifest version: only that version's rows are
        read, so the cost does not grow with the number of commits."""
        for version in self._versions():
            rows = self.spark.read.schema(_MANIFEST_SCHEMA).json(f"{self.root}/_manifests/v={version}").collect()
            if rows and len(rows) == rows[0]["n_rows_in_version"]:
                return (version, *self._entries(rows))
        return 0, {}, {}

    @staticmethod
    def _entries(rows) -> tuple[dict[str, TableEntry], dict]:
        tables: dict[str, TableEntry] = {}
        meta: dict = {}
        for r in rows:
            meta = json.loads(r["meta"] or "{}")
            if r["table"] is None:
                continue
            e = tables.get(r["table"])
            if e is None:
                e = TableEntry(
                    r["table"],
                    StructType.fromJson(json.loads(r["schema_json"])),
                    [],
                    json.loads(r["not_null"] or "[]"),
                    json.loads(r["primary_key"] or "[]"),
                    r["partition_expr"],
                )
                tables[r["table"]] = e
            if r["path"]:
                e.paths.append((r["part"], r["path"]))
        return tables, meta

    def version(self) -> int:
        return self._read_manifest()[0]

    def tables(self) -> dict[str, TableEntry]:
        return self._read_manifest()[1]

    def _commit(self, version: int, tables: Mapping[str, TableEntry], meta: dict) -> int:
        rows = []
        now = dt.datetime.now(dt.timezone.utc).replace(microsecond=0).isoformat()
        for e in tables.values():
            base = (e.name, e.schema.json(), json.dumps(e.not_null), json.dumps(e.primary_key), e.partition_expr)
            for part, path in e.paths or [(None, None)]:
                rows.append((base[0], path, part, base[1], base[2], base[3], base[4]))
        if not rows:
            rows.append((None, None, None, None, None, None, None))
        n = len(rows)
        full = [(t, p, pt, s, nn, pk, pe, n, now, json.dumps(meta)) for t, p, pt, s, nn, pk, pe in rows]
        new_version = version + 1
        df = self.spark.createDataFrame(full, _MANIFEST_SCHEMA)
        df.coalesce(1).write.mode("errorifexists").json(f"{self.root}/_manifests/v={new_version}")
        return new_version

    # ------------------------------------------------------------ reads
    def read(self, name: str) -> DataFrame:
        entry = self.tables().get(name)
        if entry is None:
            raise KeyError(f"table {name} does not exist")
        return self._read_entry(entry)

    def _read_entry(self, entry: TableEntry, parts: Sequence[str] | None = None) -> DataFrame:
        paths = [p for part, p in entry.paths if parts is None or part in parts]
        if not paths:
            return self.spark.createDataFrame([], entry.schema)
        return self.spark.read.schema(entry.schema).parquet(*paths)

    # ------------------------------------------------------------ writes
    def _stage(self, name: str, df: DataFrame, partition_expr: str | None) -> list[tuple[str | None, str]]:
        target = f"{self.root}/{name}/{uuid.uuid4().hex}"
        if not partition_expr:
            df.write.mode("errorifexists").parquet(target)
            return [(None, target)]
        with_part = df.withColumn("__part", F.expr(partition_expr).cast("string"))
        with_part.write.mode("errorifexists").partitionBy("__part").parquet(target)
        # the written partition directories come from the listing (no job)
        files = self.spark.read.format("text").load(target).inputFiles()
        dirs = sorted({m.group(1) for f in files if (m := re.search(r"/(__part=[^/]+)/", f))})
        return [(unquote(d.split("=", 1)[1]), f"{target}/{d}") for d in dirs]

    def _validate(self, entry: TableEntry | None, df: DataFrame) -> None:
        if entry is None:
            return
        missing = [c for c in entry.schema.fieldNames() if c not in df.columns]
        if missing:
            raise ContractError(f"{entry.name}: missing column(s) {', '.join(missing)}")
        if entry.not_null:
            cond = F.lit(False)
            for c in entry.not_null:
                cond = cond | F.col(c).isNull()
            if df.where(cond).limit(1).count():
                raise ContractError(f"{entry.name}: NULL in a NOT NULL column ({', '.join(entry.not_null)})")
        if entry.primary_key:
            assert_unique(df, entry.primary_key)

    def ensure_table(
        self,
        name: str,
        schema: StructType,
        not_null: Sequence[str] = (),
        primary_key: Sequence[str] = (),
        partition_expr: str | None = None,
    ) -> bool:
        """K3: create the table (empty) with its constraints if absent.
        Returns True when it was created."""
        version, tables, meta = self._read_manifest()
        if name in tables:
            return False
        tables[name] = TableEntry(name, schema, [], list(not_null), list(primary_key), partition_expr)
        self._commit(version, tables, meta)
        return True

    def publish(
        self,
        outputs: Mapping[str, DataFrame],
        checks: Sequence[Callable[[Mapping[str, DataFrame]], None]] = (),
        appends: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]] | None = None,
        meta: dict | None = None,
    ) -> int:
        """K6: stage every output in a fresh directory, run ``checks`` on the
        staged tables, stage the ``appends`` (audit rows computed from the
        staged tables), then commit one manifest version.  Any exception
        leaves the previous version current (all or nothing)."""
        version, tables, old_meta = self._read_manifest()
        staged: dict[str, DataFrame] = {}
        new_tables = dict(tables)
        for name, df in outputs.items():
            entry = tables.get(name)
            if entry is not None:
                missing = [c for c in entry.schema.fieldNames() if c not in df.columns]
                if missing:
                    raise ContractError(f"{name}: missing column(s) {', '.join(missing)}")
            part_expr = entry.partition_expr if entry else None
            # Write first, then check the written data: the output plan runs
            # once; a failed check leaves only unreferenced directories.
            paths = self._stage(name, df, part_expr)
            new_tables[name] = TableEntry(
                name, df.schema, paths, entry.not_null if entry else [], entry.primary_key if entry else [], part_expr
            )
            staged[name] = self._read_entry(new_tables[name])
            self._validate(entry, staged[name])
        for check in checks:
            check(staged)
        for name, make in (appends or {}).items():
            rows = make(staged)
            entry = tables.get(name)
            if entry is not None:
                rows = rows.select(*entry.schema.fieldNames())
            paths = self._stage(name, rows, None)
            old_paths = entry.paths if entry else []
            kept = (entry.not_null, entry.primary_key, entry.partition_expr) if entry else ([], [], None)
            new_tables[name] = TableEntry(name, entry.schema if entry else rows.schema, old_paths + paths, *kept)
        merged_meta = dict(old_meta)
        merged_meta.update(meta or {})
        return self._commit(version, new_tables, merged_meta)

    def replace_table(self, name: str, df: DataFrame) -> int:
        """K1: full refresh (``CREATE OR REPLACE TABLE AS``)."""
        return self.publish({name: df})

    def upsert(self, name: str, incoming: DataFrame, keys: Sequence[str], meta: dict | None = None) -> int:
        """K5: delete target rows whose key matches an incoming row, insert
        all incoming rows.  Incoming keys must be unique.  For a partitioned
        table only the partitions touched by ``incoming`` are rewritten; the
        others are carried over by reference (the partition expression must
        be a function of the key columns, e.g. the month of a key date)."""
        version, tables, old_meta = self._read_manifest()
        entry = tables.get(name)
        if entry is None:
            raise KeyError(f"table {name} does not exist; create it with ensure_table")
        # the incoming delta feeds several jobs (checks, partition list,
        # merge): cache it for the duration of the upsert
        incoming = incoming.select(*entry.schema.fieldNames()).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._validate(entry, incoming)
            if entry.partition_expr:
                touched = [
                    _NULL_PART if r[0] is None else r[0]
                    for r in incoming.select(F.expr(entry.partition_expr).cast("string")).distinct().collect()
                ]
                old = self._read_entry(entry, touched)
                kept_paths = [(p, path) for p, path in entry.paths if p not in touched]
            else:
                old = self._read_entry(entry)
                kept_paths = []
            merged = upsert_frame(old, incoming, keys)
            new_paths = self._stage(name, merged, entry.partition_expr)
        finally:
            incoming.unpersist()
        tables = dict(tables)
        tables[name] = TableEntry(name, entry.schema, kept_paths + new_paths, entry.not_null, entry.primary_key, entry.partition_expr)
        merged_meta = dict(old_meta)
        merged_meta.update(meta or {})
        return self._commit(version, tables, merged_meta)

    def meta(self) -> dict:
        return self._read_manifest()[2]

    # ------------------------------------------------------------ K7
    def publish_snapshot(self, share: "TableStore", include=KEEP) -> list[str]:
        """K7: point ``share`` at the current data of the selected tables (no
        copy).  ``include``: KEEP = previous filter, None = all tables,
        [] = nothing, else ``schema.*`` / ``schema.table`` patterns (a name
        without a dot is in schema ``main``)."""
        _, tables, _ = self._read_manifest()
        s_version, _, s_meta = share._read_manifest()
        if include is KEEP:
            include = s_meta.get("include")
        names = sorted(n for n in tables if include is None or any(fnmatch.fnmatchcase(qualified(n), p) for p in include))
        chosen = {n: tables[n] for n in names}
        share._commit(s_version, chosen, {"include": include, "source_root": self.root})
        return names


def qualified(name: str) -> str:
    return name if "." in name else f"main.{name}"


def upsert_frame(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J4 + X2: survivors (target rows without a matching incoming key,
    ``left_anti``) plus all incoming rows."""
    survivors = target.join(incoming.select(*keys), list(keys), "left_anti")
    return survivors.unionByName(incoming.select(*target.columns))


def delete_matching(target: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(survivors, deleted) of ``DELETE ... USING keys_df``."""
    k = keys_df.select(*keys)
    return target.join(k, list(keys), "left_anti"), target.join(k, list(keys), "left_semi")


def glob_to_regex(pattern: str) -> str:
    """``schema.*`` style glob to an anchored Java/RE2 regex."""
    out = []
    for ch in pattern:
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch.isalnum() or ch == "_":
            out.append(ch)
        else:
            out.append("\\" + ch)
    return "^" + "".join(out) + "$"


def filter_inventory(inventory: DataFrame, include, schema_col: str = "table_schema", table_col: str = "table_name") -> DataFrame:
    """K7 on an inventory DataFrame: rows of tables selected by ``include``
    (None = all, [] = none, else globs over ``schema.table``)."""
    if include is None:
        return inventory
    if not include:
        return inventory.where(F.lit(False))
    name = F.concat_ws(".", F.col(schema_col), F.col(table_col))
    cond = F.lit(False)
    for p in include:
        cond = cond | name.rlike(glob_to_regex(p))
    return inventory.where(cond)
