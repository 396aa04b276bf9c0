"""Plans carried out on Spark tables: what a phase changes is staged, checked and then published at once, so that readers see all of a phase or nothing of it.

A store is a folder with data folders and numbered manifests. A manifest names the folder of every live table; the one of the highest number counts. A new
version of a table is written next to the old one, and publishing is the creation of the next manifest, which fails if another writer was faster. Readers keep the
folders that they have begun with. A phase that fails loses its staged folders and no more.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import ascii_upper_text
from ..operators import checks, policy
from ..operators.apply import STEPS, applied, spark_type
from .compare import Plan
from .execute import ExecutionFailed, Item, Report
from .journal import digest
from .options import STOP


class Conflict(RuntimeError):
    """Another writer has published since this one began."""


class UnknownStoredTable(KeyError):
    """A table that the store does not have."""


class RowsRefused(RuntimeError):
    """Rows break a constraint that a command adds."""


@dataclass(frozen=True)
class Stored:
    name: str
    folder: str


@dataclass(frozen=True)
class Manifest:
    """The live tables by key, and the phases of a plan, known by its digest, that are done."""

    version: int = 0
    tables: dict[str, Stored] = field(default_factory=dict)
    plan: str = ""
    phases: tuple[str, ...] = ()

    def lines(self) -> str:
        """One JSON object a line: the head, then the tables by key."""
        head = {"version": self.version, "plan": self.plan, "phases": list(self.phases)}
        return "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in (head, *({"key": k, "name": t.name, "folder": t.folder} for k, t in sorted(self.tables.items()))))


def _manifest(text: str) -> Manifest:
    head, *tables = map(json.loads, text.splitlines())
    return Manifest(head["version"], {t["key"]: Stored(t["name"], t["folder"]) for t in tables}, head["plan"], tuple(head["phases"]))


class Store:
    """Tables of Parquet folders under root, which driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list:
        path = self._path(f"{self.root}/{folder}")
        files = self._files(path)
        return list(files.listStatus(path)) if files.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of the manifests, ascending."""
        names = [x.getPath().getName() for x in self._listed("manifests")]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"[0-9]{10}\.json", n))

    def _manifest_path(self, version: int):
        return self._path(f"{self.root}/manifests/{version:010d}.json")

    def manifest(self, version: int | None = None) -> Manifest:
        """What was live at a version; the last one by default. A store without any has no tables."""
        if version is None:
            found = self.versions()
            if not found:
                return Manifest()
            version = found[-1]
        path = self._manifest_path(version)
        stream = self._files(path).open(path)
        try:
            return _manifest(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        found = self.manifest(version).tables.get(ascii_upper_text(name))
        if found is None:
            raise UnknownStoredTable(name)
        return self.spark.read.parquet(found.folder)

    def published(self, manifest: Manifest) -> Manifest:
        """manifest, live from now on; Conflict if its version is there already. The file appears whole under its name or not at all."""
        target, staged = self._manifest_path(manifest.version), self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        out = self._files(target).create(staged, False)
        out.write(bytearray(manifest.lines().encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(staged), context.makeQualified(target), none)
        except Py4JJavaError as error:
            self._files(staged).delete(staged, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {manifest.version} is published already") from None
            raise
        return manifest

    def adopted(self, **folders: str) -> Manifest:
        """The store with tables whose Parquet folders or files are elsewhere; they are read and never changed or deleted."""
        now = self.manifest()
        return self.published(Manifest(now.version + 1, {**now.tables, **{ascii_upper_text(n): Stored(n, f) for n, f in folders.items()}}))

    def staging(self, key: str) -> str:
        return f"{self.root}/data/{re.sub(r'[^A-Za-z0-9_]', '_', key)}-{uuid.uuid4().hex}"

    def discard(self, folders: Iterable[str]) -> None:
        for folder in folders:
            path = self._path(folder)
            self._files(path).delete(path, True)

    def vacuum(self, keep: int = 2, older_than: float = 24 * 3600) -> int:
        """Deletes data folders that none of the last keep manifests names and that are at least older_than seconds old, and older manifests. How many folders went."""
        kept = self.versions()[-keep:]
        named = {self._path(t.folder).getName() for v in kept for t in self.manifest(v).tables.values()}
        limit = (time.time() - older_than) * 1000
        old = [x.getPath() for x in self._listed("data") if x.getPath().getName() not in named and x.getModificationTime() <= limit]
        for path in old:
            self._files(path).delete(path, True)
        for version in self.versions()[:-keep]:
            path = self._manifest_path(version)
            self._files(path).delete(path, False)
        return len(old)


_CONSTRAINTS = ("CreatePrimaryKey", "CreateIndexe", "CreateForeignKey", "CreateCheck", "AlterCheck")


def _names(text: str) -> list[str]:
    return [x for x in (text or "").split(", ") if x]


def _refused(row: Row, rows: Callable[[str], DataFrame]) -> str:
    """What rows have against a constraint, or ''. rows gives the table of a key as it is now."""
    own, columns = rows(row.table_key), _names(row.attrs.get("columns", ""))
    if row.op == "CreatePrimaryKey":
        return "" if checks.key_violations(own, columns).isEmpty() else "keys are null or not unique"
    if row.op == "CreateIndexe":
        return "" if row.attrs["is_unique"] != "true" or checks.duplicate_keys(own, columns, False).isEmpty() else "keys are not unique"
    if row.op == "CreateForeignKey":
        return "" if checks.orphans(own, columns, rows(row.attrs["parent_key"]), _names(row.attrs["to_columns"])).isEmpty() else "rows refer to nothing"
    return "" if checks.check_violations(own, row.attrs["condition"]).isEmpty() else "rows break the condition"


class _Run:
    """One phase after another on a store; live is what readers see, now what the run has come to."""

    def __init__(self, plan: Plan, store: Store, lossy: bool, workers: int):
        self.plan, self.store, self.lossy, self.workers = plan, store, lossy, workers
        self.live = store.manifest()
        self.now = dict(self.live.tables)
        self.staged: list[str] = []

    def rows(self, key: str) -> DataFrame:
        if key not in self.now:
            raise UnknownStoredTable(key)
        return self.store.spark.read.parquet(self.now[key].folder)

    def write(self, key: str, name: str, rows: DataFrame) -> Stored:
        folder = self.store.staging(key)
        self.staged.append(folder)
        rows.write.parquet(folder)
        return Stored(name, folder)

    def created(self, row: Row) -> Stored:
        own = self.plan.desired.columns.filter(F.col("table_key") == row.table_key).orderBy("position").collect()
        columns = ", ".join(f"`{c.column_name}` {spark_type(c.asDict())}" for c in own)
        return self.write(row.table_key, row.table_name, self.store.spark.createDataFrame([], columns))

    def changed(self, key: str, steps: list[Row]) -> Stored:
        """The table after its column commands, in one pass over its rows; those that become NOT NULL are looked at in what was written."""
        made = self.write(key, self.now[key].name, applied(self.rows(key), [s.asDict() for s in steps], self.lossy))
        strict = sorted({s.name for s in steps if s.op in ("AlterColumn", "CreateColumn") and s.attrs.get("not_null") == "true"})
        if strict and not checks.null_rows(self.store.spark.read.parquet(made.folder), strict).isEmpty():
            raise RowsRefused(f"nulls in {', '.join(strict)}")
        return made

    def phase(self, commands: list[Row], items: list[Item], clock: Callable[[], float]) -> None:
        """Does the commands of a phase, several tables at a time; the first failure ends it."""
        work: list[tuple[list[int], Callable[[], None]]] = []
        at = {"tables": [k for k, c in enumerate(commands) if c.op in ("CreateTable", "DropTable")], "steps": [k for k, c in enumerate(commands) if c.op in STEPS], "checks": [k for k, c in enumerate(commands) if c.op in _CONSTRAINTS]}

        def table(c: Row) -> Callable[[], None]:
            return (lambda: self.now.pop(c.table_key, None)) if c.op == "DropTable" else (lambda: self.now.__setitem__(c.table_key, self.created(c)))

        def check(c: Row) -> Callable[[], None]:
            def run() -> None:
                if found := _refused(c, self.rows):
                    raise RowsRefused(found)

            return run

        def steps(own: list[Row]) -> Callable[[], None]:
            return lambda: self.now.__setitem__(own[0].table_key, self.changed(own[0].table_key, own))

        work += [([k], table(commands[k])) for k in at["tables"]]
        by_table: dict[str, list[int]] = {}
        for k in at["steps"]:
            by_table.setdefault(commands[k].table_key, []).append(k)
        work += [(own, steps([commands[k] for k in own])) for own in by_table.values()]
        work += [([k], check(commands[k])) for k in at["checks"]]
        idle = set(range(len(commands))) - {k for own, _ in work for k in own}
        for k in idle:  # views, routines, comments: Spark tables have no place for them
            items[k].status = "Empty"
        errors: list[Exception] = []

        def run(job: tuple[list[int], Callable[[], None]]) -> None:
            own, act = job
            if errors:
                return
            began = clock()
            try:
                act()
                status, error = "Succeeded", ""
            except Exception as failure:
                errors.append(failure)
                status, error = "Failed", str(failure).strip().split("\n")[0][:500]
            for n, k in enumerate(own):
                items[k].status = status if not (status == "Failed" and n) else "Skipped"
            items[own[0]].error, items[own[0]].milliseconds = error, round((clock() - began) * 1000)

        with ThreadPoolExecutor(self.workers) as pool:
            list(pool.map(run, work))
        if errors:
            raise errors[0]


def publish(plan: Plan, store: Store, whole: bool = False, lossy: bool = False, workers: int = 4, clock: Callable[[], float] = time.monotonic) -> Report:
    """Carries a plan out on the store's tables, phase by phase, and says what became of every command.

    Column commands of a table are one pass over its rows in each phase; with whole, in the plan. Keys, unique indexes, references, checks and NOT NULL are held against the
    rows. A phase is published when all of it is done; with whole, all phases are published together after the last, and nothing if one fails. A phase that fails loses what
    it staged, and with on_error STOP ends the run; its commands that were done are RolledBack. Phases that this very plan has published before are Done and not repeated.
    Up to workers tables are worked on at a time. Commands of one phase come to the driver, rows never do.
    """
    options = plan.options
    policy.validated(plan.commands, options.policy)
    run, report, known = _Run(plan, store, lossy, workers), Report(options.dialect, True), digest(plan)
    finished = list(run.live.phases) if run.live.plan == known else []
    stopped = False
    shown = ("phase", "op", "table_key", "object_key", "table_name", "name", "label", "sql", "attrs")
    rows = plan.commands.orderBy(*Plan.ORDER).select(*shown).toLocalIterator()
    parts = groupby(rows, lambda r: r.phase)
    if whole:  # what later phases do to columns is done with the first, so that each table is written once
        parts = _fused(parts)
    for phase, commands in parts:
        commands = list(commands)
        items = [Item(c.phase, c.label, c.sql) for c in commands]
        report.items += items
        if phase in finished or stopped:
            for item in items:
                item.status = "Skipped" if stopped else "Done"
            continue
        before, staged = dict(run.now), len(run.staged)
        try:
            run.phase(commands, items, clock)
            finished.append(phase)
            if not whole and any(item.status == "Succeeded" for item in items):  # a phase of checks changes no table, but it is done
                run.live = store.published(Manifest(run.live.version + 1, dict(run.now), known, tuple(finished)))
        except Exception as error:
            finished = [x for x in finished if x != phase]
            report.rolled_back, stopped = True, whole or options.on_error == STOP
            store.discard(run.staged[staged:])
            run.now, run.staged = before, run.staged[:staged]
            for item in items:
                item.status = {"Succeeded": "RolledBack", "Pending": "Skipped"}.get(item.status, item.status)
            if isinstance(error, Conflict):
                raise
    if whole:
        try:
            if stopped:
                raise RowsRefused("nothing is published")
            if run.now != run.live.tables:
                store.published(Manifest(run.live.version + 1, run.now, known, tuple(finished)))
        except Exception as error:
            store.discard(run.staged)
            for item in report.items:
                item.status = "RolledBack" if item.status == "Succeeded" else item.status
            if not isinstance(error, RowsRefused):
                raise
    if options.raise_on_error and report.rolled_back:
        raise ExecutionFailed(report)
    return report


def _fused(parts: Iterable[tuple[str, Iterable[Row]]]) -> Iterable[tuple[str, list[Row]]]:
    """Phases with all column commands moved to the last phase that has any."""
    held = [(phase, list(commands)) for phase, commands in parts]
    places = [k for k, (_, commands) in enumerate(held) if any(c.op in STEPS for c in commands)]
    for k in places[:-1]:
        moved = [c for c in held[k][1] if c.op in STEPS]
        held[k] = (held[k][0], [c for c in held[k][1] if c.op not in STEPS])
        held[places[-1]] = (held[places[-1]][0], moved + held[places[-1]][1])
    return held
