"""Dialects and sources that users add, catalogs of one moment, runs that are taken up again, cycles in few rounds, associations on rows."""

import random
import sqlite3

import pytest

from schemaloom import dialects as D
from schemaloom.operators import sequence
from schemaloom.plans.compare import compare
from schemaloom.plans.execute import ConnectionTarget, ExecutionFailed, execute, execute_in_task
from schemaloom.plans.journal import Journal, digest
from schemaloom.plans.options import CompareOptions
from schemaloom.plans.script import script
from schemaloom.relations import Catalog, from_rows
from schemaloom.sources import declared as m
from schemaloom.sources import one_cut, system_tables

from .test_catalog import INT, catalog, one, pk, text


def quiet(spark):
    return catalog(spark, one("A", INT, text("NAME", 9, default_value="it's {name}"), **pk("A", "PK_A", "ID")), one("B", INT), {"views": [{"name": "V", "script": "SELECT '{table}' AS x"}]})


def test_a_user_s_dialect_renders_a_whole_plan(spark):
    D.register(D.Dialect("Plain", frozenset({"views"}), {"CreateColumn": "ADD {name} AS {type}{default_clause}", "CreateView": "VIEW {name}: {script}", "EnableTriggers Off": "PAUSE", "EnableTriggers On": "GO"}, {"ftString": "TXT(%l)"}, True, ("|", "|")))
    plan = compare(quiet(spark), Catalog(spark), CompareOptions("Plain", schema="s"))
    rows = {(r.op, r.name): r.sql for r in plan.commands.collect()}
    assert rows["CreateView", "V"] == "VIEW V: SELECT '{table}' AS x" and rows["EnableTriggers", "Off"] == "PAUSE" and rows["EnableForeignKeys", "On"] == ""
    assert rows["CreateTable", "A"].startswith("CREATE TABLE |s|.|A| (\n  ID INTEGER") and "DEFAULT 'it''s {name}'" in rows["CreateTable", "A"]
    before = quiet(spark)
    added = compare(before, before.replaced(columns=before.columns.filter("column_name <> 'NAME'")), CompareOptions("Plain"))
    assert [r.sql for r in added.commands.filter("op = 'CreateColumn'").collect()] == ["ADD NAME AS VARCHAR(9) DEFAULT 'it''s {name}'"]
    assert "Dialect: Plain" in script(plan) and "Transactional DDL: True" in script(plan)
    D.register(D.Dialect("Plain", frozenset()))
    assert "Plain" not in D.TRANSACTIONAL and D.features("Plain") == frozenset()
    for bad in (D.Dialect(D.MYSQL, frozenset()), D.Dialect("X", frozenset({"nothing"})), D.Dialect("X", frozenset(), {"Nothing": ""}), D.Dialect("X", frozenset(), {}, {"ftNothing": ""})):
        with pytest.raises(D.UnsupportedDialect):
            D.register(bad)


_LISTED = {
    "tables": "select name as table_name, '' as description from t", "columns": "select t as table_name, name as column_name, at as position, kind as native_type, 0 as size, 0 as precision, 0 as scale, 0 as not_null, 0 as auto_increment, '' as default_value, '' as charset, '' as description from c",
    "primary_keys": "select t as table_name, 'PK' as pk_name, name as column_name, 1 as position from c where at = 0", "foreign_keys": "select '' as table_name, '' as name, '' as column_name, 0 as position, '' as parent_table, '' as parent_column, '' as on_update, '' as on_delete where 0",
    "indexes": "select '' as table_name, '' as name, 0 as is_unique, '' as column_name, 0 as position where 0",
}


class Meddled:
    """A connection after each of whose queries another one adds a table."""

    def __init__(self, path):
        self.path, self.own = path, sqlite3.connect(path, isolation_level=None)
        self.description, self.rows = None, []

    def cursor(self):
        return self

    def execute(self, sql):
        found = self.own.execute(sql)
        self.description, self.rows = found.description, found.fetchall()
        with sqlite3.connect(self.path) as other:
            n = other.execute("select count(*) from t").fetchone()[0]
            other.execute("insert into t values (?)", (f"t{n}",)), other.execute("insert into c values (?, 'id', 0, 'int')", (f"t{n}",))
        other.close()

    def __iter__(self):
        return iter(self.rows)

    def close(self):
        self.own.close()


def test_values_that_a_command_does_not_need_are_not_made(spark):
    """A position that is no number matters to the command that moves the column alone."""
    from schemaloom.functions.render import rendered

    rows = spark.createDataFrame([("DropView", "V", {"position": "none"}), ("AlterColumnPosition", "C", {"position": "4"})], "op string, name string, attrs map<string,string>")
    rows = rows.selectExpr("*", "'' as schema", "'T' as table_name", "map('sql', '', 'new_name', '') as extra").coalesce(1)
    assert {(r.sql, r.label) for r in rendered(rows, D.FIREBIRD).collect()} == {("DROP VIEW V;", "Drop View: V"), ("ALTER TABLE T ALTER COLUMN C POSITION 5;", "Alter Column Position: C")}


def test_a_registered_source_is_read_as_of_one_moment(spark, tmp_path):
    D.register(D.Dialect("Listed", frozenset()))
    system_tables.register_source("Listed", _LISTED, {"int": "ftInteger"})
    path = str(tmp_path / "listed.db")
    with sqlite3.connect(path) as db:
        db.executescript("pragma journal_mode = wal; create table t(name); create table c(t, name, at, kind); insert into t values ('t0'); insert into c values ('t0', 'id', 0, 'int')")
    db.close()
    one_moment = one_cut.cut_catalog(spark, "tests.test_runs:Meddled", [path], "Listed", begin="begin")
    tables = sorted(r.table_key for r in one_moment.tables.collect())
    assert tables == sorted(r.table_key for r in one_moment.columns.collect()) == sorted(r.table_key for r in one_moment.primary_keys.collect()) and len(tables) <= 2
    with sqlite3.connect(path) as db:
        assert db.execute("select count(*) from t").fetchone()[0] >= 6  # it went on all the while
    db.close()
    reader = lambda sql: spark.createDataFrame(sqlite3.connect(path).execute(sql).fetchall() or [], ", ".join(f"{x.split(' as ')[-1].split()[-1]} string" for x in sql.removeprefix("select ").partition(" from ")[0].partition(" where ")[0].split(", ")))
    whole = system_tables.database_catalog(spark, reader, "Listed")
    assert whole.tables.count() >= 6 and whole.columns.first().field_type == "ftInteger"
    for queries, types in (({"tables": ""}, {}), ({**_LISTED, "nothing": ""}, {}), (_LISTED, {"x": "ftNothing"})):
        with pytest.raises(D.UnsupportedDialect):
            system_tables.register_source("Listed", queries, types)
    with pytest.raises(D.UnsupportedDialect):
        system_tables.register_source(D.ORACLE, _LISTED, {})


def test_a_run_is_taken_up_where_it_stopped(spark, tmp_path):
    desired = catalog(spark, one("A", INT), one("B", INT), {"views": [{"name": f"V{k}", "script": f"SELECT {k} AS x"} for k in range(4)]})
    plan = compare(desired, Catalog(spark), CompareOptions(D.SQLITE))
    connection = sqlite3.connect(str(tmp_path / "j.db"), isolation_level=None)
    connection.execute("create table V2(a)")
    journal = Journal(connection)
    with pytest.raises(ExecutionFailed) as failed:
        execute(plan, ConnectionTarget(connection), journal=journal)
    assert failed.value.report.counts()["Failed"] == 1 and len(journal.done(digest(plan))) == 2  # tables; the phase of the views was undone with its entries
    connection.execute("drop table V2")
    report = execute(compare(desired, Catalog(spark), CompareOptions(D.SQLITE)), ConnectionTarget(connection), journal=journal)
    assert {x.label: x.status for x in report.items if "Enable" not in x.label} == {"Create Table: A": "Done", "Create Table: B": "Done", **{f"Create View: V{k}": "Succeeded" for k in range(4)}}
    assert [x.status for x in report.items if x.label == "Enable ForeignKeys: Off"] == ["Succeeded"] and len(journal.done(digest(plan))) == 6
    again = execute(plan, ConnectionTarget(connection), journal=journal)
    assert "Succeeded" not in {x.status for x in again.items if "Enable" not in x.label}
    other = compare(desired.replaced(views=desired.views.filter("name = 'V1'")), desired, CompareOptions(D.SQLITE))
    assert execute(other, ConnectionTarget(connection), journal=journal).counts()["Done"] == 0
    connection.close()


def test_a_journal_without_transactions_keeps_every_command(spark, tmp_path):
    plan = compare(from_rows(spark, views=[{"name": f"V{k}", "script": f"SELECT {k} AS x"} for k in range(4)]), Catalog(spark), CompareOptions(D.MYSQL, raise_on_error=False))
    connection = sqlite3.connect(str(tmp_path / "m.db"), isolation_level=None)
    connection.execute("create table V2(a)")
    ran = []

    class Target(ConnectionTarget):
        def execute(self, sql):
            if not sql.startswith("SET"):
                ran.append(sql)
                super().execute(sql)

    journal = Journal(connection)
    execute(plan, Target(connection), journal=journal)
    assert len(journal.done(digest(plan))) == 2 and len(ran) == 3
    connection.execute("drop table V2")
    execute(plan, Target(connection), journal=journal)
    assert len(ran) == 5 and len(journal.done(digest(plan))) == 4
    connection.close()


def plain_cycles(edges):
    edges = {(a, b) for a, b in edges if a != b}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    reach = {}
    for a in near:
        seen, todo = set(), [a]
        while todo:
            for b in near.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    return {(a, min(x for x in reach[a] if a in reach.get(x, ()))) for a in reach if a in reach[a]}


@pytest.mark.parametrize("seed", range(4))
def test_cycles_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    edges, at = [], 0
    for _ in range(6):  # rings, tails, rings that share a table or are joined by chains, loops through one table, and noise
        n = draw.randint(2, 7)
        own = [f"n{at + k:03}" for k in draw.sample(range(n), n)]
        edges += list(zip(own, own[1:] + own[:1])) if draw.random() < 0.7 else list(zip(own, own[1:]))
        at += n
    names = [f"n{k:03}" for k in range(at)]
    edges += [tuple(draw.choices(names, k=2)) for _ in range(draw.choice([0, 2, 6, 15]))]
    found = sequence.cycles(spark.createDataFrame(edges, "child string, parent string"))
    assert {tuple(r) for r in found.collect()} == plain_cycles(edges)


def test_a_ring_of_10000_takes_few_rounds(spark, monkeypatch):
    rounds = []
    kept = sequence.written
    monkeypatch.setattr(sequence, "written", lambda rows: rounds.append(1) or kept(rows))
    ring = spark.range(10_000).selectExpr("concat('t', id) as child", "concat('t', (id + 1) % 10000) as parent").union(spark.createDataFrame([("t5", "u1"), ("u1", "u2"), ("u2", "t9"), ("t7", "w"), ("x", "t3")], "child string, parent string"))
    found = sequence.cycles(ring)
    assert found.count() == 10_002 and found.select("cycle").distinct().count() == 1 and len(rounds) < 40, len(rounds)


def test_a_ring_with_branches_everywhere_takes_few_rounds(spark, monkeypatch):
    """Every table refers to the next two, so there are no chains to contract; two such rings, one that refers to the other."""
    rounds = []
    kept = sequence.written
    monkeypatch.setattr(sequence, "written", lambda rows: rounds.append(1) or kept(rows))
    names = [f"n{k:03}" for k in random.Random(1).sample(range(240), 240)]
    edges = [(ring[k], ring[(k + far) % 120]) for ring in (names[:120], names[120:]) for k in range(120) for far in (1, 2)] + [(names[0], names[120])]
    found = sequence.cycles(spark.createDataFrame(edges, "child string, parent string"))
    assert {tuple(r) for r in found.collect()} == plain_cycles(edges)
    assert len(rounds) < 40


@m.table("own")
class Own:
    id = m.column("id", "ftInteger")
    one = m.association("OneToOne", "id", "other", "ref")
    many = m.association("OneToMany", "id", "other", "ref")
    up = m.association("ManyToOne", "id; kind", "other", "ref; kind")
    free = m.association("ManyToMany", "id", "other", "ref")


def test_associations_on_rows(spark):
    own = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (None, "a"), (None, "a"), (4, "a")], "id int, kind string")
    other = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "a"), (3, "a"), (None, "a"), (None, "a")], "ref int, kind string")
    found = {tuple(r) for r in m.association_violations([m.read_model(Own)], {"own": own, "other": other}).collect()}
    assert found == {("own.one", '["1"]', 1, 2), ("own.one", '["2"]', 2, 1), ("own.many", '["2"]', 2, 1), ("own.up", '["1","a"]', 1, 2)}
    assert m.association_violations([m.read_model(Own)], {"own": own.limit(0), "other": other}).count() == 0


def test_associations_without_bounds_are_not_counted(spark):
    lines = spark.createDataFrame([(1, 2), (1, 3)], "id int, part int")
    model = m.read_model(m.table("own")(type("Free", (), {"id": m.column("id", "ftInteger"), "free": m.association("ManyToMany", "id", "other", "ref")})))
    assert m.association_violations([model], {"own": lines}).count() == 0  # other is not even read
    found = m.association_violations([m.read_model(Own)], {"own": lines.selectExpr("id", "'a' as kind"), "other": lines.selectExpr("id as ref", "'a' as kind")})
    assert "to_json" not in found._jdf.queryExecution().optimizedPlan().toString().partition("Aggregate")[2] and found.count() > 0


class Refusing:
    """A target that a task opens: it takes all but one view."""

    connected, in_transaction = True, False

    def start(self):
        self.in_transaction = True

    def commit(self):
        self.in_transaction = False

    rollback = commit

    def execute(self, sql):
        if sql.startswith("CREATE VIEW V2"):
            raise RuntimeError("refused")


def test_a_plan_runs_in_a_task(spark, monkeypatch):
    """The same happens to every command as on a target of the driver, and no statement comes there."""
    desired = catalog(spark, one("A", INT), one("B", INT), {"views": [{"name": f"V{k}", "script": f"SELECT {k} AS x"} for k in range(4)]})
    plan = compare(desired, Catalog(spark), CompareOptions(D.SQLITE, raise_on_error=False))
    told = execute(plan, Refusing())
    with monkeypatch.context() as patch:
        patch.setattr(type(plan.commands), "toLocalIterator", lambda *_, **__: pytest.fail("statements came to the driver"))
        rows = execute_in_task(plan, Refusing).collect()
    assert [(r.phase, r.label, r.status, r.error) for r in rows if r.ended is None] == [(x.phase, x.label, x.status, x.error) for x in told.items]
    assert [(r.phase, r.ended) for r in rows if r.ended] == told.ended and dict(told.ended)["Views"] == "rollback" and dict(told.ended)["CreateTables"] == "commit"
    with pytest.raises(ExecutionFailed, match="refused"):
        execute_in_task(compare(desired, Catalog(spark), CompareOptions(D.SQLITE)), Refusing)
