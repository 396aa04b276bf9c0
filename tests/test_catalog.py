"""Comparison, gating, expansion, ordering and rendering on small catalogs."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from schemaloom import dialects as D
from schemaloom.functions import normalize
from schemaloom.functions.keys import InvalidSchemaName, ascii_upper, position_key, routine_key, valid_schema_name
from schemaloom.operators import introspect, policy, sequence
from schemaloom.plans.compare import compare
from schemaloom.plans.execute import ConnectionTarget, ExecutionFailed, ExecutionRefused, execute, migrated_table, statements
from schemaloom.plans.options import ADDITIVE, CONTINUE, REBUILD, CompareOptions, InvalidOption
from schemaloom.plans.script import script
from schemaloom.relations import Catalog, DuplicateObject, from_rows, read_catalog


def col(table, position, name, type_name="VARCHAR(%l)", size=0, field_type=None, **more):
    kind = field_type or ("ftString" if "CHAR" in type_name else "ftInteger")
    return {"table": table, "position": position, "column_name": name, "type_name": type_name, "size": size, "field_type": kind, **more}


def key(table, *columns, kind="pk", name=""):
    return [{"table": table, "key_kind": kind, "object": name, "position": k, "column_name": c} for k, c in enumerate(columns)]


def plan_of(desired, current, **options):
    found = compare(desired, current, CompareOptions(**options))
    rows = [r for r in found.ordered().collect() if r.op not in ("EnableForeignKeys", "EnableTriggers")]
    return found, rows, sorted(r.audit for r in found.audit.collect())


def flat(text):
    return re.sub(r"\s+", " ", text).strip()


def one(table, *columns, **more):
    """Rows of one table: columns, and members of its keys."""
    return {"tables": [{"table_name": table, "description": more.pop("description", "")}], "columns": [col(table, k, *c) if isinstance(c, tuple) else {**col(table, k, c["name"]), **{x: v for x, v in c.items() if x != "name"}} for k, c in enumerate(columns)], **more}


def catalog(spark, *parts):
    rows = {}
    for part in parts:
        for relation, own in part.items():
            rows.setdefault(relation, []).extend(own)
    return from_rows(spark, **rows)


INT = ("ID", "INTEGER")


def text(name, size, **more):
    return {"name": name, "size": size, **more}


def pk(table, name, *columns):
    return {"primary_keys": [{"table": table, "pk_name": name}], "key_columns": key(table, *columns)}


def unique_index(unique):
    return {"indexes": [{"table": "PEDIDO", "name": "IDX_PEDIDO", "is_unique": unique}], "key_columns": key("PEDIDO", "ID", kind="index", name="IDX_PEDIDO")}


def seq(name, first, step):
    return {"sequences": [{"name": name, "initial_value": first, "increment": step}]}


@pytest.fixture(scope="module")
def pair(spark):
    """Two catalogs with a case of every kind of difference."""
    desired = catalog(
        spark, one("CLIENTE", INT, text("NOME", 60, not_null=True), text("EMAIL", 100), **pk("CLIENTE", "PK_CLIENTE", "ID")),
        one("PEDIDO", INT, **unique_index(True)), one("RENAMED", INT, **pk("RENAMED", "PK_NEW", "ID")), one("WIDER", INT, ("B", "INTEGER"), **pk("WIDER", "PK_W", "ID")), one("UNKEYED", INT),
        one("NARROW", text("NOME", 30)), one("FILLED", text("FLAG", 1, not_null=True, default_value="S")), one("RISKY", text("FLAG", 1, not_null=True)), one("DEFAULTS", text("A", 9, default_value="SEM APELIDO")),
        seq("STEPPED", 1, 2), seq("UNKNOWN_STEP", 1, 1), seq("MOVED", 100, 1),
        {"views": [{"name": "SAME_VIEW", "script": "SELECT *\n  FROM   T"}, {"name": "VW", "script": "SELECT 1"}, {"name": "UNSCRIPTED", "script": ""}]},
        one("CHECKED", INT, checks=[{"table": "CHECKED", "name": "SAME", "condition": "((AGE > 18))"}, {"table": "CHECKED", "name": "CK", "condition": "AGE > 21"}]),
        {"domains": [{"name": "D_NEW", "type_name": "VARCHAR(60)"}, {"name": "D_COD", "type_name": "VARCHAR(60)"}], "procedures": [{"name": "SP_X", "script": "CREATE PROCEDURE SP_X AS 1"}]},
        one("TRIGGERED", INT, triggers=[{"table": "TRIGGERED", "name": "TRG", "script": "begin A end"}, {"table": "TRIGGERED", "name": "SAME_TRG", "script": "BEGIN\n  B END"}]),
        one("SAID", {**text("A", 1), "description": "x"}, text("B", 1), description="x"),
    )
    current = catalog(
        spark, one("CLIENTE", INT, text("NOME", 30, not_null=True), text("OBSOLETO", 10)),
        one("PEDIDO", INT, **unique_index(False)), one("RENAMED", INT, **pk("RENAMED", "PK_OLD", "ID")), one("WIDER", INT, ("B", "INTEGER"), **pk("WIDER", "PK_W", "ID", "B")), one("UNKEYED", INT, **pk("UNKEYED", "PK_U", "ID")),
        one("NARROW", text("NOME", 60)), one("FILLED", text("FLAG", 1, default_value="S")), one("RISKY", text("FLAG", 1)), one("DEFAULTS", text("A", 9)),
        seq("STEPPED", 1, 1), seq("UNKNOWN_STEP", 0, 0), seq("MOVED", 5, 1),
        {"views": [{"name": "SAME_VIEW", "script": "select * from t"}, {"name": "VW", "script": "SELECT 2"}, {"name": "UNSCRIPTED", "script": "SELECT 3"}, {"name": "ORPHAN", "script": "SELECT 4"}]},
        one("CHECKED", INT, checks=[{"table": "CHECKED", "name": "SAME", "condition": "AGE > 18"}, {"table": "CHECKED", "name": "CK", "condition": "AGE > 18"}]),
        {"domains": [{"name": "D_COD", "type_name": "VARCHAR(30)"}, {"name": "D_OLD", "type_name": "INTEGER"}], "procedures": [{"name": "SP_X", "script": "CREATE PROCEDURE SP_X AS 2"}]},
        one("TRIGGERED", INT, triggers=[{"table": "TRIGGERED", "name": "TRG", "script": "begin B end"}, {"table": "TRIGGERED", "name": "SAME_TRG", "script": "begin b end"}]),
        one("SAID", {**text("B", 1)}, {**text("A", 1)}),
    )
    return desired, current


def by_object(rows):
    found = {}
    for r in rows:
        found.setdefault(r.table_name or r.name, []).append(r)
    return found


def test_full_policy_emits_every_difference(pair):
    _, rows, audit = plan_of(*pair, dialect=D.FIREBIRD)
    found = by_object(rows)
    assert [(r.phase, r.label) for r in found["CLIENTE"]] == [("DropColumns", "Drop Column: OBSOLETO"), ("Columns", "Alter Column: NOME"), ("Columns", "Create Column: EMAIL"), ("PrimaryKeys", "Create PrimaryKey: PK_CLIENTE")]
    assert [flat(r.sql) for r in found["CLIENTE"]] == [
        "ALTER TABLE CLIENTE DROP OBSOLETO;", "ALTER TABLE CLIENTE ALTER COLUMN NOME TYPE VARCHAR(60) NOT NULL;", "ALTER TABLE CLIENTE ADD EMAIL VARCHAR(100);",
        "ALTER TABLE CLIENTE ADD CONSTRAINT PK_CLIENTE PRIMARY KEY (ID);",
    ]
    ops = {k: [r.op for r in v] for k, v in found.items()}
    assert ops["PEDIDO"] == ["DropIndexe", "CreateIndexe"] and flat(found["PEDIDO"][1].sql) == "CREATE UNIQUE INDEX IDX_PEDIDO ON PEDIDO (ID);"
    assert [flat(r.sql) for r in found["RENAMED"]] == ["ALTER TABLE RENAMED DROP CONSTRAINT PK_OLD;", "ALTER TABLE RENAMED ADD CONSTRAINT PK_NEW PRIMARY KEY (ID);"]
    assert "WIDER" not in ops and ops["UNKEYED"] == ["DropPrimaryKey"] and ops["DEFAULTS"] == ["AlterColumn", "AlterDefaultValue"] and found["DEFAULTS"][1].sql.endswith("SET DEFAULT 'SEM APELIDO';")
    assert ops["STEPPED"] == ["AlterSequence"] and "UNKNOWN_STEP" not in ops and "MOVED" not in ops and "SAME_VIEW" not in ops
    assert ops["VW"] == ["DropView", "CreateView"] and ops["ORPHAN"] == ["DropView"] and ops["CHECKED"] == ["AlterCheck"] and ops["TRIGGERED"] == ["DropTrigger", "CreateTrigger"] and ops["SP_X"] == ["DropProcedure", "CreateProcedure"]
    assert found["D_NEW"][0].sql == "CREATE DOMAIN D_NEW AS VARCHAR(60);" and ops["D_OLD"] == ["DropDomain"] and "D_COD" not in ops and "SAID" not in ops
    assert len(audit) == 1 and audit[0].startswith("DIAGNOSTIC: DOMAIN D_COD")
    phases = [sequence.PHASES.index(r.phase) for r in rows]
    assert phases == sorted(phases)


def test_additive_policy_holds_back_the_rest(pair):
    _, rows, audit = plan_of(*pair, dialect=D.FIREBIRD, policy=ADDITIVE)
    assert [r.op for r in rows] == ["CreateColumn", "CreatePrimaryKey"]
    for line in ("ALTER COLUMN CLIENTE.NOME", "DROP COLUMN CLIENTE.OBSOLETO", "RECREATE INDEXE PEDIDO.IDX_PEDIDO", "RECREATE PRIMARYKEY RENAMED.PK_OLD", "RECREATE PROCEDURE SP_X", "RECREATE VIEW VW", "ALTER SEQUENCE STEPPED", "CREATE DOMAIN D_NEW"):
        assert f"{line} suppressed by policy" in audit


def test_options_widen_the_comparison(pair):
    _, rows, _ = plan_of(*pair, dialect=D.FIREBIRD, strict_keys=True, compare_initial_values=True, compare_descriptions=True, compare_positions=True)
    found = by_object(rows)
    assert [r.op for r in found["WIDER"]] == ["DropPrimaryKey", "CreatePrimaryKey"] and [r.op for r in found["MOVED"]] == ["AlterSequence"]
    said = {r.sql for r in rows if "SAID" in r.sql}
    assert said == {"COMMENT ON TABLE SAID IS 'x';", "COMMENT ON COLUMN SAID.A IS 'x';", "ALTER TABLE SAID ALTER COLUMN A POSITION 1;", "ALTER TABLE SAID ALTER COLUMN B POSITION 2;"}


def test_models_drop_no_objects_that_they_can_not_hold(pair):
    _, rows, _ = plan_of(*pair, dialect=D.FIREBIRD, model_mode=True)
    found = {k: [r.op for r in v] for k, v in by_object(rows).items()}
    assert not found.keys() & {"ORPHAN", "UNSCRIPTED", "SP_X", "D_OLD"} and found["VW"] == ["DropView", "CreateView"]


def test_equal_catalogs_give_guards_alone(pair):
    for dialect in (D.FIREBIRD, D.ORACLE):
        found = compare(pair[0], pair[0], CompareOptions(dialect))
        assert [(r.op, r.phase, r.name) for r in found.ordered().collect()] == [("EnableForeignKeys", "Pre", "Off"), ("EnableTriggers", "Pre", "Off"), ("EnableForeignKeys", "Post", "On"), ("EnableTriggers", "Post", "On")]


REBUILT = {
    D.FIREBIRD: ["ALTER TABLE NARROW ADD NOME_MDBTMP VARCHAR(30);", "UPDATE NARROW SET NOME_MDBTMP = CAST(NOME AS VARCHAR(30));", "ALTER TABLE NARROW DROP NOME;", "ALTER TABLE NARROW ALTER COLUMN NOME_MDBTMP TO NOME;"],
    D.MYSQL: ["ALTER TABLE NARROW ADD NOME_MDBTMP VARCHAR(30);", "UPDATE NARROW SET NOME_MDBTMP = CAST(NOME AS CHAR(30));", "ALTER TABLE NARROW DROP COLUMN NOME;", "ALTER TABLE NARROW RENAME COLUMN NOME_MDBTMP TO NOME;"],
    D.MSSQL: ["ALTER TABLE NARROW ADD NOME_MDBTMP VARCHAR(30);", "UPDATE NARROW SET NOME_MDBTMP = CAST(NOME AS VARCHAR(30));", "ALTER TABLE NARROW DROP COLUMN NOME;", "EXEC sp_rename 'NARROW.NOME_MDBTMP', 'NOME', 'COLUMN';"],
}


@pytest.mark.parametrize("dialect", REBUILT)
def test_unsafe_changes_are_rebuilt(pair, dialect):
    _, rows, _ = plan_of(*pair, dialect=dialect, strategy=REBUILD)
    found = by_object(rows)
    assert [r.sql for r in found["NARROW"]] == REBUILT[dialect]
    assert [r.op for r in found["FILLED"]] == ["BackfillColumnData", "AlterColumn"] and found["FILLED"][0].sql == "UPDATE FILLED SET FLAG = 'S' WHERE FLAG IS NULL;"
    assert [r.op for r in found["RISKY"]] == ["AlterColumn"] and found["RISKY"][0].notes[0].startswith("RISK")
    assert [r.op for r in found["CLIENTE"]][:2] == ["DropColumn", "AlterColumn"]


def test_rebuilds_need_permission_and_a_dialect(pair):
    _, rows, audit = plan_of(*pair, dialect=D.FIREBIRD, strategy=REBUILD, policy=CompareOptions().policy - {"RebuildColumn"})
    assert [r.op for r in by_object(rows)["FILLED"]] == ["AlterColumn"] and "REBUILD COLUMN FILLED.FLAG suppressed by policy (kept in-place ALTER)" in audit
    _, rows, _ = plan_of(*pair, dialect=D.SQLITE, strategy=REBUILD)
    assert [r.op for r in by_object(rows)["NARROW"]] == ["AlterColumn"] and "STEPPED" not in by_object(rows)


def test_new_tables_come_in_order_of_their_keys(spark):
    columns = [col("TAB_A", 0, "ID", "INTEGER", not_null=True), col("TAB_A", 1, "B_ID", "INTEGER"), col("TAB_B", 0, "ID", "INTEGER", not_null=True)]
    desired = from_rows(
        spark, tables=[{"table_name": "TAB_A"}, {"table_name": "TAB_B"}], columns=columns, primary_keys=[{"table": t, "pk_name": f"PK_{t}"} for t in ("TAB_A", "TAB_B")],
        key_columns=key("TAB_A", "ID") + key("TAB_B", "ID") + key("TAB_A", "B_ID", kind="fk_from", name="FK_AB") + key("TAB_A", "ID", kind="fk_to", name="FK_AB"),
        foreign_keys=[{"table": "TAB_A", "name": "FK_AB", "parent_table": "tab_b", "on_delete": "Cascade", "on_update": "SetNull"}], checks=[{"table": "TAB_A", "name": c, "condition": "ID > 0"} for c in ("C1", "C2")],
    )
    empty = Catalog(spark)
    _, rows, _ = plan_of(desired, empty, dialect=D.FIREBIRD)
    assert [r.label for r in rows] == ["Create Table: TAB_B", "Create Table: TAB_A", "Create ForeignKey: FK_AB"]
    assert flat(rows[1].sql) == "CREATE TABLE TAB_A ( ID INTEGER NOT NULL, B_ID INTEGER, CONSTRAINT PK_TAB_A PRIMARY KEY (ID), CONSTRAINT C1 CHECK (ID > 0), CONSTRAINT C2 CHECK (ID > 0) );"
    assert flat(rows[2].sql) == "ALTER TABLE TAB_A ADD CONSTRAINT FK_AB FOREIGN KEY (B_ID) REFERENCES tab_b(ID) ON DELETE CASCADE ON UPDATE SET NULL;"
    assert [r.label for r in plan_of(desired, empty, dialect=D.FIREBIRD, sequenced=False)[1]] == ["Create Table: TAB_A", "Create Table: TAB_B", "Create ForeignKey: FK_AB"]
    _, rows, _ = plan_of(empty, desired, dialect=D.FIREBIRD)
    assert [r.label for r in rows] == ["Drop Table: TAB_A", "Drop Table: TAB_B"]
    sqlite_rows = plan_of(desired, empty, dialect=D.SQLITE)[1]
    assert [r.op for r in sqlite_rows] == ["CreateTable", "CreateTable"] and "FOREIGN KEY" in sqlite_rows[1].sql
    assert plan_of(desired, empty, dialect=D.POSTGRESQL, schema="vendas")[1][0].sql.startswith('CREATE TABLE "vendas"."TAB_B" (')


def test_order_of_tables():
    order = sequence.table_order
    assert order(["C", "A", "B"], {("B", "A"), ("C", "B")}) == ["A", "B", "C"]
    assert order(["C", "A", "B"], {("A", "B")}) == ["B", "A", "C"]
    assert order(["A", "B", "C"], {("B", "A"), ("C", "B")}, inverse=True) == ["C", "B", "A"]
    assert order(["A", "B", "D"], {("A", "B"), ("B", "A"), ("A", "A")}) == ["D", "A", "B"]


def test_cycles(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("A", "E"), ("X", "Y"), ("Y", "X"), ("C", "X")], "child string, parent string")
    assert {(r.name, r.cycle) for r in sequence.cycles(edges).collect()} == {("A", "A"), ("B", "A"), ("C", "A"), ("X", "X"), ("Y", "X")}
    assert sequence.cycles(edges.limit(0)).count() == 0


def test_canonical_texts(spark):
    one = lambda c, **given: spark.createDataFrame([tuple(given.values())], list(given)).select(c).first()[0]
    check = lambda s: one(normalize.check_condition(F.col("s")), s=s)
    assert check("CHECK ((AGE > 18))") == check(" ( (AGE > 18 ) )") == "AGE > 18"
    assert check("CHECK ((A) OR (B))") == "(A) OR (B)"
    assert check("((A) OR (B)") == "((A) OR (B)" and check("") == "" and check("(())") == "" and check("((A)") == "((A)"
    script = lambda s: one(normalize.script(F.col("s")), s=s)
    assert script("  SELECT   A,\n  B\tFROM T  ") == "SELECT A, B FROM T"
    assert script("SELECT   'a   b'  ,   c") == "SELECT 'a   b' , c" and script("x 'open  ") == "x 'open  "
    assert one(normalize.joined_checks(F.col("s"), "CHK"), s="CHECK ((VALUE > 0))CHK((VALUE < 100))CHK ") == "(VALUE > 0) AND (VALUE < 100)"
    assert one(normalize.default_value(F.col("s")), s=" default = 0") == "= 0" and one(normalize.default_value(F.col("s")), s="DEFAULT 0") == "0"
    assert one(normalize.view_body(F.col("s")), s="CREATE VIEW [dbo].[VW_X] AS SELECT 1") == "SELECT 1" and one(normalize.view_body(F.col("s")), s="SELECT 2") == "SELECT 2"
    assert one(ascii_upper("s"), s="aé") == "Aé" and one(position_key("n"), n=3) == "000003"
    assert one(routine_key(F.col("n"), F.col("s")), n="f", s="int") == "F(INT)"


def test_names_and_options():
    for name in ("", "vendas", "_stg2"):
        assert valid_schema_name(name) == name
    for name in ("x; DROP", 'ven"das', "1schema", "ven.das", "a" * 129, "vendas\n"):
        with pytest.raises(InvalidSchemaName):
            valid_schema_name(name)
    for bad in ({"policy": frozenset({"Nothing"})}, {"strategy": "?"}, {"on_error": "?"}):
        with pytest.raises(InvalidOption):
            CompareOptions(**bad)
    with pytest.raises(D.UnsupportedDialect):
        CompareOptions("Nothing")


def test_defaults_are_quoted(spark):
    cases = [("ftString", "'X'", "'X'"), ("ftDateTime", "current_timestamp", "current_timestamp"), ("ftString", "O'Brien", "'O''Brien'"), ("ftInteger", "0", "0"), ("ftString", "'", "''''")]
    desired = from_rows(spark, tables=[{"table_name": "T"}], columns=[col("T", k, f"A{k}", size=9, field_type=kind, default_value=given) for k, (kind, given, _) in enumerate(cases)])
    rows = plan_of(desired, from_rows(spark, tables=[{"table_name": "T"}]), dialect=D.FIREBIRD)[1]
    assert [r.sql for r in rows] == [f"ALTER TABLE T ADD A{k} VARCHAR(9) DEFAULT {wanted};" for k, (_, _, wanted) in enumerate(cases)]


def test_unknown_commands_are_denied(spark):
    rows = spark.createDataFrame([("Mystery", "x"), ("EnableTriggers", "On"), ("CreateTable", "t")], "op string, name string")
    assert [r.op for r in policy.denied(rows, CompareOptions().policy).collect()] == ["Mystery"]
    with pytest.raises(policy.PolicyViolation):
        policy.validated(rows, CompareOptions().policy)


def test_statements_are_taken_one_by_one():
    assert statements("CreateTable", "CREATE TABLE T (A TEXT DEFAULT 'x;y''z');\nCREATE INDEX I ON T (A);") == ["CREATE TABLE T (A TEXT DEFAULT 'x;y''z');", "CREATE INDEX I ON T (A);"]
    assert statements("CreateProcedure", "begin a; b; end") == ["begin a; b; end"] and statements("AlterColumn", "A;B;") == ["A;", "B;"]


class Recorder:
    connected, in_transaction = True, False

    def __init__(self, fails=()):
        self.log, self.fails = [], fails

    def start(self):
        self.log.append("START")

    def commit(self):
        self.log.append("COMMIT")

    def rollback(self):
        self.log.append("ROLLBACK")

    def execute(self, sql):
        if any(f in sql for f in self.fails):
            raise RuntimeError(f"refused {sql}")


def test_execution(spark):
    desired = from_rows(spark, tables=[{"table_name": t} for t in ("T1", "T2", "T3")], columns=[col(t, 0, "A", "INTEGER") for t in ("T1", "T2", "T3")], sequences=[{"name": "S1", "increment": 1}])
    run = lambda fails=(), **o: (t := Recorder(fails), execute(compare(desired, Catalog(spark), CompareOptions(raise_on_error=False, **o)), t))
    target, report = run(dialect=D.FIREBIRD3)
    assert target.log == ["START", "COMMIT"] * 2 and report.counts()["Succeeded"] == 4
    target, report = run(["TABLE T2"], dialect=D.FIREBIRD3)
    assert target.log == ["START", "COMMIT", "START", "ROLLBACK"] and [x.status for x in report.items if x.status != "Empty"] == ["Succeeded", "Succeeded", "Failed", "Skipped"] and report.rolled_back
    target, report = run(["GENERATOR S1"], dialect=D.FIREBIRD3, on_error=CONTINUE)
    assert target.log == ["START", "ROLLBACK", "START", "COMMIT"] and report.counts()["Succeeded"] == 3
    target, report = run(dialect=D.MYSQL)
    assert target.log == [] and not report.transactional
    plan = compare(desired, Catalog(spark), CompareOptions(D.FIREBIRD3))
    with pytest.raises(ExecutionFailed):
        execute(plan, Recorder(["T3"]))
    busy = Recorder()
    busy.in_transaction = True
    with pytest.raises(ExecutionRefused):
        execute(plan, busy)


def test_script_and_sqlite_round_trip(spark, tmp_path):
    from schemaloom.sources.sqlite import EXTRACTED, sqlite_catalog

    path = str(tmp_path / "x.db")
    connection = sqlite3.connect(path)
    connection.executescript("create table P(ID INTEGER PRIMARY KEY AUTOINCREMENT, NOME VARCHAR(60) NOT NULL DEFAULT 'x'); create table C(ID INTEGER, P_ID INTEGER REFERENCES P(ID) ON DELETE CASCADE, V DECIMAL(18,2)); create unique index IX on C(ID, P_ID); create view V as select ID from P;")
    source = sqlite_catalog(spark, path)
    assert [(r.column_name, r.size) for r in introspect.fields(source, "p").collect()] == [("ID", 0), ("NOME", 60)]
    assert [r.column_name for r in introspect.members(source, "C", "index", "IX").collect()] == ["ID", "P_ID"]
    assert introspect.foreign_keys(source, "C").first().on_delete == "Cascade" and introspect.referencing(source, "P").first().name == "FK_P_P_ID"
    with pytest.raises(introspect.UnknownTable):
        introspect.fields(source, "nothing")
    other = sqlite3.connect(str(tmp_path / "y.db"), isolation_level=None)
    plan = compare(source, Catalog(spark), CompareOptions(D.SQLITE, policy=CompareOptions().policy - {"CreateSequence"}))
    text = script(plan)
    assert text.index("PHASE: Pre") < text.index("CREATE TABLE P") < text.index("CREATE TABLE C") < text.index("PHASE: Views")
    assert execute(plan, ConnectionTarget(other)).counts()["Failed"] == 0
    again = compare(source, sqlite_catalog(spark, str(tmp_path / "y.db")), CompareOptions(D.SQLITE, extracted=EXTRACTED - {"sequences"}))
    assert [r.label for r in again.ordered().collect() if not r.op.startswith("Enable")] == []


def test_sqlite_keys_that_count_up(spark, tmp_path):
    from schemaloom.sources.sqlite import sqlite_catalog

    path, copy = str(tmp_path / "a.db"), str(tmp_path / "b.db")
    connection = sqlite3.connect(path)
    connection.executescript(
        "create table USED(ID INTEGER PRIMARY KEY AUTOINCREMENT, V TEXT); insert into USED(V) values ('x'); create table FRESH(V TEXT, ID integer primary key autoincrement); "
        "create table PLAIN(ID INTEGER PRIMARY KEY, V TEXT DEFAULT 'autoincrement' /* autoincrement */); create table TWO(A INTEGER, B INTEGER, PRIMARY KEY (A, B));"
    )
    source = sqlite_catalog(spark, path)
    assert {(r.table_key, r.column_name) for r in source.columns.filter("auto_increment").collect()} == {("USED", "ID"), ("FRESH", "ID")}
    assert {r.table_key: r.auto_increment for r in source.primary_keys.collect()} == {"USED": True, "FRESH": True, "PLAIN": False, "TWO": False}
    other = sqlite3.connect(copy, isolation_level=None)
    plan = compare(source, Catalog(spark), CompareOptions(D.SQLITE, policy=CompareOptions().policy - {"CreateSequence"}))
    assert execute(plan, ConnectionTarget(other)).counts()["Failed"] == 0
    made = {name: flat(sql) for name, sql in other.execute("select name, sql from sqlite_master where type = 'table' and name not like 'sqlite_%'")}
    assert {name for name, sql in made.items() if "AUTOINCREMENT" in sql} >= {"USED", "FRESH"} and "PRIMARY KEY AUTOINCREMENT" not in made["PLAIN"] + made["TWO"]
    assert all(sql.count("PRIMARY KEY") == 1 for sql in made.values())
    again = {(r.table_key, r.column_name) for r in sqlite_catalog(spark, copy).columns.filter("auto_increment").collect()}
    assert again == {("USED", "ID"), ("FRESH", "ID")}


def test_rows_follow_the_plan(spark):
    make = lambda size, **more: from_rows(spark, tables=[{"table_name": "T"}], columns=[col("T", 0, "ID", "INTEGER"), col("T", 1, "NOME", size=size, **more)])
    plan = compare(make(3, not_null=True, default_value="zz"), make(9, default_value="zz"), CompareOptions(strategy=REBUILD))
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "ID int, NOME string")
    assert sorted(map(tuple, migrated_table(plan, "T", rows).collect())) == [(1, "abc"), (2, "zz")]
    long = spark.createDataFrame([(1, "abcdef")], "ID int, NOME string")
    with pytest.raises(Exception, match="longer"):
        migrated_table(plan, "T", long).collect()
    assert migrated_table(plan, "T", long, lossy=True).first().NOME == "abc"


def test_catalog_files_and_duplicates(spark, tmp_path, pair):
    pair[0].write(str(tmp_path / "c"))
    assert plan_of(pair[0], read_catalog(spark, str(tmp_path / "c")))[1] == []
    twice = from_rows(spark, tables=[{"table_name": "a"}, {"table_name": "A"}])
    with pytest.raises(DuplicateObject):
        twice.assert_unique()


def test_statements_are_cut_outside_of_quotes_and_comments():
    from schemaloom.plans.execute import UnreadableStatement, statements

    cut = lambda sql: statements("AlterCheck", sql)
    assert cut("a 'x;y' ; b \"c;d\";") == ["a 'x;y' ;", 'b "c;d";'] and cut("a -- no; cut\n; b /* ; */ c") == ["a -- no; cut\n;", "b /* ; */ c"]
    assert cut("a [x;y] - 1 / 2; ; `p;q`") == ["a [x;y] - 1 / 2;", "`p;q`"] and cut("it''s 'it''s';") == ["it''s 'it''s';"] and cut("") == []
    for bad in ("a 'x; b", 'a "x; b', "a /* x; b", "a [x; b"):
        with pytest.raises(UnreadableStatement):
            cut(bad)


def test_cycles_of_many_shapes(spark):
    import random

    from schemaloom.operators.sequence import cycles

    r = random.Random(3)
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e"), ("x", "y"), ("y", "x"), ("y", "a"), ("s", "s")] + [(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(14)]
    names = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n and b != n} for n in names}
    for _ in names:
        reach = {n: own | {z for y in own for z in reach[y]} for n, own in reach.items()}
    wanted = {(n, min(m for m in names if m in reach[n] and n in reach[m])) for n in names if n in reach[n]}
    found = {(x.name, x.cycle) for x in cycles(spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert found == wanted and ("c", "a") in found
    assert cycles(spark.createDataFrame([], "child string, parent string")).count() == 0
