"""Snapshots, declared models, system tables, validators, streams."""

import json

import pytest
from pyspark.sql import functions as F

from schemaloom import dialects as D
from schemaloom.operators.validators import Rule, invalid, null_if_empty, valid
from schemaloom.plans.compare import compare
from schemaloom.plans.options import CompareOptions
from schemaloom.relations import Catalog, from_rows
from schemaloom.sources import declared as m
from schemaloom.sources import snapshot, system_tables


@m.table("CLIENTE", "customers")
@m.primary_key("ID", auto_increment=True)
@m.index("IDX_CLIENTE_NOME", "NOME")
@m.check("CK_CLIENTE_IDADE", "IDADE >= 0")
@m.sequence("SEQ_CLIENTE", 0, 1)
class Cliente:
    id = m.column("ID", "ftInteger", not_null=True)
    nome = m.column("NOME", "ftString", 60, not_null=True, default="SEM NOME", rules=(Rule("NOME", "not_empty"),))
    idade = m.column("IDADE", "ftInteger", rules=(Rule("IDADE", "minimum", 0), Rule("IDADE", "maximum", None, 150)))
    saldo = m.column("SALDO", "ftBCD", precision=18, scale=2)
    criado = m.column("CRIADO_EM", "ftDateTime")
    region = m.join_column("IDADE", "REGIOES", "CODIGO", "NOME_REGIAO", "LeftJoin")
    double = m.calculated("DOBRO", "IDADE * 2", "ftInteger")


@m.table("PEDIDO")
@m.primary_key("ID_EMPRESA; ID_PEDIDO")
@m.foreign_key("", "ID_CLIENTE", "CLIENTE", "ID", on_delete="Cascade", on_update="SetNull")
@m.index("IDX_PEDIDO_UNQ", "ID_EMPRESA,ID_PEDIDO", unique=True)
@m.order_by("ID_PEDIDO desc")
class Pedido:
    empresa = m.column("ID_EMPRESA", "ftInteger", not_null=True)
    pedido = m.column("ID_PEDIDO", "ftInteger", not_null=True)
    cliente = m.column("ID_CLIENTE", "ftInteger")
    total = m.column("VALOR_TOTAL", "ftCurrency", precision=15, scale=2)
    kind = m.enumeration("TIPO", "ftString", ["A", "B"], ["first", "second"])
    sum = m.aggregate("SOMA", "sum(VALOR_TOTAL)", "ID_CLIENTE")


@pytest.fixture(scope="module")
def registry():
    found = m.Registry()
    found.register(Cliente, Pedido, Cliente)
    return found


def test_models_as_catalogs(spark, registry):
    catalog = registry.catalog(spark, D.FIREBIRD)
    columns = {(r.table_key, r.column_name): (r.position, r.type_name, r.size, r.precision, r.scale) for r in catalog.columns.collect()}
    assert columns["CLIENTE", "NOME"] == (1, "VARCHAR(%l)", 60, 0, 0) and columns["CLIENTE", "SALDO"] == (3, "DECIMAL(%p,%s)", 0, 18, 2) and columns["CLIENTE", "CRIADO_EM"][1] == "TIMESTAMP"
    assert ("CLIENTE", "DOBRO") not in columns and len(columns) == 10
    fk = catalog.foreign_keys.first()
    assert (fk.name, fk.on_delete, fk.on_update) == ("FK_CLIENTE_ID_CLIENTE", "Cascade", "SetNull")
    assert registry.catalog(spark, D.ORACLE).columns.filter("column_name = 'CRIADO_EM'").first().type_name == "DATE"
    assert registry.catalog(spark, D.MYSQL).sequences.count() == 0 and catalog.sequences.count() == 1
    assert registry.model(Cliente) is registry.model(Cliente) and registry.model(Pedido).column("id_empresa").not_null
    for bad in (lambda: m.column("A", "ftNothing"), lambda: m.enumeration("A", "ftString", ["a b"]), lambda: m.column("A", "ftString", restrictions=["?"]), lambda: m.read_model(int)):
        with pytest.raises(m.ModelError):
            bad()


def test_models_on_rows(spark, registry):
    rows = spark.createDataFrame([(1, "a", 5), (2, "", -1), (3, None, 200)], "ID int, NOME string, IDADE int")
    rules = m.rules_of(registry.model(Cliente))
    assert [r.ID for r in valid(rows, rules).collect()] == [1]
    assert {r.ID: r.broken for r in invalid(rows, rules).collect()} == {2: ["NOME:not_empty", "IDADE:minimum"], 3: ["NOME:not_empty", "IDADE:maximum"]}
    assert [r.n for r in rows.select(null_if_empty("NOME").alias("n")).collect()] == ["a", None, None]
    regions = spark.createDataFrame([(5, "south")], "CODIGO int, NOME_REGIAO string")
    seen = m.rows_of(registry.model(Cliente), rows, {"REGIOES": regions})
    assert {(r.ID, r.NOME_REGIAO, r.DOBRO) for r in seen.collect()} == {(1, "south", 10), (2, None, -2), (3, None, 400)}
    orders = spark.createDataFrame([(1, 7, 2.0, "A"), (1, 7, 3.0, "B")], "ID_PEDIDO int, ID_CLIENTE int, VALOR_TOTAL double, TIPO string")
    assert m.aggregated(registry.model(Pedido), orders).first().SOMA == 5.0
    assert sorted(r.x for r in orders.select(m.decoded_enumeration(registry.model(Pedido).column("TIPO")).alias("x")).collect()) == ["first", "second"]


def test_snapshots(spark, registry, tmp_path):
    base = registry.catalog(spark, D.FIREBIRD)
    extra = from_rows(spark, views=[{"name": "VW", "script": "SELECT 'é'"}], domains=[{"name": "D", "type_name": "INTEGER"}], procedures=[{"name": "P", "signature": "int", "script": "x"}], triggers=[{"table": "CLIENTE", "name": "TRG", "script": "s"}])
    catalog = base.replaced(**extra.frames)
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    snapshot.save(catalog, a, D.FIREBIRD, "test", "2026-01-01T00:00:00Z")
    loaded = snapshot.load(spark, a)
    assert (loaded.driver, loaded.description, loaded.version) == (D.FIREBIRD, "test", 2)
    snapshot.save(loaded.catalog, b, D.FIREBIRD, "test", "2026-01-01T00:00:00Z")
    assert open(a, encoding="utf-8").read() == open(b, encoding="utf-8").read() and "é" in open(a, encoding="utf-8").read()
    plan = compare(loaded.catalog, catalog, CompareOptions(D.FIREBIRD))
    assert [r.label for r in plan.commands.collect() if not r.op.startswith("Enable")] == []
    doc = json.load(open(a, encoding="utf-8"))

    def refused(change):
        bad = json.loads(json.dumps(doc))
        change(bad)
        path = tmp_path / "bad.json"
        path.write_text(json.dumps(bad))
        with pytest.raises(snapshot.SnapshotError):
            snapshot.load(spark, str(path))

    refused(lambda d: d.update(FormatVersion=3))
    refused(lambda d: d.update(FormatVersion=0))
    refused(lambda d: d.update(DriverName="?"))
    refused(lambda d: d.pop("Catalog"))
    refused(lambda d: d["Catalog"]["Tables"][0]["Fields"][0].update(FieldType="ftNothing"))
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(spark, str(tmp_path / "bad.json"))
    first = {"FormatVersion": 1, "DriverName": "Firebird", "Catalog": {"Tables": [{"Name": "t", "Fields": [{"Name": "a"}]}]}}
    (tmp_path / "v1.json").write_text(json.dumps(first))
    old = snapshot.load(spark, str(tmp_path / "v1.json")).catalog
    assert old.domains.count() == 0 and old.columns.first().name_key == "A"


def test_system_tables(spark):
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    columns = "table_name string, column_name string, position int, native_type string, size int, precision int, scale int, not_null int, auto_increment int, default_value string, charset string, description string"
    raw = {
        "tables": rows("table_name string, description string", ("T", None), ("P", "parent")),
        "columns": rows(columns, ("T", "a", 0, "INT4", None, 32, 0, 1, 0, "0.000", None, None), ("T", "b", 1, "VARCHAR", 30, None, None, 0, 0, None, None, None), ("P", "id", 0, "INT8", None, 64, 0, 1, 0, None, None, None)),
        "primary_keys": rows("table_name string, pk_name string, column_name string, position int", ("P", "PK_P", "id", 1)),
        "foreign_keys": rows("table_name string, name string, column_name string, position int, parent_table string, parent_column string, on_update string, on_delete string", ("T", "fk", "a", 1, "P", "id", "NO ACTION", "CASCADE")),
        "indexes": rows("table_name string, name string, is_unique int, column_name string, position int", ("T", "ix", 1, "b", 2), ("T", "ix", 1, "a", 1)),
        "checks": rows("table_name string, name string, condition string", ("T", "ck", "CHECK ((a > 1))")),
        "views": rows("name string, script string", ("v", " SELECT 1 ")), "sequences": rows("name string, table_name string, initial_value int, increment int", ("s", "", 1, 2)),
        "domains": rows("name string, type_name string, not_null int, default_value string, check_condition string", ("d", "integer", 1, None, "CHECK ((VALUE > 0))"), ("d", "integer", 1, None, "CHECK ((VALUE < 9))")),
        "procedures": rows("name string, signature string, is_function int, script string", ("f", "integer", 1, "x")),
    }
    asked = []
    found = system_tables.database_catalog(spark, lambda q: asked.append(q) or raw[next(n for n, t in system_tables.QUERIES[D.POSTGRESQL].items() if t.split("{")[0] == q.split(" and table_schema = 'x'")[0].split(" and c.table_schema = 'x'")[0] or system_tables.query_for(D.POSTGRESQL, n, "x") == q)], D.POSTGRESQL, "x")
    assert len(asked) == len(raw) and all("'x'" in q for q in asked)
    got = {r.column_name: r for r in found.columns.collect()}
    assert (got["a"].field_type, got["a"].type_name, got["a"].default_value, got["a"].is_primary_key) == ("ftInteger", "INTEGER", "0", False) and got["id"].is_primary_key
    assert [(r.position, r.column_name) for r in found.key_columns.filter("key_kind = 'index'").orderBy("position").collect()] == [(0, "a"), (1, "b")]
    fk = found.foreign_keys.first()
    assert (fk.object_key, fk.on_update, fk.on_delete, fk.parent_key) == ("FK", "None", "Cascade", "P")
    assert found.checks.first().condition == "a > 1" and found.domains.first().check_condition == "(VALUE < 9) AND (VALUE > 0)" and found.procedures.first().object_key == "F(INTEGER)"
    bad = {**raw, "columns": rows(columns, ("T", "a", 0, "MYSTERY", None, None, None, 0, 0, None, None, None))}
    with pytest.raises(Exception, match="unknown column type"):
        system_tables.decoded(spark, bad, D.POSTGRESQL).columns.collect()
    for dialect, given in system_tables.QUERIES.items():
        assert all("{" not in system_tables.query_for(dialect, n) for n in given)
        with pytest.raises(ValueError):
            system_tables.query_for(D.POSTGRESQL, "tables", "x'; drop")


def test_functions_of_firebird_3():
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.executescript(
        "create table rdb$procedures(rdb$procedure_name, rdb$procedure_source, rdb$system_flag); insert into rdb$procedures values ('P ', 'begin end', 0);"
        "create table rdb$functions(rdb$function_name, rdb$function_source, rdb$system_flag, rdb$package_name);"
        "insert into rdb$functions values ('F ', 'begin return 1; end', 0, null), ('G', 'begin end', null, null), ('S', 'x', 1, null), ('OLD_UDF', null, 0, null), ('INNER', 'x', 0, 'PACK');"
    )
    found = db.execute(system_tables.query_for(D.FIREBIRD3, "procedures")).fetchall()
    assert found == [("P", "", 0, "CREATE PROCEDURE P AS begin end"), ("F", "", 1, "CREATE FUNCTION F AS begin return 1; end"), ("G", "", 1, "CREATE FUNCTION G AS begin end")]
    assert "rdb$functions" not in system_tables.query_for(D.FIREBIRD, "procedures") + system_tables.query_for(D.INTERBASE, "procedures")


def test_index_expressions_of_oracle(spark):
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    raw = {
        "tables": rows("table_name string, description string", ("T", None)),
        "columns": rows("table_name string, column_name string, position int, native_type string, size int, precision int, scale int, not_null int, auto_increment int, default_value string, charset string, description string", ("T", "A", 0, "VARCHAR2", 9, None, None, 0, 0, None, None, None)),
        "primary_keys": rows("table_name string, pk_name string, column_name string, position int"),
        "foreign_keys": rows("table_name string, name string, column_name string, position int, parent_table string, parent_column string, on_update string, on_delete string"),
        "indexes": rows("table_name string, name string, is_unique int, column_name string, position int, expression string", ("T", "IX", 0, "SYS_NC00004$", 1, 'UPPER("A")'), ("T", "IX", 0, "A", 2, None)),
    }
    found = system_tables.decoded(spark, raw, D.ORACLE).key_columns.filter("key_kind = 'index'").orderBy("position").collect()
    assert [r.column_name for r in found] == ['UPPER("A")', "A"]
    assert "user_ind_expressions" in system_tables.query_for(D.ORACLE, "indexes")


def test_session_tables(spark):
    from schemaloom.sources.frames import session_catalog

    spark.sql("create database if not exists loom_test")
    spark.sql("drop table if exists loom_test.t1")
    spark.sql("create table loom_test.t1 (id bigint not null comment 'key', price decimal(9,2), name varchar(7)) using parquet comment 'things'")
    found = session_catalog(spark, "loom_test")
    assert found.tables.first().description == "things"
    assert {(r.column_name, r.type_name, r.precision, r.description) for r in found.columns.collect() if r.column_name != "name"} == {("id", "BIGINT", 0, "key"), ("price", "DECIMAL(%p,%s)", 9, "")}


def test_streamed_rules(spark, tmp_path):
    from schemaloom.streaming.rules import split_to

    rows = spark.createDataFrame([(1, "a"), (2, "")], "id int, name string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    split_to(stream, [Rule("name", "not_null")], good, bad, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert [r.id for r in spark.read.parquet(good).collect()] == [1]
    assert [(r.id, r.broken) for r in spark.read.parquet(bad).collect()] == [(2, ["name:not_null"])]


def test_empty_catalogs(spark):
    assert Catalog(spark).tables.filter(F.lit(True)).count() == 0


@pytest.mark.parametrize("dialect", sorted(system_tables.QUERIES))
def test_queries_are_sql(dialect):
    """A parser of another database takes the queries, but for the forms that only their own database has."""
    import duckdb

    own = {(D.POSTGRESQL, "views"), (D.POSTGRESQL, "indexes")}
    for relation in system_tables.QUERIES[dialect]:
        for schema in ("", "app"):
            text = system_tables.query_for(dialect, relation, schema).replace("`", '"').replace("rdb$", "rdb_").replace("starting with", "like")
            said = json.loads(duckdb.execute("select json_serialize_sql(?)", [text]).fetchone()[0])
            assert not said["error"] or (dialect, relation) in own, (relation, said)


def test_domains_and_view_columns_of_firebird(spark):
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.executescript(
        "create table rdb$fields(rdb$field_name, rdb$field_type, rdb$field_sub_type, rdb$character_length, rdb$field_precision, rdb$field_scale, rdb$null_flag, rdb$default_source, rdb$validation_source, rdb$system_flag, rdb$character_set_id);"
        "insert into rdb$fields values ('MONEY', 16, 2, null, 18, -2, 1, 'DEFAULT 0', 'CHECK (VALUE >= 0)', 0, null), ('PHOTO', 261, 0, null, null, 0, null, null, null, null, null), ('NOTE', 261, 1, null, null, 0, null, null, null, 0, null),"
        "('CODE', 37, null, 10, null, 0, null, null, null, 0, null), ('RDB$1', 8, 0, null, 9, 0, null, null, null, 0, null), ('SQL$1', 8, 0, null, 9, 0, null, null, null, 0, null), ('ODD', 99, 0, 5, null, 0, null, null, null, 0, null);"
        "create table rdb$relations(rdb$relation_name, rdb$view_blr, rdb$system_flag); insert into rdb$relations values ('T', null, 0), ('V', 'x', 0);"
        "create table rdb$relation_fields(rdb$relation_name, rdb$field_name, rdb$field_position, rdb$field_source, rdb$null_flag, rdb$default_source, rdb$description);"
        "insert into rdb$relation_fields values ('T', 'A', 0, 'CODE', 1, null, null), ('V', 'B', 1, 'CODE', null, null, 'seen'), ('V', 'C', 0, 'RDB$1', null, null, null); create table rdb$character_sets(rdb$character_set_id, rdb$character_set_name);"
    )
    read = lambda relation, schema: spark.createDataFrame(db.execute(system_tables.query_for(D.FIREBIRD, relation)).fetchall(), schema)
    found = system_tables._domains(read("domains", "name string, domain_type string, size int, precision int, scale int, not_null int, default_value string, check_condition string"), D.FIREBIRD)
    assert {r.name: (r.type_name, r.not_null, r.default_value, r.check_condition) for r in found.collect()} == {
        "MONEY": ("DECIMAL(18,2)", True, "0", "VALUE >= 0"), "PHOTO": ("BLOB", False, "", ""), "NOTE": ("BLOB SUB_TYPE 1", False, "", ""), "CODE": ("VARCHAR(10)", False, "", ""), "ODD": ("VARCHAR(5)", False, "", ""),
    }
    columns = "table_name string, column_name string, position int, native_type string, size int, precision int, scale int, not_null int, auto_increment int, default_value string, charset string, description string"
    raw = {"tables": spark.createDataFrame([("T", None)], "table_name string, description string"), "columns": read("columns", columns), "view_columns": read("view_columns", columns), "views": spark.createDataFrame([("V", "select 1")], "name string, script string")}
    empty = {"primary_keys": "table_name string, pk_name string, column_name string, position int", "foreign_keys": "table_name string, name string, column_name string, position int, parent_table string, parent_column string, on_update string, on_delete string", "indexes": "table_name string, name string, is_unique int, column_name string, position int"}
    catalog = system_tables.decoded(spark, {**raw, **{k: spark.createDataFrame([], v) for k, v in empty.items()}}, D.FIREBIRD)
    assert [r.column_name for r in catalog.columns.collect()] == ["A"]
    seen = {(r.table_key, r.column_name, r.position, r.field_type, r.description) for r in catalog.view_columns.collect()}
    assert seen == {("V", "B", 1, "ftString", "seen"), ("V", "C", 0, "ftInteger", "")}
    text = snapshot.encoded(catalog, D.FIREBIRD).selectExpr("to_json(struct(*)) as j").first().j
    assert [f["Name"] for f in json.loads(text)["Catalog"]["Views"][0]["Fields"]] == ["C", "B"]
    back = snapshot.decoded(spark.createDataFrame([(text,)], "j string").selectExpr(f"from_json(j, '{snapshot.SCHEMA}') as d").select("d.Catalog.*"), spark)
    assert {(r.table_key, r.column_name, r.position, r.field_type, r.description) for r in back.view_columns.collect()} == seen


def test_snapshot_files_are_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    """No entry goes through the driver's Python, the file is the document, and other line breaks are read too."""
    odd = 'a "b" \\ \n\t é\u2028 \n      {\n      }'
    catalog = from_rows(
        spark, tables=[{"table_name": t, "description": odd} for t in ("B", "a", "empty")], columns=[{"table": t, "column_name": f"C{k}", "position": k, "type_name": "INTEGER", "field_type": "ftInteger", "description": odd} for t in ("B", "a") for k in range(40)],
        primary_keys=[{"table": "a", "pk_name": "PK"}], key_columns=[{"table": "a", "key_kind": "pk", "object_key": "", "column_name": "C1"}, {"table": "a", "key_kind": "index", "object": "I", "column_name": "C2"}],
        indexes=[{"table": "a", "name": "I"}], triggers=[{"table": "empty", "name": "T", "script": odd}], checks=[{"table": "B", "name": f"K{k}", "condition": "x"} for k in range(3)], domains=[{"name": f"D{k}", "type_name": "INTEGER"} for k in range(30)],
    )
    whole = "".join(snapshot.document(catalog, D.FIREBIRD, odd, "now"))
    path = str(tmp_path / "s.json")
    with monkeypatch.context() as m:
        m.setattr(snapshot, "document", lambda *_: pytest.fail("the driver made the document"))
        snapshot.save(catalog, path, D.FIREBIRD, odd, "now")
    assert open(path, encoding="utf-8").read() == whole
    (tmp_path / "compact.json").write_text(json.dumps(json.loads(whole)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")  # entries lie across the borders of pieces
    try:
        seen, parts = snapshot._pieces(spark, path)
        bodies = json.loads(whole)["Catalog"]
        for section in ("Tables", "Domains"):
            assert sorted((json.loads(x) for x in parts[section].toJSON().collect()), key=lambda x: x["Name"]) == sorted(bodies[section], key=lambda x: x["Name"])
        assert json.loads(seen.first().value)["SourceDescription"] == odd and snapshot._pieces(spark, str(tmp_path / "compact.json")) is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for bad in (whole.replace('"Name": "C7"', '"Name": C7', 1), whole[:-5]):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(snapshot.SnapshotError):
            snapshot.load(spark, str(tmp_path / "bad.json"))
