"""Catalogs of several schemas, digests of catalogs, and members of indexes that are expressions."""

import pytest
from pyspark.sql import functions as F

from schemaloom import dialects as D
from schemaloom import table_queries as q
from schemaloom.functions import normalize
from schemaloom.functions.keys import schema_prefix, schema_prefix_text
from schemaloom.operators import diff, digest
from schemaloom.operators.schemas import aligned, qualified, renamed
from schemaloom.plans.compare import compare
from schemaloom.plans.options import CompareOptions, InvalidOption
from schemaloom.relations import DuplicateObject, from_rows, read_catalog
from schemaloom.sources.system_tables import QUERIES, decoded

from .test_catalog import INT, catalog, one, pair, text  # noqa: F401  (pair is a fixture)


def ops(rows):
    return sorted((r.kind, r.table_key, r.object_key, *r.ops) for r in rows.select("kind", "table_key", "object_key", "ops").collect())


def test_prefixes_tell_schemas_apart(spark):
    names = ["a", "A", "a.b", 'a"', '"a', "a.", "", "ü"]
    made = [schema_prefix_text(n) for n in names]
    assert len(set(made)) == len(names) - 1  # but for letter case
    assert not [(x, y) for x in set(made) for y in set(made) if x != y and y.startswith(x)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(schema_prefix(F.col("n")).alias("p"))
    assert [r.p for r in rows.collect()] == made


def test_equal_names_in_two_schemas_do_not_meet(spark):
    read = lambda size: from_both(spark, size)
    plan = compare(read(20), read(10), CompareOptions(D.POSTGRESQL))
    sql = [r.sql for r in plan.commands.filter("op = 'AlterColumn'").collect()]
    assert len(sql) == 1 and sql[0].startswith('ALTER TABLE "b"."t" ALTER COLUMN c TYPE VARCHAR(20)')
    other = compare(renamed(read(20), (("b", "a"), ("a", "b"))), read(10), CompareOptions(D.POSTGRESQL, schemas=(("a", "b"), ("b", "a"))))
    assert [r.sql for r in other.commands.filter("op = 'AlterColumn'").collect()] == sql


def from_both(spark, size):
    """What PostgreSQL answers for a database with the table t in the schemas a and b."""
    columns = "schema_name string, table_name string, column_name string, position int, native_type string, size int, precision int, scale int, not_null int, auto_increment int, default_value string, charset string, description string"
    rows = lambda given, schema: spark.createDataFrame(given, schema)
    return decoded(spark, {
        "tables": rows([("a", "t", ""), ("b", "t", "")], "schema_name string, table_name string, description string"),
        "columns": rows([("a", "t", "c", 0, "VARCHAR", 5, 0, 0, 0, 0, "", "", ""), ("b", "t", "c", 0, "VARCHAR", size, 0, 0, 0, 0, "", "", "")], columns),
        "primary_keys": rows([("a", "t", "PK_t", "c", 1), ("b", "t", "PK_t", "c", 1)], "schema_name string, table_name string, pk_name string, column_name string, position int"),
        "foreign_keys": rows([("a", "t", "fk", "c", 1, "b", "t", "c", "NO ACTION", "CASCADE")], "schema_name string, table_name string, name string, column_name string, position int, parent_schema string, parent_table string, parent_column string, on_update string, on_delete string"),
        "indexes": rows([("b", "t", "ix", 1, None, 1, "lower(c)")], "schema_name string, table_name string, name string, is_unique int, column_name string, position int, expression string"),
        "views": rows([("a", "v", "select 1"), ("b", "v", "select 2")], "schema_name string, name string, script string"),
        "domains": rows([("a", "d", "integer", 0, None, None), ("b", "d", "integer", 1, None, None)], "schema_name string, name string, type_name string, not_null int, default_value string, check_condition string"),
        "sequences": rows([("a", "s", "", 1, 1)], "schema_name string, name string, table_name string, initial_value int, increment int"),
        "procedures": rows([("b", "p", "int", 1, "x")], "schema_name string, name string, signature string, is_function int, script string"),
    }, D.POSTGRESQL)


def test_a_catalog_of_several_schemas(spark, tmp_path):
    found = from_both(spark, 7)
    assert found.qualified and sorted(r.table_key for r in found.tables.collect()) == ["A.T", "B.T"]
    assert {(r.table_key, r.parent_key, r.parent_schema) for r in found.foreign_keys.collect()} == {("A.T", "B.T", "b")}
    assert {r.object_key for r in found.views.collect()} == {"A.V", "B.V"} and {r.object_key for r in found.procedures.collect()} == {"B.P(INT)"} and {r.object_key for r in found.domains.collect()} == {"A.D", "B.D"}
    assert found.key_columns.filter("key_kind = 'index'").first().name_key == "LOWER(C)"
    found.write(str(tmp_path))
    assert ops(diff.changes(found, read_catalog(spark, str(tmp_path), qualified=True), CompareOptions(D.POSTGRESQL))) == []
    whole = [r.sql for r in compare(found, found.replaced(**{n: f.limit(0) for n, f in found.frames.items()}), CompareOptions(D.POSTGRESQL)).commands.collect()]
    assert 'ALTER TABLE "a"."t" ADD CONSTRAINT fk FOREIGN KEY (c) REFERENCES "b"."t"(c) ON DELETE CASCADE;' in whole
    assert any(x.startswith('CREATE TABLE "b"."t"') and 'CREATE UNIQUE INDEX ix ON "b"."t" (lower(c));' in x for x in whole)


def test_a_catalog_of_one_schema_meets_one_of_several(spark):
    one_schema = catalog(spark, one("t", {"name": "c", "size": 9}))
    one_schema = type(one_schema)(spark, "", "a", one_schema.frames)
    desired, current = aligned(one_schema, from_both(spark, 7))
    assert desired.qualified and [r.table_key for r in desired.tables.collect()] == ["A.T"] and qualified(desired) is desired
    changed = [r for r in ops(diff.changes(one_schema, from_both(spark, 7), CompareOptions(D.POSTGRESQL))) if r[0] == "column"]
    assert changed == [("column", "A.T", "C", "AlterColumn")]
    for bad in ((("a", "b"), ("A", "c")), (("a", "c"), ("b", "C"))):
        with pytest.raises(InvalidOption):
            CompareOptions(D.POSTGRESQL, schemas=bad)


def test_every_query_of_dialects_with_schemas_gives_them():
    for dialect in (D.POSTGRESQL, D.MSSQL):
        assert all("schema_name" in sql for sql in QUERIES[dialect].values()) and "parent_schema" in QUERIES[dialect]["foreign_keys"]


def test_identities_that_occur_twice_are_refused(spark):
    twice = from_rows(spark, tables=[{"table_name": "t"}], columns=[{"table": "t", "column_name": "a"}, {"table": "t", "column_name": "A", "size": 3}])
    with pytest.raises(DuplicateObject, match="column T A"):
        compare(twice, from_rows(spark), CompareOptions())


@pytest.mark.parametrize("options", [{}, {"compare_positions": True, "compare_descriptions": True, "strict_keys": True}])
def test_narrowed_catalogs_have_the_same_differences(spark, pair, options):  # noqa: F811
    options = CompareOptions(D.FIREBIRD, **options)
    whole = ops(diff.differences(diff.compared(*pair, narrow=False), options))
    assert ops(diff.differences(diff.compared(*pair, narrow=True), options)) == whole and whole
    assert digest.changed(pair[0], pair[0]).count() == 0


def test_digests_see_nulls_counts_and_what_stands_where(spark):
    def with_views(*rows):
        return from_rows(spark).replaced(views=spark.createDataFrame([(k, n, s, "") for k, n, s in rows], "object_key string, name string, script string, description string"))

    base = with_views(("A", "a", None), ("B", "b", "x"), ("C", "c", "y"), ("D", "d", "z"))
    other = with_views(("A", None, "a"), ("B", "b", "x"), ("B", "b", "x"), ("C", "cy", ""))
    assert sorted(r.own for r in digest.changed(base, other).collect()) == ["views A", "views B", "views C", "views D"]
    assert digest.changed(from_rows(spark), from_rows(spark)).count() == 0


def test_attributes_travel_only_for_tables_that_differ(spark):
    """A catalog of 200,000 columns in 10,000 tables, of which 1 in 100 has a change: the rows that are joined are those of these tables."""
    tables = spark.range(10_000).selectExpr("'' as schema_name", "concat('T', id) as table_key", "concat('T', id) as table_name", "'' as description")
    columns = tables.select("table_key").crossJoin(spark.range(20).selectExpr("cast(id as int) as position")).selectExpr(
        "table_key", "position", "concat('C', position) as column_name", "concat('C', position) as name_key", "'ftString' as field_type", "'VARCHAR(%l)' as type_name", "60 as size", "0 as precision", "0 as scale", "false as not_null", "false as auto_increment",
        "'NoSort' as sorting_order", "'' as default_value", "false as is_primary_key", "'' as charset", "'' as description",
    )
    desired = from_rows(spark).replaced(tables=tables, columns=columns)
    current = desired.replaced(columns=columns.withColumn("size", F.expr("if(table_key like '%77' and position = 3, 50, size)")))
    assert digest.worthwhile(desired, current)
    rows = diff.compared(desired, current)
    assert rows.count() == 100 * 21
    assert len(ops(diff.differences(rows, CompareOptions(D.POSTGRESQL)))) == 100


def test_expressions_in_canonical_form(spark):
    same = [["lower(a)", "LOWER( A )", "((lower(a)))"], ["a||'X  y'", "( A  || 'X  y' )"], ["cast(a as int)", "CAST(a\n AS  INT)"], ["\"Na me\"+1", "(\"Na me\" + 1)"], ["coalesce(a,'(')", "Coalesce( a , '(' )"], ["(a)+(b)", "( A ) + ( B )"]]
    rows = spark.createDataFrame([(k, t) for k, own in enumerate(same) for t in own] + [(99, None), (98, "")], "k int, t string")
    found = {}
    for r in rows.select("k", normalize.expression(F.col("t")).alias("x")).collect():
        found.setdefault(r.k, set()).add(r.x)
    assert all(len(v) == 1 for v in found.values()) and len({*map(str, found.values())}) == len(found) and found[99] == {None} and found[98] == {""}
    literals = spark.createDataFrame([("a || 'x'",), ("a || 'X'",), ("\"a\"",), ("a",)], "t string").select(normalize.expression(F.col("t")).alias("x"))
    assert literals.distinct().count() == 4


def test_pairs_of_catalogs_of_the_queries(spark, sf):
    desired, current = q.schema_catalogs(spark, sf)
    assert desired.assert_unique() is desired and current.assert_unique() is current


def test_lines_of_orders_are_dealt_in_pieces(spark, sf, monkeypatch):
    """The more lines, the more tasks; all lines of an order are in one of them, and the catalogs are the same."""
    whole = [sorted(map(tuple, x.columns.collect())) for x in q.order_catalogs(spark, sf)]
    monkeypatch.setattr(q, "PIECE", 500)
    pieces = q.order_catalogs(spark, sf)
    assert [sorted(map(tuple, x.columns.collect())) for x in pieces] == whole
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    for x in pieces:
        dealt = x.columns.select("table_key", F.spark_partition_id().alias("task"))
        assert n / 2 < dealt.select("task").distinct().count() <= n
        assert dealt.distinct().count() == dealt.select("table_key").distinct().count()


def test_no_task_holds_a_whole_table(spark):
    """Whether a table is new, gone or kept, and whether a column of it has moved, is joined to its rows; no window gathers them."""
    from schemaloom.operators.objects import objects

    desired = catalog(spark, one("A", INT, text("X", 9)), one("B", INT))
    current = catalog(spark, one("A", text("X", 9), INT), one("C", INT)).replaced()
    current = current.replaced(columns=current.columns.withColumn("position", F.when(F.col("table_key") == "A", 5 - F.col("position")).otherwise(F.col("position"))))
    rows = diff.joined(objects(desired), objects(current))
    found = diff.differences(diff.compared(desired, current), CompareOptions(D.FIREBIRD, compare_positions=True))
    for frame in (rows, found):
        assert "Window" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.own, r.table_status) for r in rows.collect()} == {("A", "keep"), ("B", "create"), ("C", "drop")}
    assert {(r.table_key, r.object_key) for r in found.filter("array_contains(ops, 'AlterColumnPosition')").collect()} == {("A", "ID"), ("A", "X")}
