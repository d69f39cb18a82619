"""Sinks, scripts, lineage, formulas and Power Query beyond what SQL shows."""

import datetime

import pytest

from plumbline.errors import GuardRefused, LoadRefused
from plumbline.functions.expressions import count_rows, equals, more_than, sum_of
from plumbline.operators import batches, lineage, ordered, sinks
from plumbline.operators.pivots import Field, Pivot, Value
from plumbline.operators.power_query import PowerQuery
from plumbline.operators.verify import check_workbook, compare, compare_batch, near, same_plan
from plumbline.operators.workbooks import Workbook
from plumbline.plans.converting import Insert, convert_query, typed_selected_columns
from plumbline.plans.rendering import export_sql, to_sql
from plumbline.plans.statements import AS, FROM, GROUP_BY, SELECT, WHERE, derived, rollup, run_query, statement, unchecked_derived
from plumbline.sources.formulas import FormulaError, parse
from plumbline.sources.tables import Table, add_references, describe_table, latest_partition, propose_key
from plumbline.streaming import overwrite_batches


@pytest.fixture
def sales(spark):
    return spark.createDataFrame([(1, "a", 5.0, "2024-01-01"), (2, "a", 7.0, "2024-01-01"), (3, "b", 1.0, "2024-01-02")], "id long, k string, v double, dt string")


source = Table("sales", {"id": "bigint", "k": "string", "v": "double", "dt": "string"}, key=["id"])
by_day = statement(SELECT(source.k, AS(sum_of(source.v), "v"), source.dt), FROM(source), GROUP_BY(source.k, source.dt))


def target(tmp_path, **facts):
    return Table("t", {"k": "string", "v": "double", "dt": "string"}, partitioned_by=["dt"], key=["k", "dt"], location=f"file://{tmp_path}/t", **facts)


def test_overwrite_replaces_filled_partitions_only(spark, sales, tmp_path):
    t = target(tmp_path)
    for _ in range(2):
        sinks.insert_overwrite(t, by_day, {"sales": sales})
    assert spark.read.parquet(t.location).count() == 2
    sinks.insert_overwrite(t, statement(SELECT(source.k, AS(sum_of(source.v), "v"), source.dt), FROM(source), WHERE(equals(source.dt, "2024-01-02")), GROUP_BY(source.k, source.dt)), {"sales": sales.selectExpr("id", "k", "v * 2 AS v", "dt")})
    assert sorted(map(tuple, spark.read.parquet(t.location).collect())) == [("a", 12.0, datetime.date(2024, 1, 1)), ("b", 2.0, datetime.date(2024, 1, 2))]
    empty = statement(SELECT(source.k, AS(sum_of(source.v), "v")), FROM(source), WHERE(more_than(source.v, 99)), GROUP_BY(source.k))
    sinks.insert_overwrite(t, empty, {"sales": sales}, partition={"dt": "2024-01-02"})
    assert spark.read.parquet(t.location).count() == 1
    sinks.insert_into(t, by_day, {"sales": sales})
    assert spark.read.parquet(t.location).count() == 3


def test_write_checks(tmp_path):
    t = target(tmp_path)
    rows = statement(SELECT(source.k, source.v, source.dt), FROM(source))
    with pytest.raises(GuardRefused, match="proves"):
        sinks.check_write(t, rows)
    sinks.check_write(t, rows, unproven_key=True)
    with pytest.raises(GuardRefused, match="too few"):
        sinks.check_write(t, statement(SELECT(source.k), FROM(source)))
    totals = derived("totals", statement(SELECT(source.k, source.dt, AS(sum_of(source.v), "v")), FROM(source), GROUP_BY(rollup(source.k, source.dt))))
    with pytest.raises(GuardRefused, match="subtotal"):
        sinks.check_write(t, statement(SELECT(totals.k, totals.dt, totals.v), FROM(totals)), unproven_key=True)
    with pytest.raises(GuardRefused, match="first of"):
        sinks.check_write(t, rows, partition={"k": "a"})


def test_catalog_upkeep(spark, tmp_path):
    t = Table("upkeep_t", {"k": "string", "dt": "string"}, partitioned_by=["dt"], location=f"file://{tmp_path}/u")
    sinks.create_table(spark, t)
    try:
        spark.sql("INSERT INTO upkeep_t VALUES ('a', '2024-01-01'), ('b', '2024-01-03')")
        sinks.repair_partitions(spark, t)
        sinks.compute_statistics(spark, t)
        assert latest_partition(spark, "upkeep_t", "dt") == "2024-01-03"
        assert describe_table(spark, "upkeep_t").partitioned_by == ("dt",)
        assert sinks.add_columns(spark, Table("upkeep_t", {"k": "string", "n": "int", "dt": "string"})) == ["n"]
        assert sinks.drop_partitions(spark, t, lambda p: p["dt"] < "2024-01-02") == [{"dt": "2024-01-01"}]
    finally:
        sinks.drop_table(spark, t)


def test_partitions_of_odd_values_are_found_and_dropped(spark, tmp_path):
    t = Table("odd_parts", {"k": "int", "at": "string"}, partitioned_by=["at"], location=f"file://{tmp_path}/odd")
    sinks.create_table(spark, t)
    try:
        spark.sql("INSERT INTO odd_parts VALUES (1, '2024-01-01 10:30'), (2, 'a/b=c%25'), (3, NULL), (4, 'o''clock')")
        assert latest_partition(spark, "odd_parts", "at") == "o'clock"
        assert sinks.drop_partitions(spark, t, lambda p: p["at"] is None or p["at"] != "a/b=c%25")
        assert [r.k for r in spark.table("odd_parts").collect()] == [2]
        assert sinks.drop_partitions(spark, t, lambda p: True) == [{"at": "a/b=c%25"}] and spark.sql("SHOW PARTITIONS odd_parts").count() == 0
    finally:
        sinks.drop_table(spark, t)


def test_stream_of_batches_can_be_retried(spark, sales, tmp_path):
    t = target(tmp_path)
    write = overwrite_batches(t, by_day, "sales")
    write(sales, 0)
    write(sales, 0)
    assert spark.read.parquet(t.location).count() == 2


def test_comparisons(spark, sales):
    assert compare(sales, sales).same
    c = compare(sales, sales.where("id > 1").union(sales.where("id = 3")))
    assert (c.only_left, c.only_right) == (1, 1)
    assert same_plan(sales.where("v > 1"), sales.where("v > 1"))
    assert [tuple(r) for r in near(sales, sales.selectExpr("id", "k", "v + if(id = 1, 1, 0) AS v", "dt"), ["id"]).collect()] == [(1, "v", "5.0", "6.0")]


def test_scripts():
    text = "INSERT OVERWRITE TABLE b SELECT ';' FROM a; -- c;\nCREATE TABLE a AS WITH x AS (SELECT 1) SELECT * FROM x;;"
    parts = batches.in_order(map(batches.classify, batches.split_statements(text)))
    assert [(p.kind, p.writes, set(p.reads)) for p in parts] == [("create_as", "a", set()), ("insert", "b", {"a"})]
    with pytest.raises(GuardRefused, match="loop"):
        batches.in_order(map(batches.classify, ["INSERT INTO a SELECT * FROM b", "INSERT INTO b SELECT * FROM a"]))
    assert batches.fill_tags("x = '<PARM=\"D\"/>'", {"D": 1}) == ("x = :D", {"D": 1})


def test_lineage(spark):
    d = derived("d", by_day)
    top = statement(SELECT(d.k, AS(sum_of(d.v), "total")), FROM(d), WHERE(more_than(d.v, 1)), GROUP_BY(d.k))
    found = {(e.source, e.target, e.how) for e in lineage.edges("top", top)}
    assert ("sales.v", "d.v", "value") in found and ("d.v", "top.total", "value") in found and ("d.v", "top.*", "rows") in found
    a = lineage.logic({"d": by_day, "top": top})
    b = lineage.logic({"d": statement(SELECT(source.k, AS(sum_of(source.v, where=more_than(source.v, 0)), "v"), source.dt), FROM(source), GROUP_BY(source.k, source.dt)), "top": top})
    assert a["top.total"][0] == b["top.total"][0] and a["top.total"][1] != b["top.total"][1]
    frame = lambda x, at: spark.createDataFrame([(c, o, e, at) for c, (o, e) in x.items()], "column string, own string, effective string, recorded int")
    changed = {r["column"]: r.change for r in lineage.changes(frame(a, 1), frame(b, 2)).collect()}
    assert changed["d.v"] == "OWN" and changed["top.total"] == "INHERITED"
    assert lineage.run_order({"c": {"b"}, "a": set(), "b": {"a"}}) == ["a", "b", "c"]
    with pytest.raises(GuardRefused):
        lineage.run_order({"a": {"b"}, "b": {"a"}})
    done = []
    assert lineage.run_tables({"b": ({"a"}, lambda: done.append("b")), "a": (set(), lambda: done.append("a"))}) == done == ["a", "b"]


def test_formula_precedence():
    assert parse("=-2^2") == ("op", "^", ("neg", ("num", 2)), ("num", 2))
    assert parse("=1+2*3&4") == ("op", "&", ("op", "+", ("num", 1), ("op", "*", ("num", 2), ("num", 3))), ("num", 4))
    with pytest.raises(FormulaError):
        parse("=1+")
    with pytest.raises(FormulaError):
        parse("=(1")


def test_lookups_of_repeated_keys(spark, sales):
    book = Workbook({"s": sales, "o": spark.createDataFrame([("a",), ("c",)], "k string")}, {"s": ["id"]})
    assert book.add("o", x="=XLOOKUP([@k],s[k],s[id])").count() == 3 and "may repeat" in book.notes[0]
    one = Workbook({"s": sales, "o": spark.createDataFrame([("a",), ("c",)], "k string")}, {"s": ["id"]}, first_match=True)
    assert one.add("o", x="=XLOOKUP([@k],s[k],s[id])").count() == 2
    merged = Workbook({"s": sales, "o": spark.createDataFrame([("a",), ("c",)], "k string")}, {"s": ["id"]})
    plan = merged.add("o", x="=SUMIFS(s[v],s[k],[@k])/COUNTIFS(s[k],[@k])")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_power_query_refuses_orders_it_does_not_have(sales):
    for step in ('Table.FillDown(s, {"v"})', "Table.FirstN(s, 2)", 'Table.AddIndexColumn(s, "i")', 'Table.Distinct(s, {"k"})', "Table.Schema(s)"):
        with pytest.raises(GuardRefused):
            PowerQuery({"s": sales}).run(f"let A = {step} in A")


def test_raw_sql(spark, sales):
    sales.createOrReplaceTempView("raw_sales")
    raw = unchecked_derived("raw", "SELECT k, v FROM raw_sales WHERE v > 2", {"k": "string", "v": "double"})
    assert statement(SELECT(AS(count_rows(), "n")), FROM(raw)).lower({}).first()[0] == 2


def test_a_failing_query_leaves_the_table(spark, sales, tmp_path):
    t = target(tmp_path)
    sinks.insert_overwrite(t, by_day, {"sales": sales})
    before = sorted(map(tuple, spark.read.parquet(t.location).collect()))
    broken = sales.selectExpr("id", "k", "if(id > 0, raise_error('no'), v) AS v", "dt")
    part = statement(SELECT(source.k, AS(sum_of(source.v), "v")), FROM(source), GROUP_BY(source.k))
    for query, partition in ((by_day, None), (part, {"dt": "2024-01-01"})):
        with pytest.raises(Exception, match="no"):
            sinks.insert_overwrite(t, query, {"sales": broken}, partition=partition)
        assert sorted(map(tuple, spark.read.parquet(t.location).collect())) == before
    whole = Table("w", {"k": "string", "v": "double"}, key=["k"], location=f"file://{tmp_path}/w")
    sinks.insert_overwrite(whole, part, {"sales": sales})
    with pytest.raises(Exception, match="no"):
        sinks.insert_overwrite(whole, part, {"sales": broken})
    assert spark.read.parquet(whole.location).count() == 2
    # A table that is overwritten from itself.
    own = statement(SELECT(whole.k, AS(whole.v * 10, "v")), FROM(whole))
    sinks.insert_overwrite(whole, own, {"w": spark.read.parquet(whole.location)})
    assert sorted(map(tuple, spark.read.parquet(whole.location).collect())) == [("a", 120.0), ("b", 10.0)]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("w")] == ["w"]


def test_a_partition_overwritten_from_itself_and_one_emptied(spark, tmp_path):
    t = Table("two", {"v": "int", "a": "string", "b": "string"}, partitioned_by=["a", "b"], location=f"file://{tmp_path}/two")
    rows = spark.createDataFrame([(1, "x", "p"), (2, "x", "it's"), (3, "y", "p")], "v int, a string, b string")
    every = statement(SELECT(t.v, t.a, t.b), FROM(t, reads_all_partitions=True))
    sinks.insert_overwrite(t, every, {"two": rows})
    read = lambda: sorted(map(tuple, spark.read.schema("v int, a string, b string").parquet(t.location).collect()))
    own = statement(SELECT(AS(t.v + 10, "v"), t.b), FROM(t), WHERE(equals(t.a, "x"), equals(t.b, "it's")))
    sinks.insert_overwrite(t, own, {"two": spark.read.schema("v int, a string, b string").parquet(t.location)}, partition={"a": "x"})
    assert read() == [(3, "y", "p"), (12, "x", "it's")]


def test_numbers_of_rows_in_several_parts(spark):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").repartition(6)
    from pyspark.sql import functions as F

    out = ordered.numbered(lines, [F.col("l_quantity").desc()], "i", 5, 2)
    n, distinct, low, high = out.selectExpr("count(*)", "count(DISTINCT i)", "min(i)", "max(i)").first()
    assert (n, distinct, low, high) == (600_000, 600_000, 5, 5 + 2 * 599_999) and set(lines.columns) < set(out.columns)
    edges = out.groupBy("l_quantity").agg(F.min("i").alias("a"), F.max("i").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a and x.l_quantity > y.l_quantity for x, y in zip(edges, edges[1:], strict=False))
    # One value in every row: it fills no single range.
    same = ordered.dealt(spark.range(20_000).selectExpr("id", "1 AS v"), [F.col("v").asc()])
    assert same.select("__part").distinct().count() > 1


def test_compared_totals_are_those_of_a_join(spark):
    import random

    rng = random.Random(6)
    number = lambda: rng.choice((None, *range(12)))
    asked = spark.createDataFrame([(rng.choice((None, "a", "b")), number()) for _ in range(60)], "k string, x int")
    given = spark.createDataFrame([(rng.choice((None, "a", "c")), number(), rng.choice((None, 1.0, 2.5, -4.0))) for _ in range(80)], "k string, c int, v double")
    rows = given.collect()
    for sign, holds in (("<", lambda c, x: c < x), ("<=", lambda c, x: c <= x), (">", lambda c, x: c > x), (">=", lambda c, x: c >= x)):
        for kind, total in (("sum", lambda v: sum(v) if v else None), ("count", len), ("avg", lambda v: sum(v) / len(v) if v else None), ("min", lambda v: min(v, default=None)), ("max", lambda v: max(v, default=None))):
            got = {(r.k, r.x): r.t for r in ordered.compared_totals(asked, given, ["k"], sign, kind, "t").collect()}
            want = {(k, x): total([r.v for r in rows if r.k == k and r.c is not None and holds(r.c, x) and r.v is not None]) for k, x in asked.distinct().collect() if x is not None}
            assert got.keys() == want.keys() and all((got[q] or 0) == pytest.approx(want[q] or 0) for q in want), (sign, kind)
    assert ordered.compared_totals(asked.select("x"), given.limit(0), [], "<", "sum", "t").where("t IS NOT NULL").count() == 0


def test_ddl_holds_apostrophes_and_the_key(spark, tmp_path):
    t = Table("quoted_t", {"k": "string", "n": "int"}, key=["k"], location=f"file://{tmp_path}/it's", descriptions={"k": "the shop's \\ key"}, properties={"keeper": "o'neil"})
    sinks.create_table(spark, t)
    try:
        again = describe_table(spark, "quoted_t")
        assert again.key == ("k",) and spark.sql("DESCRIBE quoted_t").where("col_name = 'k'").first().comment == "the shop's \\ key"
        sinks.set_properties(spark, Table("quoted_t", {"k": "string"}, properties={"note": "it's"}))
        assert dict(spark.sql("SHOW TBLPROPERTIES quoted_t").collect())["note"] == "it's"
        made, failed = add_references(spark, ["quoted_t", "no_such_table"])
        assert list(made) == ["quoted_t"] and list(failed) == ["no_such_table"]
        sinks.settings(spark, "dynamic_partitions", sets={"spark.sql.session.timeZone": "UTC"})
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "dynamic"
        log = f"file://{tmp_path}/log"
        sinks.set_admin_log(log)
        assert sinks.unchecked_sql(spark, "SELECT 1 AS x").first().x == 1 and "SELECT 1" in spark.read.text(log).first()[0]
        moved = Table("quoted_t", {"k": "string", "n": "int"}, location=f"file://{tmp_path}/moved")
        spark.sql("INSERT INTO quoted_t VALUES ('a', 1)")
        sinks.move_to_own_folder(spark, "quoted_t", moved)
        assert spark.read.parquet(moved.location).count() == 1
    finally:
        sinks.set_admin_log(None)
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
        sinks.drop_table(spark, t)


def test_keys_are_proposed_from_the_latest_partition(spark):
    rows = spark.createDataFrame([(1, "d1"), (1, "d1"), (1, "d2"), (2, "d2")], "id int, dt string")
    assert propose_key(rows) is None and propose_key(rows, ["dt"]) == ("id",)


def test_rows_that_are_limited_run_once(spark, sales):
    seen = spark.sparkContext.accumulator(0)
    from pyspark.sql import functions as F

    @F.udf("double")
    def touched(v):
        seen.add(1)
        return v

    q = statement(SELECT(source.k, AS(sum_of(source.v), "v")), FROM(source), GROUP_BY(source.k))
    got = run_query(q, {"sales": sales.withColumn("v", touched("v"))}, rows=10)
    assert got.count() == 2 and got.collect() and seen.value == 3
    with pytest.raises(LoadRefused):
        run_query(q, {"sales": sales}, rows=2)


def test_python_steps_see_whole_groups(spark, sales, tmp_path):
    share = lambda pdf: pdf.assign(share=pdf["v"] / pdf["v"].sum())[["id", "share"]]
    many = sales.repartition(3)
    assert {r.id: r.share for r in lineage.python_step(many, share, "id long, share double").collect()} == {1: 5 / 13, 2: 7 / 13, 3: 1 / 13}
    assert {r.id: r.share for r in lineage.python_step(many, share, "id long, share double", by=["k"]).collect()} == {1: 5 / 12, 2: 7 / 12, 3: 1.0}
    with pytest.raises(LoadRefused):
        lineage.python_step(many, share, "id long, share double", most=2)
    step = lineage.PythonStep(statement(SELECT(source.id, source.v), FROM(source)), share, {"id": "bigint", "share": "double"}, key=["id"])
    t = Table("shares", {"id": "bigint", "share": "double"}, key=["id"], location=f"file://{tmp_path}/shares")
    sinks.insert_overwrite(t, step, {"sales": many})
    assert spark.read.parquet(t.location).count() == 3
    assert ("sales.v", "shares step.v") in {(e.source, e.target) for e in lineage.edges("shares", step)}


def test_runs_and_workflows():
    done = []
    run = lineage.build_run(lambda day, n: {"b": ({"a"}, lambda: done.append((day, n))), "a": (set(), lambda: done.append("a"))}, {"day": datetime.date, "n": int})
    assert run(day="2024-01-02", n="3") == ["a", "b"] and done == ["a", (datetime.date(2024, 1, 2), 3)]
    assert run(day="2024-01-02", n=3, start_from="b", dry_run=True) == ["b"] and run(day="2024-01-02", n=3, leave_out=["a"], dry_run=True) == ["b"]
    for bad in ({"day": "x", "n": 1}, {"day": "2024-01-01"}, {"day": "2024-01-01", "n": 1, "z": 2}):
        with pytest.raises(GuardRefused):
            run(**bad)
    marks, steps = [], {"one": lambda: None, "two": lambda: 1 / 0}
    with pytest.raises(ZeroDivisionError):
        lineage.run_workflow(steps, on_done=marks.append)
    assert marks == ["one"] and lineage.run_workflow(steps, done=marks, dry_run=True) == ["two"]
    assert lineage.table_edges({"top": by_day}) == [("sales", "top")]


@pytest.mark.parametrize("text", ["ALTER TABLE x ADD COLUMNS (a int)", "DROP TABLE nowhere", "TRUNCATE TABLE x", "MERGE INTO a USING b ON 1 = 1 WHEN MATCHED THEN DELETE", "INSERT OVERWRITE DIRECTORY '/x' SELECT 1", "USE other", "LOAD DATA INPATH '/x' INTO TABLE y", "MSCK REPAIR TABLE x", "CREATE TABLE empty_one", "CREATE TABLE t1 (a INT); INSERT INTO t1 SELECT 1, 2", "CREATE TABLE t2 (a INT); INSERT INTO t2 (b) SELECT 1"])
def test_scripts_refuse_what_they_do_not_run(spark, text):
    with pytest.raises(GuardRefused):
        batches.run_batch(spark, text)


def test_a_name_written_twice_is_read_as_it_was(spark, sales):
    sales.createOrReplaceTempView("raw_sales")
    out = batches.run_batch(spark, "CREATE TABLE s AS SELECT 1 AS x; INSERT INTO a SELECT x FROM s; DROP TABLE s; CREATE TABLE s AS SELECT 2 AS x; INSERT INTO b SELECT x FROM s; SELECT ';' AS semi, 'from db.s' AS t -- ; done")
    assert out["a"].first().x == 1 and out["b"].first().x == 2 and tuple(out["query_1"].first()) == (";", "from db.s")
    like = batches.run_batch(spark, "CREATE TABLE m.like_it LIKE raw_sales; INSERT INTO m.like_it SELECT * FROM raw_sales WHERE v > 5; DROP TABLE IF EXISTS nothing_there")["m.like_it"]
    assert like.columns == ["id", "k", "v", "dt"] and like.count() == 1


def test_formulas_that_are_refused_are_null_with_a_note(spark):
    df = spark.createDataFrame([(1, "a-b-a", 5.0, datetime.date(2024, 2, 3))], "id int, t string, v double, d date")
    for text in ('=SUBSTITUTE([@t],"a","x",2)', "=WEEKDAY([@d],2)", '=DATEDIF([@d],[@d],"md")', '=TEXT([@v],"0.00")', "=ROUND([@v],[@id])", "=XLOOKUP([@id],o[id],o[t],0,-1)", "=INDEX(o[t],MATCH([@id],o[id],1))", "=NOSUCH([@v])", "=OFFSET([@v],1,0)"):
        book = Workbook({"t": df, "o": df}, {"t": ["id"], "o": ["id"]})
        assert book.add("t", x=text).first().x is None and any("NULL" in n for n in book.notes), text
    book = Workbook({"t": df}, {"t": ["id"]})
    row = book.add("t", a1="=MOD([@v],0)", b1='=IFERROR([@v]/0,"none")', c1="=SQRT(-[@v])", d1='=IF([@v]>1,"much",[@v])', e1='=VALUE("x")', f1="=[@t]=[@v]", g1='=TEXT([@d],"d/m/yyyy")', h1="=ISNUMBER([@t])").first()
    assert tuple(row)[4:] == (None, "none", None, "much", None, False, "3/2/2024", False)


def test_formulas_share_joins(spark):
    right = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "c", 4.0)], "k int, t string, n double")
    book = Workbook({"x": spark.createDataFrame([(1,), (2,), (3,)], "id int"), "r": right}, {"x": ["id"], "r": ["k", "t"]}, first_match=True)
    df = book.add("x", a="=XLOOKUP([@id],r[k],r[t])", b="=XLOOKUP([@id],r[k],r[n])", c="=SUMIFS(r[n],r[k],[@id])", d="=COUNTIFS(r[k],[@id])+1", e="=[@c]/[@d]")
    assert sorted(map(tuple, df.collect())) == [(1, "a", 2.0, 5.0, 3, pytest.approx(5 / 3)), (2, "c", 4.0, 4.0, 2, 2.0), (3, None, None, 0.0, 1, 0.0)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_nested_tables_are_expanded_one_by_one(spark):
    tables = {"a": spark.createDataFrame([(1, 2)], "x int, y int"), "b": spark.createDataFrame([(1, "b")], "x int, s string"), "c": spark.createDataFrame([(2, "c")], "y int, s string")}
    text = 'let A = Table.NestedJoin(a, {"x"}, b, {"x"}, "nb"), B = Table.NestedJoin(A, {"y"}, c, {"y"}, "nc"), R = Table.RenameColumns(B, {{"x", "z"}}), C = Table.ExpandTableColumn(R, "nb", {"s"}, {"from_b"}), D = Table.ExpandTableColumn(C, "nc", {"s"}, {"from_c"}) in D'
    assert PowerQuery(tables).run(text).first().asDict() == {"z": 1, "y": 2, "from_b": "b", "from_c": "c"}
    with pytest.raises(GuardRefused, match="no nested"):
        PowerQuery(tables).run('let A = Table.ExpandTableColumn(a, "nb", {"s"}) in A')
    with pytest.raises(GuardRefused):
        PowerQuery(tables).run('let A = Web.Contents("x"){[Name="a"]}[Content] in A')


def test_batches_of_comparisons(spark, sales):
    out = compare_batch(spark, {"same": (sales, sales), "less": (sales, sales.where("id > 1")), "by": (sales, sales.where("dt = '2024-01-01'"))}, {"by": ["dt"]})
    assert sorted(map(tuple, out.collect())) == [("by", "2024-01-02", 1, 0), ("less", "", 1, 0), ("same", "", 0, 0)]


def test_calculated_items(spark, sales):
    out = Pivot((Field("k"),), (Field("dt"),), (Value("v", "v"),), items={"k": {"rest": "a - b * 2"}}).lower(sales)
    assert sorted(map(tuple, out.collect())) == [("a", "2024-01-01", 12.0), ("b", "2024-01-02", 1.0), ("rest", "2024-01-01", 12.0), ("rest", "2024-01-02", -2.0)]
    with pytest.raises(GuardRefused, match="add up"):
        Pivot((Field("k"),), (), (Value("v", "v", "average"),), items={"k": {"x": "a"}}).lower(sales)


def test_a_workbook_is_checked_with_its_own_values(spark):
    from plumbline.sources.xlsx import Book, SheetTable

    day = datetime.date(2024, 1, 1)
    rows = [[1, 5.0, day, 10.0, "A", 1], [2, None, day, 0.0, "B", 2], [3, 7.0, day, 99.0, "A", 1], [4, 1.0, day, -1.0, "#N/A", 1]]
    runs = SheetTable("runs", ["id", "v", "d", "double", "who", "month"], rows, {"double": "[@v]*factor", "who": "XLOOKUP([@id],people[id],people[name])", "month": "MONTH([@d])"}, {"double": [3]})
    people = SheetTable("people", ["id", "name"], [[1, "A"], [2, "B"], [3, "A"]])
    found = check_workbook(spark, Book({"runs": runs, "people": people}, {"factor": "2"}))
    assert sorted(map(tuple, found.collect())) == [("runs", 1, "month", "2.0", "1.0"), ("runs", 2, "double", "99.0", "14.0")]


def test_sql_is_read_into_checked_statements(spark, sales):
    sales.createOrReplaceTempView("sales")
    tables = {"sales": source}
    for text in (
        "SELECT * FROM sales s WHERE k LIKE 'a%' AND NOT (v <= 5 OR dt IS NULL)", "SELECT k, count(*) AS n, sum(v) AS t, count(DISTINCT id) AS d FROM sales GROUP BY 1 HAVING t > 1 ORDER BY 2 DESC, k LIMIT 3",
        "WITH a AS (SELECT k, max(v) AS v FROM sales GROUP BY k) SELECT a.k, s.id FROM a JOIN sales s ON s.k = a.k AND s.v = a.v", "SELECT k, dt, sum(v) AS v FROM sales GROUP BY ROLLUP (k, dt)", "SELECT id, lag(v) OVER (PARTITION BY k ORDER BY id) AS b, sum(v) OVER (PARTITION BY k ORDER BY id ROWS UNBOUNDED PRECEDING) AS r FROM sales",
        "SELECT k FROM sales UNION SELECT dt FROM sales", "SELECT id, CAST(v AS INT) + 1 AS w, CASE WHEN v > 5 THEN 'x' END AS c FROM sales WHERE id IN (1, 2) AND id NOT IN (2)", "SELECT b.id FROM sales a RIGHT JOIN sales b ON a.id = b.id",
    ):
        q = convert_query(spark, text, tables, many_matches=True)
        assert sorted(map(repr, q.lower({"sales": sales}).collect())) == sorted(map(repr, spark.sql(text).collect())), text
        again = spark.sql(to_sql(q)).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, spark.sql(text).collect())), text
    into = convert_query(spark, "INSERT OVERWRITE TABLE mart.t PARTITION (dt = '2024-01-01') SELECT k, sum(v) AS v FROM sales GROUP BY k", tables)
    assert isinstance(into, Insert) and (into.table, into.overwrite, into.partition, into.query.key) == ("mart.t", True, {"dt": "2024-01-01"}, ("k",))
    assert typed_selected_columns(spark, into.query) == {"k": "string", "v": "double"}
    for text, why in (("SELECT k, v, count(*) AS n FROM sales GROUP BY k", "neither"), ("SELECT x FROM sales", "0 of the tables"), ("SELECT id FROM nowhere", "reference"), ("SELECT k FROM sales ORDER BY k", "sorts everything"), ("SELECT id FROM sales WHERE id IN (SELECT 1)", "subquery"), ("SELECT a.id FROM sales a JOIN sales b USING (id)", "USING")):
        with pytest.raises(GuardRefused, match=why):
            convert_query(spark, text, tables)


def test_statements_render_as_the_sql_they_are(spark, tmp_path):
    import inspect

    from plumbline import fixtures, queries
    from plumbline.plans.statements import Stack, Statement

    catalog = fixtures.catalog(spark, "/root/testdata/sf0.001")
    tables = {n: getattr(fixtures, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    for n in tables:
        catalog(n).createOrReplaceTempView(n)
    found = {n: b for n, q in queries.QUERIES.items() if isinstance(b := inspect.getclosurevars(q).nonlocals.get("build"), Statement | Stack)}
    kinds = [n for n in found if not n.startswith(("fn_", "agg_", "filter_"))] + sorted(n for n in found if n.startswith(("fn_", "agg_", "filter_")))[::6]
    for n in kinds:
        if n in ("scan_first_look", "fn_rand"):
            continue
        rows = sorted(map(repr, found[n].lower(catalog).collect()))
        assert sorted(map(repr, spark.sql(to_sql(found[n])).collect())) == rows, n
        assert sorted(map(repr, convert_query(spark, to_sql(found[n]), tables, many_matches=True, sorts_everything=True).lower(catalog).collect())) == rows, n
    export_sql(spark, by_day, f"file://{tmp_path}/sql")
    assert "GROUP BY" in "\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/sql").collect())


def test_division_by_zero_is_as_the_sql_says_or_an_error(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for name in ("customer", "orders", "events", "nation"):
        con.execute(f"CREATE VIEW raw_{name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    zeros = "CASE c_custkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN '-0.0'::DOUBLE ELSE c_acctbal END"
    totals = "CASE o_orderkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN -o_totalprice ELSE o_totalprice END"
    made = {"customer": f"SELECT * REPLACE ({zeros} AS c_acctbal) FROM raw_customer", "orders": f"SELECT * REPLACE ({totals} AS o_totalprice) FROM raw_orders"}
    for name in ("customer", "orders", "events", "nation"):
        con.execute(f"COPY ({made.get(name, f'SELECT * FROM raw_{name}')}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(f"SELECT o_orderkey, a, b, d, e FROM ({entry.oracle_sql()['xl_shared_joins']}) ORDER BY 1").fetchall()
    got = sorted(map(tuple, entry.queries()["xl_shared_joins"](spark, str(tmp_path)).select("o_orderkey", "a", "b", "d", "e").collect()), key=lambda r: r[0])
    assert list(map(repr, got)) == list(map(repr, want))
    assert {repr(r[4]) for r in want} >= {"inf", "-inf", "nan"}

    df = spark.createDataFrame([(1, 2.0, 0.0), (2, None, 0.0), (3, 6.0, 3.0), (4, 6.0, None)], "id long, x double, y double")
    formulas = {"q": "=[@x]/[@y]", "r": "=IFERROR([@x]/[@y],-1)", "s": "=IFERROR([@x]/[@y],-1)+[@x]/[@y]"}
    rows = [tuple(r)[3:] for r in Workbook({"t": df}, {"t": ["id"]}).add("t", **formulas).orderBy("id").collect()]
    assert rows == [(None, -1.0, None), (None, -1.0, None), (2.0, 2.0, 4.0), (None, -1.0, None)]
    rows = [tuple(r)[3:] for r in Workbook({"t": df}, {"t": ["id"]}, infinite=True).add("t", **formulas).orderBy("id").collect()]
    assert rows == [(float("inf"), -1.0, float("inf")), (None, -1.0, None), (2.0, 2.0, 4.0), (None, -1.0, None)]
