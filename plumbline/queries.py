"""One query for each operator, over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.fixtures import catalog, customer, events, lineitem, nation, orders, part, region, supplier
from plumbline.functions.expressions import (
    all_of, any_of, at_least, at_most, average_of, between, contains, count_distinct, count_rows, dense_rank, descending, equals, fill_null, first_match, first_value, if_else,
    is_in, is_not_in, is_not_null, is_null, is_total, lag, last_n_days, last_value, lead, less_than, literal, mapped, max_of, min_of, month_start, more_than, not_equals, ntile, rank, row_number,
    set_clock, sql_function, starts_with, sum_of, unchecked_column, unchecked_condition, week_start, window,
)
from plumbline.plans.statements import (
    ANTI_JOIN, AS, CROSS_JOIN, EXCEPT, FROM, FULL_JOIN, GROUP_BY, HAVING, INTERSECT, JOIN, LEFT_JOIN, LIMIT, ORDER_BY, RIGHT_JOIN, SELECT, SELECT_DISTINCT, SEMI_JOIN, UNION, UNION_ALL, WHERE, cube, derived, first_look,
    grouping_sets, rollup, run_query, statement, unchecked_derived,
)

from plumbline.errors import Refused
from plumbline.functions.values import date_text, run_value, tag_text, variable
from plumbline.operators.batches import classify, in_order, run_batch, split_statements
from plumbline.operators.lineage import PythonStep, build_run, changes, edges_frame, logic, run_workflow, table_edges
from plumbline.operators.pivots import Field, Pivot, Value
from plumbline.operators.power_query import PowerQuery
from plumbline.operators.sinks import (
    add_columns, check_write, compute_statistics, create_table, drop_partitions, insert_into, insert_overwrite, move_to_own_folder, repair_partitions, seed_copy, set_properties, unchecked_sql,
)
from plumbline.operators.verify import check_workbook, compare_batch, compare_copies, differences, near
from plumbline.operators.workbooks import Workbook
from plumbline.plans.converting import convert_query, typed_selected_columns
from plumbline.plans.rendering import to_sql
from plumbline.sources.shared import new_place
from plumbline.sources.tables import Table, add_references, check_key, check_reference, describe_table, latest_partition, propose_key
from plumbline.sources.xlsx import Book, SheetTable
from plumbline.streaming import overwrite_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, build: Callable) -> None:
    """Registers a statement, or a function of (spark, sf_dir)."""
    if callable(build):
        QUERIES[name] = build
    else:
        QUERIES[name] = lambda spark, sf_dir: build.lower(catalog(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


_revenue = lineitem.l_extendedprice * (1 - lineitem.l_discount)

flagship = statement(
    SELECT(AS(nation.n_name, "nation"), AS(month_start(orders.o_orderdate), "month"), AS(sql_function("round", sum_of(_revenue), 4), "revenue"), AS(count_distinct(orders.o_orderkey), "n_orders")),
    FROM(lineitem), JOIN(orders, ON=equals(lineitem.l_orderkey, orders.o_orderkey)), JOIN(customer, ON=equals(orders.o_custkey, customer.c_custkey)), JOIN(nation, ON=equals(customer.c_nationkey, nation.n_nationkey)),
    GROUP_BY("nation", "month"),
)
query("q_flagship", """SELECT n_name AS nation, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(DISTINCT o_orderkey) AS n_orders
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""", flagship)

# Scans, projections and filters
o, li, c, n, e, p, s = orders, lineitem, customer, nation, events, part, supplier
query("scan_all_columns", "SELECT * FROM nation", statement(SELECT([n[x] for x in n.columns]), FROM(n)))
query("scan_first_look", None, first_look(orders))
query("scan_derived", "SELECT c_nationkey, n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) WHERE n > 2", statement(SELECT((d := derived("d", statement(SELECT(c.c_nationkey, AS(count_rows(), "n")), FROM(c), GROUP_BY(c.c_nationkey)))).c_nationkey, d.n), FROM(d), WHERE(more_than(d.n, 2))))
query("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", statement(SELECT_DISTINCT(o.o_orderstatus, o.o_orderpriority), FROM(o)))
query("arithmetic", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice / nullif(l_quantity - 1, 0) AS a, -l_tax + 1 AS b FROM lineitem", statement(SELECT(li.l_orderkey, li.l_partkey, li.l_suppkey, li.l_linenumber, AS(li.l_extendedprice / (li.l_quantity - 1), "a"), AS(-li.l_tax + 1, "b")), FROM(li)))
for _name, _cond, _sql in (
    ("equals", equals(o.o_orderstatus, "F"), "o_orderstatus = 'F'"), ("not_equals", not_equals(o.o_orderstatus, "F"), "o_orderstatus <> 'F'"), ("at_least", at_least(o.o_totalprice, 200000), "o_totalprice >= 200000"),
    ("at_most", at_most(o.o_totalprice, 50000), "o_totalprice <= 50000"), ("more_than", more_than(o.o_custkey, 100), "o_custkey > 100"), ("less_than", less_than(o.o_orderkey, 500), "o_orderkey < 500"),
    ("between", between(o.o_totalprice, 1000, 90000), "o_totalprice BETWEEN 1000 AND 90000"), ("is_in", is_in(o.o_orderpriority, {"1-URGENT", "2-HIGH"}), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("is_not_in", is_not_in(o.o_orderstatus, ["F", "O"]), "o_orderstatus NOT IN ('F', 'O')"), ("is_not_null", is_not_null(o.o_custkey), "o_custkey IS NOT NULL"), ("contains", contains(o.o_orderpriority, "GH"), "contains(o_orderpriority, 'GH')"),
    ("starts_with", starts_with(o.o_orderpriority, "1"), "starts_with(o_orderpriority, '1')"), ("any_of", any_of(equals(o.o_orderstatus, "F"), less_than(o.o_totalprice, 5000)), "o_orderstatus = 'F' OR o_totalprice < 5000"),
    ("all_of", any_of(all_of(equals(o.o_orderstatus, "F"), less_than(o.o_totalprice, 90000)), equals(o.o_custkey, 7)), "(o_orderstatus = 'F' AND o_totalprice < 90000) OR o_custkey = 7"),
    ("date", at_least(o.o_orderdate, datetime.datetime(1998, 6, 1)), "o_orderdate >= TIMESTAMP '1998-06-01'"), ("unchecked", unchecked_condition("pmod({k}, 3) = 1", k=o.o_orderkey), "o_orderkey % 3 = 1"),
):
    query(f"filter_{_name}", f"SELECT o_orderkey, o_custkey FROM orders WHERE {_sql}", statement(SELECT(o.o_orderkey, o.o_custkey), FROM(o), WHERE(_cond)))
query("filter_is_null", "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL", statement(SELECT(o.o_orderkey), FROM(o), LEFT_JOIN(li, ON=equals(li.l_orderkey, o.o_orderkey), many_matches=True), WHERE(is_null(li.l_orderkey))))


def _last_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_clock(lambda: datetime.datetime(2024, 1, 31, tzinfo=datetime.UTC))
    try:
        return statement(SELECT(e.event_id, e.user_id), FROM(e), WHERE(last_n_days(e.ts, 7))).lower(catalog(spark, sf_dir))
    finally:
        set_clock(None)


query("filter_last_n_days", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'", _last_days)

# Joins
query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", statement(SELECT(o.o_orderkey, c.c_name), FROM(o), JOIN(c, ON=equals(o.o_custkey, c.c_custkey))))
query("join_broadcast", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", statement(SELECT(c.c_custkey, n.n_name), FROM(c), JOIN(n, ON=equals(c.c_nationkey, n.n_nationkey), broadcast=True)))
query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", statement(SELECT(c.c_custkey, AS(count_rows(where=is_not_null(o.o_orderkey)), "n")), FROM(c), LEFT_JOIN(o, ON=equals(c.c_custkey, o.o_custkey), many_matches=True), GROUP_BY(c.c_custkey)))
_busy = derived("busy", statement(SELECT(o.o_custkey, AS(count_rows(), "n")), FROM(o), WHERE(equals(o.o_orderstatus, "F")), GROUP_BY(o.o_custkey)))
_rich = derived("rich", statement(SELECT(c.c_custkey, c.c_acctbal), FROM(c), WHERE(more_than(c.c_acctbal, 5000))))
query("join_full", "SELECT o_custkey, c_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey", statement(SELECT(_busy.o_custkey, _rich.c_custkey, _busy.n), FROM(_busy), FULL_JOIN(_rich, ON=equals(_busy.o_custkey, _rich.c_custkey))))
query("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", statement(SELECT(n.n_name, region.r_name), FROM(n), CROSS_JOIN(region)))
query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", statement(SELECT(c.c_custkey), FROM(c), SEMI_JOIN(o, ON=all_of(equals(o.o_custkey, c.c_custkey), more_than(o.o_totalprice, 200000)))))
query("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", statement(SELECT(o.o_orderkey), FROM(o), ANTI_JOIN(li, ON=equals(li.l_orderkey, o.o_orderkey))))
query("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", statement(SELECT(AS(n.n_name, "a"), AS((n2 := AS(n, "n2")).n_name, "b")), FROM(n), JOIN(n2, ON=all_of(equals(n.n_regionkey, n2.n_regionkey), less_than(n.n_nationkey, n2.n_nationkey)), many_matches=True)))
query("join_self", "SELECT a.s_suppkey, b.s_name FROM supplier a JOIN supplier b ON a.s_suppkey = b.s_suppkey", statement(SELECT(s.s_suppkey, (s2 := AS(s, "s2")).s_name), FROM(s), JOIN(s2, ON=equals(s.s_suppkey, s2.s_suppkey))))

# Aggregates
query("agg_all", "SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS st, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1",
      statement(SELECT(o.o_custkey, AS(count_rows(), "n"), AS(count_distinct(o.o_orderstatus), "st"), AS(sql_function("round", sum_of(o.o_totalprice), 2), "total"), AS(sql_function("round", average_of(o.o_totalprice), 4), "mean"), AS(min_of(o.o_orderdate), "first"), AS(max_of(o.o_orderdate), "last")), FROM(o), GROUP_BY(o.o_custkey)))
query("agg_where", "SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS n, round(sum(l_quantity) FILTER (l_tax > 0.04), 2) AS q FROM lineitem GROUP BY 1", statement(SELECT(li.l_returnflag, AS(count_rows(where=more_than(li.l_discount, 0.05)), "n"), AS(sql_function("round", sum_of(li.l_quantity, where=more_than(li.l_tax, 0.04)), 2), "q")), FROM(li), GROUP_BY(li.l_returnflag)))
query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 500000", statement(SELECT(o.o_custkey, AS(count_rows(), "n")), FROM(o), GROUP_BY(o.o_custkey), HAVING(more_than(sum_of(o.o_totalprice), 500000))))
query("agg_total", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem", statement(SELECT(AS(count_rows(), "n"), AS(sql_function("round", sum_of(li.l_extendedprice), 2), "total")), FROM(li)))
for _f, _sql in (("variance", "var_pop"), ("var_samp", "var_samp"), ("stddev_pop", "stddev_pop"), ("stddev_samp", "stddev_samp"), ("median", "median")):
    query(f"agg_{_f}", f"SELECT c_nationkey, round({_sql}(c_acctbal), 6) AS v FROM customer GROUP BY 1", statement(SELECT(c.c_nationkey, AS(sql_function("round", sql_function(_f, c.c_acctbal), 6), "v")), FROM(c), GROUP_BY(c.c_nationkey)))
_sub = (AS(count_rows(), "n"), AS(is_total(o.o_orderpriority), "all_priorities"), AS(is_total(o.o_orderstatus), "all_status"))
for _f, _sets, _sql in (("rollup", rollup(o.o_orderstatus, o.o_orderpriority), "ROLLUP (o_orderstatus, o_orderpriority)"), ("cube", cube(o.o_orderstatus, o.o_orderpriority), "CUBE (o_orderstatus, o_orderpriority)"), ("grouping_sets", grouping_sets([o.o_orderstatus], [o.o_orderpriority], []), "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")):
    query(f"sub_{_f}", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) = 1 AS all_priorities, grouping(o_orderstatus) = 1 AS all_status FROM orders GROUP BY {_sql}", statement(SELECT(o.o_orderstatus, o.o_orderpriority, *_sub), FROM(o), GROUP_BY(_sets)))
query("sub_plain_and_rollup", "SELECT o_orderstatus, o_orderpriority, o_custkey % 2 AS odd, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_custkey % 2, o_orderstatus, o_orderpriority), (o_custkey % 2, o_orderstatus), (o_custkey % 2))", statement(SELECT(o.o_orderstatus, o.o_orderpriority, AS(_odd := sql_function("pmod", o.o_custkey, 2), "odd"), AS(count_rows(), "n")), FROM(o), GROUP_BY(_odd, rollup(o.o_orderstatus, o.o_orderpriority))))

# Windows
_w = window(PARTITION_BY=o.o_custkey, ORDER_BY=[descending(o.o_totalprice), o.o_orderkey])
_ws = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
for _f, _x, _sql in (
    ("row_number", row_number(over=_w), f"row_number() {_ws}"), ("rank", rank(over=window(o.o_orderstatus, o.o_orderpriority)), "rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)"),
    ("dense_rank", dense_rank(over=window(o.o_orderstatus, o.o_orderpriority)), "dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)"), ("ntile", ntile(4, over=_w), f"ntile(4) {_ws}"),
    ("lag", lag(o.o_totalprice, over=_w), f"lag(o_totalprice) {_ws}"), ("lead", lead(o.o_totalprice, over=_w, ahead=2), f"lead(o_totalprice, 2) {_ws}"),
    ("first_value", first_value(o.o_orderkey, over=_w), f"first_value(o_orderkey) {_ws}"), ("last_value", last_value(o.o_orderkey, over=_w), "last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("running", sql_function("round", sum_of(o.o_totalprice, over=window(o.o_custkey, o.o_orderkey, rows=(None, 0))), 2), "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2)"),
    ("moving", sql_function("round", average_of(o.o_totalprice, over=window(o.o_custkey, o.o_orderkey, rows=(-2, 0))), 4), "round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING), 4)"),
    ("whole", count_rows(over=window(o.o_custkey)), "count(*) OVER (PARTITION BY o_custkey)"),
):
    query(f"win_{_f}", f"SELECT o_orderkey, {_sql} AS v FROM orders", statement(SELECT(o.o_orderkey, AS(_x, "v")), FROM(o)))
_per = derived("per", statement(SELECT(o.o_custkey, o.o_orderstatus, AS(count_rows(), "n")), FROM(o), GROUP_BY(o.o_custkey, o.o_orderstatus)))
query("win_over_aggregates", "SELECT o_custkey, o_orderstatus, n, sum(n) OVER (PARTITION BY o_custkey) AS all_n FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)", statement(SELECT(_per.o_custkey, _per.o_orderstatus, _per.n, AS(sum_of(_per.n, over=window(_per.o_custkey)), "all_n")), FROM(_per)))
_numbered = derived("numbered", statement(SELECT(o.o_custkey, o.o_orderkey, o.o_totalprice, AS(row_number(over=_w), "place")), FROM(o)))
query("topn_per_group", f"SELECT o_custkey, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() {_ws} AS place FROM orders) WHERE place <= 3", statement(SELECT([_numbered[x] for x in _numbered.columns]), FROM(_numbered), WHERE(at_most(_numbered.place, 3))))
query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", statement(SELECT(o.o_orderkey, o.o_totalprice), FROM(o), ORDER_BY(descending("o_totalprice"), o.o_orderkey), LIMIT(50)))
query("sort_all", "SELECT c_custkey, c_acctbal FROM customer", statement(SELECT(c.c_custkey, c.c_acctbal), FROM(c), ORDER_BY("c_acctbal", sorts_everything=True)))

# Set operations
_f1, _f2 = statement(SELECT(AS(o.o_custkey, "k")), FROM(o), WHERE(equals(o.o_orderstatus, "F"))), statement(SELECT(AS(c.c_custkey, "k")), FROM(c), WHERE(more_than(c.c_acctbal, 3000)))
for _f, _make in (("UNION ALL", UNION_ALL), ("UNION", UNION), ("INTERSECT", INTERSECT), ("EXCEPT", EXCEPT)):
    query(f"set_{_f.lower().replace(' ', '_')}", f"SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' {_f} SELECT c_custkey AS k FROM customer WHERE c_acctbal > 3000", _make(_f1, _f2))

# Scalar calculations
for _f, _x, _sql in (
    ("if_else", if_else(more_than(o.o_totalprice, 100000), "big", "small"), "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END"),
    ("first_match", first_match([(less_than(o.o_totalprice, 1000), 1), (less_than(o.o_totalprice, 100000), 2)]), "CASE WHEN o_totalprice < 1000 THEN 1 WHEN o_totalprice < 100000 THEN 2 END"),
    ("mapped", mapped(o.o_orderstatus, {"F": "done", "O": "open"}, "other"), "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END"),
    ("fill_null", fill_null(sql_function("nullif", o.o_orderstatus, "F"), "-"), "coalesce(nullif(o_orderstatus, 'F'), '-')"),
    ("week_start", week_start(o.o_orderdate), "strftime(date_trunc('week', o_orderdate), '%Y-%m-%d')"), ("month_start", month_start(o.o_orderdate), "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"),
    ("unchecked", unchecked_column("concat({a}, '/', {b})", a=o.o_orderstatus, b=o.o_orderpriority), "o_orderstatus || '/' || o_orderpriority"),
):
    query(f"calc_{_f}", f"SELECT o_orderkey, {_sql} AS v FROM orders", statement(SELECT(o.o_orderkey, AS(_x, "v")), FROM(o)))
_t, _d, _k = o.o_orderpriority, o.o_orderdate, o.o_totalprice
for _f, _args, _sql in (
    ("upper", (_t,), "upper(o_orderpriority)"), ("lower", (_t,), "lower(o_orderpriority)"), ("trim", (_t,), "trim(o_orderpriority)"), ("ltrim", (_t,), "ltrim(o_orderpriority)"), ("rtrim", (_t,), "rtrim(o_orderpriority)"),
    ("length", (_t,), "length(o_orderpriority)"), ("concat", (_t, "-", o.o_orderstatus), "o_orderpriority || '-' || o_orderstatus"), ("concat_ws", ("+", _t, o.o_orderstatus), "concat_ws('+', o_orderpriority, o_orderstatus)"),
    ("substr", (_t, 2, 3), "substr(o_orderpriority, 2, 3)"), ("substring", (_t, 3), "substr(o_orderpriority, 3)"), ("instr", (_t, "I"), "instr(o_orderpriority, 'I')"), ("locate", ("H", _t), "instr(o_orderpriority, 'H')"),
    ("lpad", (_t, 12, "*"), "lpad(o_orderpriority, 12, '*')"), ("rpad", (_t, 12, "*"), "rpad(o_orderpriority, 12, '*')"), ("regexp_extract", (_t, "([A-Z]+)", 1), "regexp_extract(o_orderpriority, '([A-Z]+)', 1)"),
    ("regexp_replace", (_t, "[0-9]", "#"), "regexp_replace(o_orderpriority, '[0-9]', '#', 'g')"), ("rlike", (_t, "^[12]"), "regexp_matches(o_orderpriority, '^[12]')"), ("translate", (_t, "HI", "hi"), "translate(o_orderpriority, 'HI', 'hi')"),
    ("reverse", (_t,), "reverse(o_orderpriority)"), ("repeat", (o.o_orderstatus, 3), "repeat(o_orderstatus, 3)"), ("ascii", (_t,), "ascii(o_orderpriority)"), ("md5", (_t,), "md5(o_orderpriority)"), ("sha2", (_t, 256), "sha256(o_orderpriority)"),
    ("base64", (sql_function("unhex", sql_function("hex", _t)),), "base64(o_orderpriority::BLOB)"), ("get_json_object", (sql_function("concat", '{"k": "', _t, '"}'), "$.k"), "o_orderpriority"), ("nvl", (sql_function("nullif", o.o_orderstatus, "F"), "x"), "coalesce(nullif(o_orderstatus, 'F'), 'x')"),
    ("coalesce", (sql_function("nullif", o.o_orderstatus, "F"), "x"), "coalesce(nullif(o_orderstatus, 'F'), 'x')"), ("nullif", (o.o_orderstatus, "F"), "nullif(o_orderstatus, 'F')"), ("greatest", (_k, 50000.0), "greatest(o_totalprice, 50000.0)"),
    ("least", (_k, 50000.0), "least(o_totalprice, 50000.0)"), ("date_format", (_d, "yyyy-MM"), "strftime(o_orderdate, '%Y-%m')"), ("datediff", (_d, "1995-01-01"), "date_diff('day', DATE '1995-01-01', o_orderdate::DATE)"),
    ("date_add", (sql_function("to_date", _d), 10), "(o_orderdate::DATE + 10)"), ("date_sub", (sql_function("to_date", _d), 10), "(o_orderdate::DATE - 10)"), ("add_months", (sql_function("to_date", _d), 2), "strftime(o_orderdate::DATE + INTERVAL 2 MONTH, '%Y-%m-%d')"),
    ("last_day", (_d,), "strftime(last_day(o_orderdate), '%Y-%m-%d')"), ("to_date", (_d,), "o_orderdate::DATE"), ("trunc", (sql_function("to_date", _d), "YY"), "strftime(date_trunc('year', o_orderdate), '%Y-%m-%d')"),
    ("next_day", (sql_function("to_date", _d), "MO"), "strftime(date_trunc('week', o_orderdate) + INTERVAL 7 DAY, '%Y-%m-%d')"), ("date_trunc", ("MONTH", _d), "date_trunc('month', o_orderdate)::TIMESTAMP"),
    ("year", (_d,), "year(o_orderdate)"), ("quarter", (_d,), "quarter(o_orderdate)"), ("month", (_d,), "month(o_orderdate)"), ("weekofyear", (_d,), "weekofyear(o_orderdate)"), ("day", (_d,), "day(o_orderdate)"), ("dayofmonth", (_d,), "day(o_orderdate)"),
    ("hour", (_d,), "hour(o_orderdate)"), ("minute", (_d,), "minute(o_orderdate)"), ("second", (_d,), "second(o_orderdate)"), ("abs", (-_k,), "abs(-o_totalprice)"), ("round", (_k, 1), "round(o_totalprice, 1)"), ("bround", (sql_function("floor", _k) / 10,), "round_even(floor(o_totalprice) / 10, 0)"),
    ("floor", (_k,), "floor(o_totalprice)"), ("ceil", (_k,), "ceil(o_totalprice)"), ("ceiling", (_k,), "ceil(o_totalprice)"), ("sqrt", (_k,), "sqrt(o_totalprice)"), ("exp", (_k / 100000,), "exp(o_totalprice / 100000)"), ("ln", (_k,), "ln(o_totalprice)"), ("log", (2, _k), "ln(o_totalprice) / ln(2)"),
    ("log10", (_k,), "log10(o_totalprice)"), ("log2", (_k,), "log2(o_totalprice)"), ("pow", (_k, 2), "pow(o_totalprice, 2)"), ("power", (_k, 0.5), "pow(o_totalprice, 0.5)"), ("pmod", (-o.o_custkey, 7), "((-o_custkey % 7) + 7) % 7"), ("sign", (_k - 100000,), "sign(o_totalprice - 100000)"),
    ("negative", (_k,), "-o_totalprice"), ("positive", (_k,), "o_totalprice"), ("hex", (o.o_orderkey,), "upper(to_hex(o_orderkey))"), ("size", (sql_function("split", _t, "-"),), "len(string_split(o_orderpriority, '-'))"),
    ("array_contains", (sql_function("split", _t, "-"), "HIGH"), "list_contains(string_split(o_orderpriority, '-'), 'HIGH')"), ("space", (sql_function("length", _t),), "repeat(' ', length(o_orderpriority))"), ("format_number", (sql_function("floor", _k), 0), "format('{:,}', floor(o_totalprice)::BIGINT)"),
    ("months_between", (sql_function("to_date", _d), "1995-01-31"), "round((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 + CASE WHEN o_orderdate::DATE = last_day(o_orderdate) OR day(o_orderdate) = 31 THEN 0 ELSE (day(o_orderdate) - 31) / 31.0 END, 8)"),
    ("initcap", (_t,), "array_to_string(list_transform(string_split(lower(o_orderpriority), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"), ("hash", (_t,), None), ("split", (_t, "-"), "string_split(o_orderpriority, '-')"),
    ("sort_array", (sql_function("split", _t, ""),), "list_sort(regexp_extract_all(o_orderpriority, '.'))"), ("unhex", (sql_function("hex", _t),), "o_orderpriority::BLOB"), ("unbase64", (sql_function("base64", sql_function("unhex", sql_function("hex", _t))),), "o_orderpriority::BLOB"),
    ("element_at", (sql_function("str_to_map", sql_function("concat", "s:", o.o_orderstatus, ",p:", _t), ",", ":"), "p"), "o_orderpriority"), ("rand_below_one", (), "true"), ("from_unixtime", (o.o_orderkey,), "strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%d %H:%M:%S')"),
):
    if _f == "rand_below_one":
        query("fn_rand", "SELECT o_orderkey, true AS v FROM orders", statement(SELECT(o.o_orderkey, AS(less_than(sql_function("rand", 7), 1.0), "v")), FROM(o)))
        continue
    query(f"fn_{'str_to_map' if _f == 'element_at' else _f}", _sql and f"SELECT o_orderkey, {_sql} AS v FROM orders", statement(SELECT(o.o_orderkey, AS(sql_function(_f, *_args), "v")), FROM(o)))
query("fn_if", "SELECT o_orderkey, CASE WHEN o_custkey > 50 THEN 1 ELSE 0 END AS v FROM orders", statement(SELECT(o.o_orderkey, AS(sql_function("if", more_than(o.o_custkey, 50).expr, 1, 0), "v")), FROM(o)))
for _f, _args, _sql in (("corr", (c.c_acctbal, c.c_custkey), "corr(c_acctbal, c_custkey)"), ("covar_pop", (c.c_acctbal, c.c_custkey), "covar_pop(c_acctbal, c_custkey)"), ("covar_samp", (c.c_acctbal, c.c_custkey), "covar_samp(c_acctbal, c_custkey)"), ("max_by", (c.c_custkey, c.c_acctbal), "max_by(c_custkey, c_acctbal)"), ("min_by", (c.c_custkey, c.c_acctbal), "min_by(c_custkey, c_acctbal)"), ("percentile", (c.c_acctbal, 0.5), "quantile_cont(c_acctbal, 0.5)"), ("count_if", (more_than(c.c_acctbal, 0).expr,), "count_if(c_acctbal > 0)"), ("bool_and", (more_than(c.c_acctbal, -900).expr,), "bool_and(c_acctbal > -900)"), ("bool_or", (more_than(c.c_acctbal, 9900).expr,), "bool_or(c_acctbal > 9900)")):
    _v = sql_function(_f, *_args)
    query(f"agg_{_f}", f"SELECT c_nationkey, {_sql if _f.startswith(('bool', 'count', 'max', 'min')) else f'round({_sql}, 6)'} AS v FROM customer GROUP BY 1", statement(SELECT(c.c_nationkey, AS(_v if _f.startswith(("bool", "count", "max", "min")) else sql_function("round", _v, 6), "v")), FROM(c), GROUP_BY(c.c_nationkey)))

for _f, _args, _sql in (
    ("any", (more_than(c.c_acctbal, 9000).expr,), "bool_or(c_acctbal > 9000)"), ("some", (more_than(c.c_acctbal, 9500).expr,), "bool_or(c_acctbal > 9500)"), ("every", (more_than(c.c_acctbal, -900).expr,), "bool_and(c_acctbal > -900)"),
    ("count", (c.c_mktsegment,), "count(c_mktsegment)"), ("max", (c.c_acctbal,), "max(c_acctbal)"), ("min", (c.c_acctbal,), "min(c_acctbal)"), ("sum", (c.c_custkey,), "sum(c_custkey)"), ("collect_list", (c.c_custkey,), "list(c_custkey)"), ("collect_set", (c.c_mktsegment,), "list(DISTINCT c_mktsegment)"),
    ("percentile_approx", (c.c_acctbal, 0.5, 100_000), "quantile_disc(c_acctbal, 0.5)"), ("histogram_numeric", (c.c_custkey, 3), "least(3, count(DISTINCT c_custkey))"), ("kll_sketch_agg_bigint", (c.c_custkey,), "count(c_custkey)"), ("theta_sketch_agg", (c.c_mktsegment,), "count(DISTINCT c_mktsegment)"),
):
    _v = sql_function(_f, *_args)
    _v, _sql = {"collect_list": (sql_function("sort_array", _v), f"list_sort({_sql})"), "collect_set": (sql_function("sort_array", _v), f"list_sort({_sql})"), "histogram_numeric": (sql_function("size", _v), _sql), "kll_sketch_agg_bigint": (sql_function("kll_sketch_get_n_bigint", _v), _sql), "theta_sketch_agg": (sql_function("theta_sketch_estimate", _v), _sql)}.get(_f, (_v, _sql))
    query(f"agg_{_f}", f"SELECT c_nationkey, {_sql} AS v FROM customer GROUP BY 1", statement(SELECT(c.c_nationkey, AS(_v, "v")), FROM(c), GROUP_BY(c.c_nationkey)))
for _f, _sql in (("avg", "avg"), ("stddev", "stddev_samp"), ("var_pop", "var_pop")):
    query(f"agg_{_f}_named", f"SELECT c_nationkey, round({_sql}(c_acctbal), 6) AS v FROM customer GROUP BY 1", statement(SELECT(c.c_nationkey, AS(sql_function("round", sql_function(_f, c.c_acctbal), 6), "v")), FROM(c), GROUP_BY(c.c_nationkey)))

# Named functions over windows' ranges, verification and upkeep


def _frame(sf_dir: str, spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(name: str, sql: str | None, use: Callable[[Callable[[str], DataFrame], SparkSession], DataFrame]) -> None:
    query(name, sql, lambda spark, sf_dir: use(lambda t: _frame(sf_dir, spark, t), spark))


_on("verify_bag_difference", "SELECT o_orderstatus, count(*) FILTER (o_totalprice <= 100000) - count(*) FILTER (o_custkey % 2 = 0) AS extra FROM orders GROUP BY 1 HAVING extra <> 0",
    lambda t, _: differences(t("orders").where("o_totalprice <= 100000").select("o_orderstatus"), t("orders").where("o_custkey % 2 = 0").select("o_orderstatus")))
_on("verify_check_key", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY copies DESC, 1, 2 LIMIT 20", lambda t, _: check_key(t("lineitem"), ["l_orderkey", "l_linenumber"]))
_on("verify_copies", "SELECT coalesce(a.s, b.s) AS o_orderstatus, original, copied FROM (SELECT o_orderstatus AS s, count(*) AS original FROM orders GROUP BY 1) a FULL JOIN (SELECT o_orderstatus AS s, count(*) AS copied FROM orders WHERE o_orderkey > 10 GROUP BY 1) b ON a.s = b.s WHERE original IS DISTINCT FROM copied",
    lambda t, _: compare_copies(t("orders"), t("orders").where("o_orderkey > 10"), ["o_orderstatus"]))
_on("verify_cells", "SELECT c_custkey, 'c_mktsegment' AS \"column\", c_mktsegment AS \"left\", 'OTHER' AS \"right\" FROM customer WHERE c_custkey % 100 = 3 UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, (c_nationkey + 1)::VARCHAR FROM customer WHERE c_custkey % 100 = 7",
    lambda t, _: near(t("customer").drop("c_name"), t("customer").selectExpr("c_custkey", "if(c_custkey % 100 = 7, c_nationkey + 1, c_nationkey) AS c_nationkey", "c_acctbal * (1 + 1e-12) AS c_acctbal", "if(c_custkey % 100 = 3, 'OTHER', c_mktsegment) AS c_mktsegment"), ["c_custkey"]))
_on("verify_compare_batch", "SELECT 'orders' AS name, o_orderstatus AS \"partition\", count(*) AS only_left, 0 AS only_right FROM orders WHERE o_orderkey % 50 = 1 GROUP BY 2 UNION ALL SELECT 'nation', '', 0, 0",
    lambda t, spark: compare_batch(spark, {"orders": (t("orders"), t("orders").where("o_orderkey % 50 <> 1")), "nation": (t("nation"), t("nation"))}, {"orders": ["o_orderstatus"]}))
_on("sql_batch", "SELECT n_name, n FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1) ON n_nationkey = c_nationkey", lambda t, spark: _batch(t, spark))
_on("sql_lateral_view", "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS word FROM orders", lambda t, spark: (t("orders").createOrReplaceTempView("raw_orders"), spark.sql("SELECT o_orderkey, word FROM raw_orders LATERAL VIEW explode(split(o_orderpriority, '-')) x AS word"))[1])
_on("lineage_edges", """SELECT source, target, how FROM (VALUES ('nation.n_name', 'flagship.nation', 'value'), ('orders.o_orderdate', 'flagship.month', 'value'), ('lineitem.l_extendedprice', 'flagship.revenue', 'value'), ('lineitem.l_discount', 'flagship.revenue', 'value'), ('orders.o_orderkey', 'flagship.n_orders', 'value'),
    ('lineitem.l_orderkey', 'flagship.*', 'rows'), ('orders.o_orderkey', 'flagship.*', 'rows'), ('orders.o_custkey', 'flagship.*', 'rows'), ('customer.c_custkey', 'flagship.*', 'rows'), ('customer.c_nationkey', 'flagship.*', 'rows'), ('nation.n_nationkey', 'flagship.*', 'rows'), ('nation.n_name', 'flagship.*', 'rows'), ('orders.o_orderdate', 'flagship.*', 'rows')) AS e(source, target, how)""", lambda _, spark: edges_frame(spark, {"flagship": flagship}))


def _batch(t: Callable[[str], DataFrame], spark: SparkSession) -> DataFrame:
    for name in ("customer", "nation"):
        t(name).createOrReplaceTempView(f"raw_{name}")
    script = """INSERT OVERWRITE TABLE mart.final SELECT n_name, n FROM raw_nation JOIN staged ON n_nationkey = c_nationkey; -- reads; first
        CREATE TEMPORARY TABLE staged AS SELECT c_nationkey, count(*) AS n FROM raw_customer WHERE c_acctbal > <PARM="LEAST"/> GROUP BY c_nationkey"""
    return run_batch(spark, script, {"LEAST": 100})["mart.final"]


def _script(t: Callable[[str], DataFrame], spark: SparkSession, text: str, table: str) -> DataFrame:
    for name in ("orders", "customer", "nation"):
        t(name).createOrReplaceTempView(f"raw_{name}")
    return run_batch(spark, text)[table]


_on("sql_insert_partition", "SELECT o_orderkey AS k, o_totalprice AS v, 'F' AS st FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT -1, 0.5, 'new'",
    lambda t, spark: _script(t, spark, """CREATE TABLE mart.parts (k BIGINT, v DOUBLE) PARTITIONED BY (st STRING) STORED AS PARQUET;
        INSERT INTO mart.parts (st, k) SELECT o_orderstatus, o_orderkey FROM raw_orders;
        INSERT OVERWRITE TABLE mart.parts PARTITION (st = 'F') SELECT o_orderkey, o_totalprice FROM raw_orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000;
        INSERT OVERWRITE TABLE mart.parts PARTITION (st) VALUES (-1, 0.5D, 'new')""", "mart.parts"))  # fmt: skip
_on("sql_multi_insert", "SELECT o_custkey, count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    lambda t, spark: _script(t, spark, """FROM raw_orders INSERT OVERWRITE TABLE a.big SELECT o_orderkey WHERE o_totalprice > 100000
        INSERT OVERWRITE TABLE b.big SELECT o_custkey, count(*) AS n, sum(o_orderkey) AS s WHERE o_orderstatus = 'F' GROUP BY o_custkey""", "b.big"))  # fmt: skip
_on("sql_qualified_ctas", "SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY 1",
    lambda t, spark: _script(t, spark, """CREATE TABLE x.t AS SELECT n_nationkey, n_name FROM raw_nation; CREATE TABLE y.t AS SELECT c_nationkey FROM raw_customer WHERE c_acctbal > 0;
        CREATE TABLE z.out AS SELECT t.n_name, count(*) AS n FROM x.t JOIN y.t AS u ON t.n_nationkey = u.c_nationkey GROUP BY t.n_name; DROP TABLE x.t""", "z.out"))  # fmt: skip
_CONVERTED = """WITH busy AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done FROM orders GROUP BY o_custkey HAVING count(*) > 2)
    SELECT c.c_custkey, busy.n, busy.done, rank() OVER (PARTITION BY c.c_nationkey ORDER BY busy.n DESC) AS place FROM customer c LEFT JOIN busy ON busy.o_custkey = c.c_custkey AND NOT (busy.n <= 3 OR busy.done IS NULL) WHERE c.c_custkey BETWEEN 5 AND 500 OR c.c_mktsegment LIKE 'B%'"""
_on("sql_converted", _CONVERTED.replace("DESC) AS place", "DESC NULLS LAST) AS place"), lambda t, spark: convert_query(spark, _CONVERTED, {"orders": o, "customer": c}).lower(t))
_on("sql_rendered", "SELECT n_name AS nation, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    lambda t, spark: ([t(n).createOrReplaceTempView(n) for n in ("lineitem", "orders", "customer", "nation")], spark.sql(to_sql(flagship)))[1])

# Writes: to a place of their own in the shared folder, read back


def _written(name: str, sql: str, write: Callable[[Table, Callable[[str], DataFrame], SparkSession], None]) -> None:
    def run(t: Callable[[str], DataFrame], spark: SparkSession) -> DataFrame:
        place = Table(f"mart.{name}", {"k": "bigint", "v": "double", "st": "string"}, partitioned_by=["st"], key=["k"], location=new_place(spark, name))
        write(place, t, spark)
        return spark.read.schema("k bigint, v double, st string").parquet(place.location)

    _on(f"sink_{name}", sql, run)


_sale = statement(SELECT(AS(o.o_orderkey, "k"), AS(o.o_totalprice, "v"), AS(o.o_orderstatus, "st")), FROM(o))
_half = statement(SELECT(AS(o.o_orderkey, "k"), AS(o.o_totalprice / 2, "v"), AS(o.o_orderstatus, "st")), FROM(o), WHERE(equals(o.o_orderstatus, "F")))
_none = statement(SELECT(AS(o.o_orderkey, "k"), AS(o.o_totalprice, "v")), FROM(o), WHERE(more_than(o.o_totalprice, 1e12)))
_written("overwrite", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN o_totalprice / 2 ELSE o_totalprice END AS v, o_orderstatus AS st FROM orders", lambda p, t, _: (insert_overwrite(p, _sale, t), insert_overwrite(p, _half, t), insert_overwrite(p, _half, t)))
_written("append", "SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS st FROM orders UNION ALL SELECT o_orderkey, o_totalprice / 2, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", lambda p, t, _: (insert_overwrite(p, _sale, t), insert_into(p, _half, t)))
_written("static_partition", "SELECT o_orderkey AS k, o_totalprice * 2 AS v, o_orderstatus AS st FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'P'", lambda p, t, spark: _static(p, t, spark))
_written("seed_copy", "SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS st FROM orders WHERE o_orderkey BETWEEN 10 AND 5000 AND o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000", lambda p, t, _: seed_copy(p, _sale.lower(t), {"k": {"from": 10, "to": 5000}, "st": ["F", "O"], "v": 1000}))


def _static(p: Table, t: Callable[[str], DataFrame], spark: SparkSession) -> None:
    """A partition that is overwritten from itself, and one that no row fills any more."""
    insert_overwrite(p, _sale, t)
    own = statement(SELECT(p.k, AS(p.v * 2, "v")), FROM(p), WHERE(equals(p.st, "F")))
    insert_overwrite(p, own, lambda _: spark.read.schema("k bigint, v double, st string").parquet(p.location), partition={"st": "F"})
    insert_overwrite(p, _none, t, partition={"st": "O"})


# Tables of the catalog, under names that nothing else has

_PARTS_SQL = "SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS st FROM orders"


def _kept(name: str, sql: str, use: Callable[[Table, SparkSession], DataFrame]) -> None:
    """Orders by status as a table of the catalog, and what comes of it."""

    def run(t: Callable[[str], DataFrame], spark: SparkSession) -> DataFrame:
        place = new_place(spark, name)
        kept = Table(f"kept_{place[-32:]}", {"k": "bigint", "v": "double", "st": "string"}, partitioned_by=["st"], key=["k"], location=place, descriptions={"v": "an order's total"}, properties={"keeper": "o'neil"})
        create_table(spark, kept)
        insert_overwrite(kept, _sale, t)
        repair_partitions(spark, kept)
        return use(kept, spark)

    _on(name, sql, run)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _moved(p: Table, spark: SparkSession) -> DataFrame:
    own = Table(p.name, p.columns, partitioned_by=p.partitioned_by, location=new_place(spark, "own"))
    move_to_own_folder(spark, p.name, own)
    return spark.read.schema("k bigint, v double, st string").parquet(own.location)


_kept("admin_create_and_repair", _PARTS_SQL, lambda p, spark: spark.table(p.name))
_kept("admin_drop_partitions", f"{_PARTS_SQL} WHERE o_orderstatus <> 'F'", lambda p, spark: (drop_partitions(spark, p, lambda r: r["st"] == "F"), spark.table(p.name))[1])
_kept("admin_add_columns", "SELECT o_orderkey AS k, o_totalprice AS v, NULL::DOUBLE AS w, o_orderstatus AS st FROM orders", lambda p, spark: (add_columns(spark, Table(p.name, {"k": "bigint", "v": "double", "w": "double", "st": "string"})), spark.table(p.name))[1])
_kept("admin_statistics", "SELECT count(*) AS n FROM orders", lambda p, spark: (compute_statistics(spark, p), spark.sql(f"DESCRIBE TABLE EXTENDED {p.name}").where("col_name = 'Statistics'").selectExpr("CAST(regexp_extract(data_type, '([0-9]+) rows', 1) AS BIGINT) AS n"))[1])
_kept("admin_properties", "SELECT * FROM (VALUES ('keeper', 'o''neil'), ('note', 'it''s')) t(key, value)", lambda p, spark: (set_properties(spark, Table(p.name, p.columns, properties={"note": "it's"})), spark.sql(f"SHOW TBLPROPERTIES {p.name}").where("key IN ('keeper', 'note')"))[1])
_kept("admin_move_to_own_folder", _PARTS_SQL, _moved)
_kept("source_latest_partition", f"{_PARTS_SQL} WHERE o_orderstatus = (SELECT max(o_orderstatus) FROM orders)", lambda p, spark: statement(SELECT(p.k, p.v, p.st), FROM(p), WHERE(equals(p.st, latest_partition(spark, p.name, "st")))).lower(spark))
_kept("source_describe_table", "SELECT * FROM (VALUES ('k', 'bigint', false, true), ('v', 'double', false, false), ('st', 'string', true, false)) t(name, type, is_partition, is_key)",
      lambda p, spark: _rows(spark, [(c, d, c in found.partitioned_by, c in found.key) for found in [describe_table(spark, p.name)] for c, d in found.columns.items()], "name string, type string, is_partition boolean, is_key boolean"))
_kept("source_add_references", "SELECT * FROM (VALUES ('a table of the catalog', true), ('no_such_table', false)) t(name, made)",
      lambda p, spark: _rows(spark, [(n.replace(p.name, "a table of the catalog"), i == 0) for i, names in enumerate(add_references(spark, [p.name, "no_such_table"])) for n in names], "name string, made boolean"))
_on("source_check_reference", "SELECT * FROM (VALUES ('o_orderkey is bigint, not int'), ('o_clerk is gone'), ('o_custkey is new')) t(line)",
    lambda t, spark: _rows(spark, [(x,) for x in check_reference(Table("orders", {"o_orderkey": "int", "o_clerk": "string"}), t("orders").select("o_orderkey", "o_custkey")).lines], "line string"))
_on("source_proposed_key", " UNION ALL ".join(f"SELECT '{n}' AS name, CASE WHEN count(*) = count(DISTINCT {k}) THEN '{k}' END AS key FROM {n}" for n, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("nation", "n_nationkey"), ("events", "event_id"))),
    lambda t, spark: _rows(spark, [(n, ",".join(propose_key(t(n)) or ())) for n in ("orders", "customer", "nation", "events")], "name string, key string"))
_on("source_sheet_rows", "SELECT * FROM (VALUES (1.0::DOUBLE, 'a', DATE '2024-01-01', true), (2.5, NULL, DATE '2024-02-29', false)) t(id, name, day, done)",
    lambda t, spark: SheetTable("x", ["id", "name", "day", "done"], [[1, "a", datetime.date(2024, 1, 1), True], [2.5, "#N/A", datetime.date(2024, 2, 29), False]]).frame(spark))
_raw = unchecked_derived("raw", "SELECT c_nationkey, max_by(c_name, c_acctbal) AS richest FROM raw_customer GROUP BY c_nationkey", {"c_nationkey": "int", "richest": "string"}, key=["c_nationkey"])
_on("scan_unchecked_derived", "SELECT n_name, richest FROM nation JOIN (SELECT c_nationkey, max_by(c_name, c_acctbal) AS richest FROM customer GROUP BY 1) ON n_nationkey = c_nationkey",
    lambda t, spark: (t("customer").createOrReplaceTempView("raw_customer"), statement(SELECT(n.n_name, _raw.richest), FROM(n), JOIN(_raw, ON=equals(n.n_nationkey, _raw.c_nationkey))).lower(t))[1])
_on("sql_unchecked", "SELECT n_name FROM nation WHERE n_regionkey = 2", lambda t, spark: (t("nation").createOrReplaceTempView("raw_nation"), unchecked_sql(spark, "SELECT n_name FROM raw_nation WHERE n_regionkey = 2"))[1])
_on("run_limited", "SELECT n_name, n_regionkey FROM nation", lambda t, _: run_query(statement(SELECT(n.n_name, n.n_regionkey), FROM(n)), t, rows=1000))

# Values that are known when a statement is built

query("calc_run_value", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000", lambda spark, sf_dir: statement(SELECT(o.o_orderkey), FROM(o), WHERE(at_least(o.o_totalprice, run_value(lambda x: x * 1000, 150)))).lower(catalog(spark, sf_dir)))
query("calc_variable", "SELECT o_orderkey, 'EU' AS area, 7 AS days FROM orders", statement(SELECT(o.o_orderkey, AS(variable("area", default="US", values={"area": "EU"}), "area"), AS(variable("days", default=7), "days")), FROM(o)))
query("filter_date_text", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-06-01' AND o_orderpriority <> 'it''s'", statement(SELECT(o.o_orderkey), FROM(o), WHERE(unchecked_condition(f"{{d}} >= {date_text(datetime.date(1998, 6, 1))} AND {{p}} <> {tag_text("it's")}", d=o.o_orderdate, p=o.o_orderpriority))))
_on("sql_script_tags", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 90000.5", lambda t, spark: (t("orders").createOrReplaceTempView("raw_orders"), run_batch(spark, "CREATE TABLE tagged AS SELECT o_orderkey FROM raw_orders WHERE o_orderstatus = '<PARM=\"ST\"/>' AND o_totalprice > <PARM=\"LEAST\"/>", {"ST": "F", "LEAST": 90000.5})["tagged"])[1])

# Steps of pandas, runs and lineage

_per_order = statement(SELECT(o.o_orderkey, o.o_custkey, o.o_totalprice), FROM(o))


def _spread(pdf):
    """How far each row is above the least of its group."""
    return pdf.assign(above=pdf["o_totalprice"] - pdf["o_totalprice"].min())[["o_orderkey", "above"]]


def _halved(pdf):
    return pdf.assign(above=pdf["o_totalprice"] / 2)[["o_orderkey", "above"]]


_step_columns = {"o_orderkey": "bigint", "above": "double"}
query("step_python_by", "SELECT o_orderkey, o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey) AS above FROM orders", PythonStep(_per_order, _spread, _step_columns, by=["o_custkey"], key=["o_orderkey"]))
query("step_python_rows", "SELECT o_orderkey, o_totalprice / 2 AS above FROM orders", PythonStep(_per_order, _halved, _step_columns, rows_apart=True, key=["o_orderkey"]))


def _python_saved(t: Callable[[str], DataFrame], spark: SparkSession) -> DataFrame:
    place = Table("mart.spread", _step_columns, key=["o_orderkey"], location=new_place(spark, "spread"))
    insert_overwrite(place, PythonStep(_per_order, _spread, _step_columns, by=["o_custkey"], key=["o_orderkey"]), t)
    return spark.read.parquet(place.location)


_on("step_python_saved", "SELECT o_orderkey, o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey) AS above FROM orders", _python_saved)


def _run(t: Callable[[str], DataFrame], spark: SparkSession) -> DataFrame:
    """Two tables, the second of which reads the first, as steps of a run that are given in the wrong order."""
    big = Table("mart.big", {"k": "bigint", "c": "bigint"}, key=["k"], location=new_place(spark, "big"))
    per = Table("mart.per", {"c": "bigint", "n": "bigint"}, key=["c"], location=new_place(spark, "per"))

    def build(least: float) -> dict:
        first = statement(SELECT(AS(o.o_orderkey, "k"), AS(o.o_custkey, "c")), FROM(o), WHERE(at_least(o.o_totalprice, least)))
        second = statement(SELECT(big.c, AS(count_rows(), "n")), FROM(big), GROUP_BY(big.c))
        return {"per": ({"big"}, lambda: insert_overwrite(per, second, lambda _: spark.read.parquet(big.location))), "big": (set(), lambda: insert_overwrite(big, first, t))}

    build_run(build, {"least": float})(least="100000")
    return spark.read.parquet(per.location)


def _workflow(spark: SparkSession) -> DataFrame:
    """A run that fails in its second step, and goes on from there."""
    done: list[str] = []
    ready: list[str] = []
    steps = {"read": lambda: ready.append("read"), "check": lambda: ready.index("fixed"), "write": lambda: ready.append("write")}
    try:
        run_workflow(steps, done, done.append)
    except ValueError:
        ready.append("fixed")
    again = run_workflow(steps, list(done), done.append)
    return _rows(spark, [(i, s, s in again) for i, s in enumerate(done)], "place int, step string, second_run boolean")


def _changes(spark: SparkSession) -> DataFrame:
    """What differs between two states of a table and of one that reads it."""
    def at(least: int, extra: tuple) -> dict:
        d = derived("d", statement(SELECT(o.o_custkey, AS(count_rows(where=more_than(o.o_totalprice, least)), "n"), *extra), FROM(o), GROUP_BY(o.o_custkey)))
        return {"d": d.query, "top": statement(SELECT(AS(max_of(d.n), "most")), FROM(d))}

    def frame(queries: dict, when: int) -> DataFrame:
        return _rows(spark, [(c, own, all_, when) for c, (own, all_) in logic(queries).items()], "column string, own string, effective string, recorded int")

    return changes(frame(at(1, (AS(min_of(o.o_orderkey), "first"),)), 1), frame(at(2, (AS(max_of(o.o_orderkey), "last"),)), 2))


_on("run_tables_in_order", "SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_totalprice >= 100000 GROUP BY 1", _run)
_on("run_workflow_resumed", "SELECT * FROM (VALUES (0, 'read', false), (1, 'check', true), (2, 'write', true)) t(place, step, second_run)", lambda t, spark: _workflow(spark))
_on("lineage_changes", "SELECT * FROM (VALUES ('d.n', 'OWN'), ('d.first', 'REMOVED'), ('d.last', 'ADDED'), ('top.most', 'INHERITED')) t(\"column\", change)", lambda t, spark: _changes(spark))
_on("lineage_tables", "SELECT * FROM (VALUES ('lineitem', 'flagship'), ('orders', 'flagship'), ('customer', 'flagship'), ('nation', 'flagship')) t(source, target)", lambda t, spark: _rows(spark, table_edges({"flagship": flagship}), "source string, target string"))
_on("sql_typed_columns", "SELECT * FROM (VALUES ('nation', 'string'), ('month', 'string'), ('revenue', 'double'), ('n_orders', 'bigint')) t(name, type)", lambda t, spark: _rows(spark, list(typed_selected_columns(spark, flagship).items()), "name string, type string"))
_on("sql_statements_in_order", "SELECT * FROM (VALUES (0, 'create_as', 'x'), (1, 'insert', 'y'), (2, 'query', NULL)) t(place, kind, writes)",
    lambda t, spark: _rows(spark, [(i, q.kind, q.writes) for i, q in enumerate(in_order(map(classify, split_statements("INSERT INTO y SELECT ';' AS c FROM x; CREATE TABLE x AS SELECT 1 AS c -- made; first\n; SELECT * FROM y"))))], "place int, kind string, writes string"))
_sheet = SheetTable("runs", ["id", "v", "double", "who"], [[1, 5.0, 10.0, "A"], [2, None, 0.0, "B"], [3, 7.0, 15.0, "A"], [4, 1.0, 2.0, "B"]], {"double": "[@v]*factor", "who": "XLOOKUP([@id],people[id],people[name])"})
_people = SheetTable("people", ["id", "name"], [[1, "A"], [2, "B"], [3, "A"], [4, "C"]])
_on("verify_workbook", "SELECT * FROM (VALUES ('runs', 2, 'double', '15.0', '14.0'), ('runs', 3, 'who', 'B', 'C')) t(\"table\", \"row\", \"column\", workbook, computed)", lambda t, spark: check_workbook(spark, Book({"runs": _sheet, "people": _people}, {"factor": "2"})).toDF("table", "row", "column", "workbook", "computed"))

# What is refused, and as what


def _refused(spark: SparkSession) -> DataFrame:
    days = Table("days", {"k": "bigint", "v": "double", "dt": "string"}, partitioned_by=["dt"], key=["k"], location="nowhere")
    left = LEFT_JOIN(c, ON=equals(o.o_custkey, c.c_custkey))
    totals = statement(SELECT(o.o_orderstatus, AS(count_rows(), "n")), FROM(o), GROUP_BY(rollup(o.o_orderstatus)))
    tried = {
        "additivity": lambda: sum_of(p.p_retailprice), "clause order": lambda: statement(FROM(o), SELECT(o.o_orderkey)), "duplicate names": lambda: statement(SELECT(o.o_orderkey, AS(o.o_custkey, "o_orderkey")), FROM(o)),
        "full join then where": lambda: statement(SELECT(o.o_orderkey), FROM(o), FULL_JOIN(c, ON=equals(o.o_custkey, c.c_custkey)), WHERE(more_than(o.o_totalprice, 1))), "key proof": lambda: check_write(Table("x", {"o_custkey": "bigint"}, key=["o_custkey"]), statement(SELECT(o.o_custkey), FROM(o))),
        "left join then where": lambda: statement(SELECT(o.o_orderkey), FROM(o), left, WHERE(more_than(c.c_acctbal, 1))), "missing group by": lambda: statement(SELECT(o.o_custkey, AS(count_rows(), "n")), FROM(o)), "order by": lambda: statement(SELECT(o.o_orderkey), FROM(o), ORDER_BY(o.o_orderkey)),
        "partition bound": lambda: statement(SELECT(days.k), FROM(days)), "right join": lambda: RIGHT_JOIN(c, ON=equals(o.o_custkey, c.c_custkey)), "subtotals written": lambda: check_write(Table("x", {"o_orderstatus": "string", "n": "bigint"}), totals), "table read twice": lambda: statement(SELECT(n.n_name), FROM(n), JOIN(n, ON=equals(n.n_nationkey, n.n_regionkey))),
        "types compared": lambda: equals(o.o_orderkey, "x"), "unnamed calculation": lambda: statement(SELECT(o.o_totalprice * 2), FROM(o)), "window order": lambda: rank(over=window(o.o_custkey)), "write line-up": lambda: check_write(days, statement(SELECT(AS(o.o_orderkey, "k")), FROM(o))),
        "set operation columns": lambda: UNION_ALL(statement(SELECT(o.o_orderkey), FROM(o)), statement(SELECT(c.c_custkey, c.c_name), FROM(c))), "grouped statement": lambda: statement(SELECT(o.o_custkey, AS(count_rows(), "n")), FROM(o), GROUP_BY(o.o_custkey)),
    }
    found = []
    for name, make in tried.items():
        try:
            make()
            found.append((name, "accepted"))
        except Refused as e:
            found.append((name, type(e).__name__))
    return _rows(spark, found, "what string, came string")


_on("checks_refused", "SELECT * FROM (VALUES ('additivity', 'GuardRefused'), ('clause order', 'GuardRefused'), ('duplicate names', 'GuardRefused'), ('full join then where', 'GuardRefused'), ('key proof', 'GuardRefused'), ('left join then where', 'GuardRefused'), ('missing group by', 'GuardRefused'), ('order by', 'GuardRefused'), ('partition bound', 'LoadRefused'), ('right join', 'GuardRefused'), ('subtotals written', 'GuardRefused'), ('table read twice', 'GuardRefused'), ('types compared', 'GuardRefused'), ('unnamed calculation', 'GuardRefused'), ('window order', 'GuardRefused'), ('write line-up', 'GuardRefused'), ('set operation columns', 'GuardRefused'), ('grouped statement', 'accepted')) t(what, came)", lambda t, spark: _refused(spark))

# Streams: micro-batches that replace the partitions they fill


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream that ends: halved and written by status, all in one batch, which is then sent again."""
    place = Table("mart.streamed", {"k": "bigint", "v": "double", "st": "string"}, partitioned_by=["st"], key=["k"], location=new_place(spark, "streamed"))
    halved = statement(SELECT(AS(o.o_orderkey, "k"), AS(o.o_totalprice / 2, "v"), AS(o.o_orderstatus, "st")), FROM(o))
    write = overwrite_batches(place, halved, "orders")

    def twice(batch: DataFrame, at: int) -> None:
        write(batch, at)
        write(batch, at)

    given = spark.readStream.schema(o.schema()).parquet(f"{sf_dir}/orders.parquet*")
    given.writeStream.foreachBatch(twice).option("checkpointLocation", new_place(spark, "streamed_at")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("k bigint, v double, st string").parquet(place.location)


query("stream_overwrite", "SELECT o_orderkey AS k, o_totalprice / 2 AS v, o_orderstatus AS st FROM orders", _streamed)

# Spreadsheet formulas, over orders, customer and events as tables of a workbook


def _book(t: Callable[[str], DataFrame], **options) -> Workbook:
    return Workbook({n: t(n) for n in ("orders", "customer", "events", "nation")}, {"orders": ["o_orderkey"], "customer": ["c_custkey"], "events": ["event_id"], "nation": ["n_nationkey"]}, names={"rate": 0.25}, today=datetime.date(2024, 1, 31), **options)


def formula(name: str, table: str, text: str, sql: str | None, joins: str = "") -> None:
    key = {"orders": "o_orderkey", "events": "event_id", "customer": "c_custkey"}[table]
    _on(f"xl_{name}", sql and f"SELECT {key}, {sql} AS v FROM {table} {joins}", lambda t, _: _book(t).add(table, v=text).select(key, "v"))


_month = "strftime({}, '%Y-%m-%d')::DATE"
for _f, _text, _sql in (
    ("arithmetic", "=([@[o_totalprice]]+1)*2-[@[o_custkey]]/4", "(o_totalprice + 1) * 2 - o_custkey / 4.0"), ("power_percent", "=[@[o_custkey]]^2*50%-1", "pow(o_custkey, 2) * 0.5 - 1"), ("round", "=ROUND([@[o_totalprice]],0)", "round(o_totalprice, 0)"),
    ("abs", "=ABS(-[@[o_custkey]])", "abs(-o_custkey)"), ("sqrt_power", "=SQRT([@[o_totalprice]])+POWER([@[o_custkey]],2)", "sqrt(o_totalprice) + pow(o_custkey, 2)"), ("mod_int", "=MOD([@[o_custkey]],7)+INT([@[o_totalprice]])", "o_custkey % 7 + floor(o_totalprice)"),
    ("len", "=LEN([@[o_orderpriority]])", "length(o_orderpriority)"), ("substitute", '=SUBSTITUTE([@[o_orderpriority]],"-","/")', "replace(o_orderpriority, '-', '/')"), ("upper_lower_trim", '=UPPER(LOWER(TRIM([@[o_orderpriority]])))', "upper(o_orderpriority)"),
    ("iferror", "=IFERROR([@[o_totalprice]]/([@[o_custkey]]-[@[o_custkey]]),0)", "0.0"), ("and_or_not", '=IF(AND([@[o_custkey]]>10,NOT(OR([@[o_orderstatus]]="F",[@[o_orderstatus]]="O"))),1,0)', "CASE WHEN o_custkey > 10 AND NOT (o_orderstatus = 'F' OR o_orderstatus = 'O') THEN 1 ELSE 0 END"),
    ("if", '=IF([@[o_totalprice]]>100000,"big","small")', "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END"), ("ifs", '=IFS([@[o_custkey]]<5,"a",[@[o_custkey]]<50,"b",TRUE,"c")', "CASE WHEN o_custkey < 5 THEN 'a' WHEN o_custkey < 50 THEN 'b' ELSE 'c' END"),
    ("switch", '=SWITCH([@[o_orderstatus]],"F",1,"O",2,9)', "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 9 END"), ("isblank", "=IF(ISBLANK([@[o_orderstatus]]),1,0)", "0"), ("min_max", "=MIN([@[o_custkey]],50)+MAX([@[o_custkey]],20)", "least(o_custkey, 50) + greatest(o_custkey, 20)"),
    ("left_right_mid", "=LEFT([@[o_orderpriority]],2)&RIGHT([@[o_orderpriority]],2)&MID([@[o_orderpriority]],2,3)", "left(o_orderpriority, 2) || right(o_orderpriority, 2) || substr(o_orderpriority, 2, 3)"), ("find_search", '=FIND("H",[@[o_orderpriority]])+SEARCH("h",[@[o_orderpriority]])', "2 * instr(o_orderpriority, 'H')"),
    ("isnumber_search", '=IF(ISNUMBER(SEARCH("high",[@[o_orderpriority]])),1,0)', "CASE WHEN contains(o_orderpriority, 'HIGH') THEN 1 ELSE 0 END"), ("concat", '=CONCAT([@[o_orderstatus]],"-",[@[o_orderpriority]])', "o_orderstatus || '-' || o_orderpriority"), ("textjoin", '=TEXTJOIN("+",TRUE,[@[o_orderstatus]],[@[o_orderpriority]])', "o_orderstatus || '+' || o_orderpriority"),
    ("value", "=VALUE(LEFT([@[o_orderpriority]],1))", "left(o_orderpriority, 1)::DOUBLE"), ("year_month_day", "=YEAR([@[o_orderdate]])*10000+MONTH([@[o_orderdate]])*100+DAY([@[o_orderdate]])", "strftime(o_orderdate, '%Y%m%d')::BIGINT"), ("date", "=DATE(YEAR([@[o_orderdate]]),MONTH([@[o_orderdate]]),1)", "date_trunc('month', o_orderdate)::DATE"),
    ("today_difference", "=TODAY()-[@[o_orderdate]]", "date_diff('day', o_orderdate::DATE, DATE '2024-01-31')"), ("date_plus", "=[@[o_orderdate]]+30", "o_orderdate::DATE + 30"), ("datedif", '=DATEDIF([@[o_orderdate]],TODAY(),"d")', "date_diff('day', o_orderdate::DATE, DATE '2024-01-31')"),
    ("eomonth", "=EOMONTH([@[o_orderdate]],0)", "last_day(o_orderdate)"), ("edate", "=EDATE([@[o_orderdate]],1)", "(o_orderdate::DATE + INTERVAL 1 MONTH)::DATE"), ("weekday", "=WEEKDAY([@[o_orderdate]])", "dayofweek(o_orderdate) + 1"), ("text", '=TEXT([@[o_orderdate]],"yyyy-mm")', "strftime(o_orderdate, '%Y-%m')"),
    ("defined_name", "=[@[o_totalprice]]*rate", "o_totalprice * 0.25"), ("refused", "=OFFSET([@[o_custkey]],1,0)", "NULL::DOUBLE"),
    ("sumifs_own", "=SUMIFS([o_custkey],[o_orderstatus],[@[o_orderstatus]])", "sum(o_custkey) OVER (PARTITION BY o_orderstatus)"), ("countifs_own", '=COUNTIFS([o_custkey],[@[o_custkey]],[o_orderstatus],"<>F")', "count(*) FILTER (o_orderstatus <> 'F') OVER (PARTITION BY o_custkey)"),
    ("maxifs_minifs", "=MAXIFS([o_totalprice],[o_custkey],[@[o_custkey]])-MINIFS([o_totalprice],[o_custkey],[@[o_custkey]])", "max(o_totalprice) OVER (PARTITION BY o_custkey) - min(o_totalprice) OVER (PARTITION BY o_custkey)"), ("averageifs", "=ROUND(AVERAGEIFS([o_totalprice],[o_custkey],[@[o_custkey]]),6)", "round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6)"),
    ("countif_wildcard", '=COUNTIF([o_orderpriority],"*high*")', "(SELECT count(*) FROM orders WHERE o_orderpriority ILIKE '%high%')"), ("running_total", '=SUMIFS([o_custkey],[o_orderstatus],[@[o_orderstatus]],[o_orderdate],"<="&[@[o_orderdate]])', "sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate RANGE UNBOUNDED PRECEDING)"),
    ("rank", "=RANK.EQ([@[o_totalprice]],[o_totalprice])", "rank() OVER (ORDER BY o_totalprice DESC)"), ("rank_up", "=RANK([@[o_totalprice]],[o_totalprice],1)", "rank() OVER (ORDER BY o_totalprice)"), ("whole_column", "=ROUND([@[o_totalprice]]/SUM([o_totalprice])*1000000,3)", "round(o_totalprice / (SELECT sum(o_totalprice) FROM orders) * 1000000, 3)"),
    ("sumproduct", '=SUMPRODUCT((orders[o_orderstatus]="F")*((orders[o_custkey]<50)+(orders[o_custkey]>900))*orders[o_custkey])', "(SELECT sum(o_custkey) FROM orders WHERE o_orderstatus = 'F' AND (o_custkey < 50 OR o_custkey > 900))"),
    ("xlookup", '=XLOOKUP([@[o_custkey]],customer[c_custkey],customer[c_name],"none")', "coalesce((SELECT c_name FROM customer WHERE c_custkey = o_custkey), 'none')"), ("vlookup", "=VLOOKUP([@[o_custkey]],customer,2,FALSE)", "(SELECT c_name FROM customer WHERE c_custkey = o_custkey)"), ("index_match", "=INDEX(customer[c_mktsegment],MATCH([@[o_custkey]],customer[c_custkey],0))", "(SELECT c_mktsegment FROM customer WHERE c_custkey = o_custkey)"),
):
    formula(_f, "orders", _text, _sql)
for _f, _text, _sql in (
    ("proper", "=PROPER(LOWER([@[o_orderstatus]]))", "o_orderstatus"), ("ifna", '=IFNA(XLOOKUP([@[o_custkey]],customer[c_custkey],customer[c_name]),"none")', "coalesce((SELECT c_name FROM customer WHERE c_custkey = o_custkey), 'none')"),
    ("merged_ifs", '=SUMIFS([o_custkey],[o_orderstatus],"F")+SUMIFS([o_custkey],[o_orderstatus],"O")+SUMIFS([o_custkey],[o_orderstatus],"P")', "(SELECT sum(o_custkey) FROM orders WHERE o_orderstatus IN ('F', 'O', 'P'))"),
    ("month_start", "=EOMONTH([@[o_orderdate]],-1)+1", "date_trunc('month', o_orderdate)::DATE"), ("week_start", "=[@[o_orderdate]]-WEEKDAY([@[o_orderdate]],2)+1", "date_trunc('week', o_orderdate)::DATE"), ("mod_zero", "=MOD([@[o_custkey]],[@[o_custkey]]-[@[o_custkey]])", "NULL::BIGINT"),
    ("if_mixed", '=IF([@[o_custkey]]>50,"much",[@[o_custkey]])', "CASE WHEN o_custkey > 50 THEN 'much' ELSE o_custkey::VARCHAR END"), ("weekday_refused", "=WEEKDAY([@[o_orderdate]],2)", "NULL::DOUBLE"), ("datedif_refused", '=DATEDIF([@[o_orderdate]],TODAY(),"ym")', "NULL::DOUBLE"), ("datedif_months", '=DATEDIF([@[o_orderdate]],TODAY(),"m")', "date_sub('month', o_orderdate::DATE, DATE '2024-01-31')"),
    ("running_total_all", '=SUMIFS([o_custkey],[o_totalprice],"<="&[@[o_totalprice]])', "sum(o_custkey) OVER (ORDER BY o_totalprice RANGE UNBOUNDED PRECEDING)"), ("count_above", '=COUNTIFS([o_totalprice],">"&[@[o_totalprice]],[o_orderstatus],"F")', "(SELECT count(*) FROM orders b WHERE b.o_totalprice > orders.o_totalprice AND b.o_orderstatus = 'F')"),
    ("sum_in_range", '=SUMIFS([o_custkey],[o_totalprice],">="&[@[o_totalprice]]-5000,[o_totalprice],"<"&[@[o_totalprice]]+5000)', "(SELECT sum(b.o_custkey) FROM orders b WHERE b.o_totalprice >= orders.o_totalprice - 5000 AND b.o_totalprice < orders.o_totalprice + 5000)"),
    ("max_before", '=MAXIFS([o_totalprice],[o_custkey],[@[o_custkey]],[o_orderdate],"<"&[@[o_orderdate]])', "coalesce((SELECT max(b.o_totalprice) FROM orders b WHERE b.o_custkey = orders.o_custkey AND b.o_orderdate < orders.o_orderdate), 0)"), ("find_from", '=FIND("-",[@[o_orderpriority]]&"-",3)', "instr(substr(o_orderpriority || '-', 3), '-') + 2"),
):
    formula(_f, "orders", _text, _sql)


def _cells_book(t: Callable[[str], DataFrame]) -> Workbook:
    """orders with blanks and with dates as texts of 8 digits, and a table of parameters."""
    book = _book(t)
    book.tables["orders"] = t("orders").selectExpr("o_orderkey", "nullif(o_custkey % 3, 0) AS q", "nullif(o_orderstatus, 'F') AS st", "date_format(o_orderdate, 'yyyyMMdd') AS day")
    book.tables["Parameters"] = t("nation").selectExpr("n_name AS name", "n_nationkey * 2 AS value")
    book.read_cells("orders")
    return book


for _f, _text, _sql in (
    ("blank", '=IF([@q]=0,1,0)+IF([@st]="",10,0)', "CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 0 END"), ("text_date", "=YEAR([@day])*100+MONTH([@day]+31)", "year(o_orderdate) * 100 + month(o_orderdate::DATE + 31)"),
    ("parameters", '=[@[o_orderkey]]*XLOOKUP("nation_3",Parameters[name],Parameters[value])', "o_orderkey * (SELECT n_nationkey * 2 FROM nation WHERE lower(n_name) = 'nation_3')"), ("date_parts", "=DATE(LEFT([@day],4),MID([@day],5,2)+1,RIGHT([@day],2)-1)", "(date_trunc('year', o_orderdate)::DATE + to_months(month(o_orderdate)::INTEGER))::DATE + (day(o_orderdate)::INTEGER - 2)"),
):
    _on(f"xl_{_f}", f"SELECT o_orderkey, {_sql} AS v FROM orders", lambda t, _, x=_text: _cells_book(t).add("orders", v=x).select("o_orderkey", "v"))
_on("xl_shared_joins", "SELECT o_orderkey, c_name AS a, c_acctbal AS b, sum(o_custkey) OVER () AS d, o_totalprice / c_acctbal AS e FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    lambda t, _: _book(t, infinite=True).add("orders", a="=XLOOKUP([@[o_custkey]],customer[c_custkey],customer[c_name])", b="=INDEX(customer[c_acctbal],MATCH([@[o_custkey]],customer[c_custkey],0))", d="=SUM([o_custkey])", e="=[@[o_totalprice]]/[@b]").select("o_orderkey", "a", "b", "d", "e"))
formula("sumifs_other", "customer", '=SUMIFS(orders[o_orderkey],orders[o_custkey],[@[c_custkey]])+COUNTIFS(orders[o_custkey],[@[c_custkey]],orders[o_orderstatus],"F")', "coalesce(s, 0) + coalesce(f, 0)", "LEFT JOIN (SELECT o_custkey, sum(o_orderkey) AS s, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey")
formula("countifs_compared", "customer", '=COUNTIFS(nation[n_nationkey],"<"&[@[c_nationkey]],nation[n_regionkey],0)', "(SELECT count(*) FROM nation WHERE n_nationkey < c_nationkey AND n_regionkey = 0)")
_on("xl_total_row", "SELECT sum(o_custkey) AS a, count(o_orderstatus) AS b, max(o_totalprice) AS c, min(o_totalprice) AS d FROM orders", lambda t, _: _book(t).total_row("orders", a=("o_custkey", 109), b=("o_orderstatus", 103), c=("o_totalprice", 104), d=("o_totalprice", 105)))
_on("xl_typed_over", "SELECT o_orderkey, CASE o_orderkey WHEN 5 THEN -1 ELSE o_custkey * 2 END AS v FROM orders", lambda t, _: _book(t).typed_over("orders", "v", "=[@[o_custkey]]*2", {5: -1}).select("o_orderkey", "v"))

# Power Query steps


def m(name: str, text: str, sql: str | None) -> None:
    _on(f"m_{name}", sql, lambda t, _: PowerQuery({n: t(n) for n in ("orders", "customer", "nation", "region", "supplier")}).run(f'let Source = Excel.CurrentWorkbook(){{[Name="{text.split(":", 1)[0]}"]}}[Content], {text.split(":", 1)[1]}'))


for _f, _text, _sql in (
    ("select_rows", 'orders:A = Table.SelectRows(Source, each [o_orderstatus] = "F" and [o_totalprice] > 1000), B = Table.SelectColumns(A, {"o_orderkey"}) in B', "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000"),
    ("group", 'orders:A = Table.Group(Source, {"o_custkey"}, {{"n", each Table.RowCount(_), Int64.Type}, {"top", each List.Max([o_totalprice]), type number}, {"kinds", each List.Count(List.Distinct([o_orderstatus]))}}), B = Table.SelectRows(A, each [n] > 5) in B', "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1 HAVING n > 5"),
    ("add_rename_remove", 'nation:A = Table.AddColumn(Source, "up", each Text.Lower([n_name]) & "!"), B = Table.RenameColumns(A, {{"n_nationkey", "k"}}), C = Table.RemoveColumns(B, {"n_regionkey"}), D = Table.ReorderColumns(C, {"up", "k", "n_name"}) in D', "SELECT lower(n_name) || '!' AS up, n_nationkey AS k, n_name FROM nation"),
    ("transform_replace", 'nation:A = Table.TransformColumns(Source, {{"n_name", Text.Lower}, {"n_regionkey", each _ * 10}}), B = Table.ReplaceValue(A, "nation", "land", Replacer.ReplaceText, {"n_name"}), C = Table.DuplicateColumn(B, "n_name", "copy") in C', "SELECT n_nationkey, replace(lower(n_name), 'nation', 'land') AS n_name, n_regionkey * 10 AS n_regionkey, replace(lower(n_name), 'nation', 'land') AS copy FROM nation"),
    ("nested_join", 'nation:A = Table.NestedJoin(Source, {"n_regionkey"}, region, {"r_regionkey"}, "r", JoinKind.LeftOuter), B = Table.ExpandTableColumn(A, "r", {"r_name"}, {"region"}) in B', "SELECT n_nationkey, n_name, n_regionkey, r_name AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey"),
    ("anti_join", 'customer:A = Table.NestedJoin(Source, {"c_custkey"}, supplier, {"s_suppkey"}, "s", JoinKind.LeftAnti), B = Table.SelectColumns(A, {"c_custkey"}) in B', "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"),
    ("semi_join", 'customer:A = Table.SelectRows(Source, each List.Contains(orders[o_custkey], [c_custkey])), B = Table.SelectColumns(A, {"c_custkey"}) in B', "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    ("cross", 'region:A = Table.AddColumn(Source, "n", each nation), B = Table.ExpandTableColumn(A, "n", {"n_name"}) in B', "SELECT r_regionkey, r_name, n_name FROM region, nation"),
    ("combine_distinct", 'nation:A = Table.SelectColumns(Source, {"n_regionkey"}), B = Table.RenameColumns(region, {{"r_regionkey", "n_regionkey"}}), C = Table.Distinct(Table.Combine({A, B})) in C', "SELECT DISTINCT n_regionkey, r_name FROM (SELECT n_regionkey, NULL AS r_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region)"),
    ("unpivot", 'nation:A = Table.Unpivot(Source, {"n_nationkey", "n_regionkey"}, "what", "value") in A', "SELECT n_name, 'n_nationkey' AS what, n_nationkey AS value FROM nation UNION ALL SELECT n_name, 'n_regionkey', n_regionkey FROM nation"),
    ("pivot", 'orders:A = Table.SelectColumns(Source, {"o_custkey", "o_orderstatus", "o_orderkey"}), B = Table.Pivot(A, {"F", "O"}, "o_orderstatus", "o_orderkey", List.Sum) in B', "SELECT o_custkey, sum(o_orderkey) FILTER (o_orderstatus = 'F') AS \"F\", sum(o_orderkey) FILTER (o_orderstatus = 'O') AS \"O\" FROM orders GROUP BY 1"),
    ("sort_first", 'orders:A = Table.Sort(Source, {{"o_totalprice", Order.Descending}, {"o_orderkey", Order.Ascending}}), B = Table.FirstN(A, 10), C = Table.SelectColumns(B, {"o_orderkey"}) in C', "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    ("index", 'orders:A = Table.Sort(Source, {{"o_totalprice", Order.Descending}, {"o_orderkey", Order.Ascending}}), B = Table.AddIndexColumn(A, "i", 1, 2), C = Table.SelectColumns(B, {"o_orderkey", "i"}) in C', "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) * 2 - 1 AS i FROM orders"),
    ("null_aware", 'nation:A = Table.AddColumn(Source, "x", each if [n_regionkey] > 2 then null else [n_regionkey]), B = Table.SelectRows(A, each [x] <> 1), C = Table.SelectColumns(B, {"n_nationkey"}) in C', "SELECT n_nationkey FROM nation WHERE n_regionkey <> 1"),
    ("scalars", 'orders:A = Table.AddColumn(Source, "v", each Text.Middle([o_orderpriority], 2, 3) & Text.Combine({[o_orderstatus], "z"}, "/")), B = Table.AddColumn(A, "d", each Date.AddDays(Date.StartOfMonth([o_orderdate]), 3)), C = Table.SelectColumns(B, {"o_orderkey", "v", "d"}) in C', "SELECT o_orderkey, substr(o_orderpriority, 3, 3) || o_orderstatus || '/z' AS v, date_trunc('month', o_orderdate)::DATE + 3 AS d FROM orders"),
):
    m(_f, _text, _sql)
_on("m_index_all_columns", "SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity) AS i FROM lineitem",
    lambda t, _: PowerQuery({"lineitem": t("lineitem")}).run('let A = Table.Sort(lineitem, {{"l_extendedprice", Order.Descending}, {"l_orderkey", Order.Ascending}, {"l_partkey", Order.Ascending}, {"l_suppkey", Order.Ascending}, {"l_linenumber", Order.Ascending}, {"l_shipdate", Order.Ascending}, {"l_quantity", Order.Ascending}}), B = Table.AddIndexColumn(A, "i", 1, 1) in B'))
m("expand_two", 'customer:A = Table.NestedJoin(Source, {"c_nationkey"}, nation, {"n_nationkey"}, "n", JoinKind.LeftOuter), B = Table.NestedJoin(A, {"c_custkey"}, orders, {"o_custkey"}, "o", JoinKind.LeftOuter), C = Table.ExpandTableColumn(B, "n", {"n_name"}), D = Table.ExpandTableColumn(C, "o", {"o_orderkey"}), E = Table.SelectColumns(D, {"c_custkey", "n_name", "o_orderkey"}) in E', "SELECT c_custkey, n_name, o_orderkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey")

# Pivot tables


def pivot(name: str, sql: str, spec: Pivot) -> None:
    _on(f"pivot_{name}", sql, lambda t, _: spec.lower(t("orders")))


_st, _pr = Field("o_orderstatus"), Field("o_orderpriority")
_n = Value("n", how="count")
_cells = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"
pivot("summaries", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 1) AS s, max(o_totalprice) AS hi, min(o_totalprice) AS lo, count(DISTINCT o_custkey) AS d FROM orders GROUP BY 1", Pivot((_st,), (), (_n, Value("s", formula="round(sum_o_totalprice, 1)"), Value("hi", "o_totalprice", "max"), Value("lo", "o_totalprice", "min"), Value("d", "o_custkey", "distinct"))))
for _f, _v, _sql in (
    ("share_of_total", Value("n", how="count", show="% of total"), "n / sum(n) OVER ()"), ("share_of_row", Value("n", how="count", show="% of row"), "n / sum(n) OVER (PARTITION BY o_orderstatus)"), ("share_of_column", Value("n", how="count", show="% of column"), "n / sum(n) OVER (PARTITION BY o_orderpriority)"),
    ("running_total", Value("n", how="count", show="running total", base="o_orderpriority"), "sum(n) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING)"), ("rank", Value("n", how="count", show="rank down", base="o_orderpriority"), "rank() OVER (PARTITION BY o_orderstatus ORDER BY n DESC)"),
    ("difference", Value("n", how="count", show="difference", base="o_orderstatus", item="F"), "n - max(n) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_orderpriority)"), ("percent_difference", Value("n", how="count", show="% difference", base="o_orderstatus", item="F"), "(n - max(n) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_orderpriority)) / max(n) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_orderpriority)"),
):
    pivot(_f, f"SELECT o_orderstatus, o_orderpriority, {_sql} AS n FROM ({_cells})", Pivot((_st,), (_pr,), (_v,)))
pivot("dates", "SELECT year(o_orderdate) AS y, 'Qtr' || quarter(o_orderdate) AS q, strftime(o_orderdate, '%b') AS m, count(*) AS n FROM orders GROUP BY ALL", Pivot((Field("o_orderdate", "y", "years"), Field("o_orderdate", "q", "quarters")), (Field("o_orderdate", "m", "months"),), (_n,)))
pivot("bins", "SELECT CASE WHEN o_totalprice < 0 THEN '<0' WHEN o_totalprice > 200000 THEN '>200000' ELSE (floor(o_totalprice / 50000) * 50000)::BIGINT || '-' || (floor(o_totalprice / 50000) * 50000 + 49999)::BIGINT END AS b, count(*) AS n FROM orders GROUP BY 1", Pivot((Field("o_totalprice", "b", bins=(0, 200000, 50000)),), (), (_n,)))
pivot("hand_groups", "SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN 'known' ELSE o_orderstatus END AS g, count(*) AS n FROM orders GROUP BY 1", Pivot((Field("o_orderstatus", "g", groups={"known": ("F", "O")}),), (), (_n,)))
pivot("calculated_field", "SELECT o_orderstatus, round(sum(o_totalprice) / sum(o_custkey), 6) AS r FROM orders GROUP BY 1", Pivot((_st,), (), (Value("r", formula="round(try_divide(sum_o_totalprice, sum_o_custkey), 6)"),)))
pivot("filters", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '5-LOW' AND o_totalprice BETWEEN 10 AND 90000 GROUP BY 1", Pivot((_pr,), (), (_n,), keep={"o_orderstatus": ("F", "P")}, drop={"o_orderpriority": ("5-LOW",)}, between={"o_totalprice": (10, 90000)}))
pivot("top_items", "WITH t AS (SELECT o_custkey, rank() OVER (ORDER BY sum(o_orderkey) DESC) AS p FROM orders GROUP BY 1) SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM t WHERE p <= 7) GROUP BY 1", Pivot((Field("o_custkey"),), (), (_n,), top=("o_custkey", 7, "o_orderkey")))
pivot("calculated_item", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT 'open share', o_orderpriority, count(*) FILTER (o_orderstatus = 'O') / count(*) FILTER (o_orderstatus = 'F') FROM orders GROUP BY 2", Pivot((_st,), (_pr,), (_n,), items={"o_orderstatus": {"open share": '"O" / "F"'}}))
_on("pivot_totals", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", lambda t, _: Pivot((_st,), (_pr,), (_n,)).totals(t("orders"), "o_orderstatus"))
_on("pivot_getpivotdata", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus) AS v FROM orders", lambda t, _: Pivot((_st,), (_pr,), (_n,)).value_of(t("orders"), "n", "v", o_orderstatus="o_orderstatus").select("o_orderkey", "v"))
