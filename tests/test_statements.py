"""What statements refuse, the keys they infer, and rows of the small worked example."""

import datetime
import warnings

import pytest

from plumbline.errors import GuardRefused, LoadRefused, RepeatedRowsWarning
from plumbline.functions.expressions import *  # noqa: F403
from plumbline.functions.expressions import (
    all_of, any_of, at_most, average_of, between, count_distinct, count_rows, equals, fill_null, is_in, is_null, last_n_days, literal, max_of, more_than, not_equals, row_number, set_clock, sql_function, sum_of, window,
)
from plumbline.plans.statements import (
    ANTI_JOIN, AS, EXCEPT, FROM, FULL_JOIN, GROUP_BY, INTERSECT, JOIN, LEFT_JOIN, LIMIT, ORDER_BY, RIGHT_JOIN, SELECT, SELECT_DISTINCT, SEMI_JOIN, UNION, UNION_ALL, WHERE, derived, rollup, run_query, statement,
)
from plumbline.sources.tables import Table, check_key, check_reference, check_type, propose_key

runs = Table("ops.job_runs", {"run_id": "bigint", "job_id": "bigint", "status": "string", "mins": "double", "retry": "double", "dt": "string"}, partitioned_by=["dt"], key=["run_id"], does_not_add_up=["retry"])
jobs = Table("ops.jobs", {"job_id": "bigint", "team": "string"}, key=["job_id"])
alerts = Table("ops.run_alerts", {"alert_id": "bigint", "run_id": "bigint", "severity": "string", "dt": "string"}, partitioned_by=["dt"], key=["alert_id"])
DAY = equals(runs.dt, "2026-09-24")


@pytest.fixture(scope="module")
def example(spark):
    return {
        "ops.job_runs": spark.createDataFrame([(97, 3, "FAILED", 5.0, 1.0, "2026-09-23"), (98, 1, None, 7.0, 2.0, "2026-09-23"), (101, 1, "OK", 4.0, 1.0, "2026-09-24"), (102, 2, "FAILED", 9.0, 3.0, "2026-09-24")], runs.schema()),
        "ops.jobs": spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], jobs.schema()),
        "ops.run_alerts": spark.createDataFrame([(1, 101, "high", "2026-09-24"), (2, 102, "high", "2026-09-24"), (3, 101, "low", "2026-09-24")], alerts.schema()),
    }


def q(*clauses):
    return statement(*clauses)


@pytest.mark.parametrize(
    "build",
    [
        lambda: q(SELECT(runs.run_id + 1), FROM(runs), WHERE(DAY)),
        lambda: q(SELECT(runs.run_id, AS(runs.job_id, "run_id")), FROM(runs), WHERE(DAY)),
        lambda: q(SELECT(runs.job_id, AS(count_rows(), "n")), FROM(runs), WHERE(DAY)),
        lambda: sum_of(runs.retry),
        lambda: average_of(average_of(runs.mins)),
        lambda: sum_of(runs.status),
        lambda: sum_of(runs.mins / runs.retry),
        lambda: equals(runs.run_id, None),
        lambda: equals(runs.run_id, "x"),
        lambda: equals(runs.mins, float("nan")),
        lambda: is_in(runs.run_id, []),
        lambda: between(runs.run_id, 5, 1),
        lambda: any_of(DAY),
        lambda: RIGHT_JOIN(jobs, ON=equals(jobs.job_id, runs.job_id)),
        lambda: JOIN(jobs),
        lambda: ANTI_JOIN(jobs, ON=more_than(jobs.job_id, runs.job_id)),
        lambda: q(SELECT(runs.run_id), FROM(runs), WHERE(DAY), ORDER_BY("run_id")),
        lambda: q(SELECT(runs.run_id, jobs.team), FROM(runs), SEMI_JOIN(jobs, ON=equals(jobs.job_id, runs.job_id)), WHERE(DAY)),
        lambda: q(SELECT(runs.run_id), FROM(runs), LEFT_JOIN(jobs, ON=equals(jobs.job_id, runs.job_id)), WHERE(DAY, equals(jobs.team, "a"))),
        lambda: q(SELECT(jobs.team), FROM(jobs), FULL_JOIN(d := derived("d", q(SELECT(runs.job_id), FROM(runs), WHERE(DAY))), ON=equals(d.job_id, jobs.job_id), many_matches=True), WHERE(equals(jobs.team, "a"))),
        lambda: q(SELECT(jobs.team), FROM(jobs), JOIN(jobs, ON=equals(jobs.job_id, jobs.job_id))),
        lambda: q(SELECT(runs.run_id), WHERE(DAY), FROM(runs)),
        lambda: WHERE(more_than(count_rows(), 1)),
        lambda: sum_of(runs.mins, over=window(runs.job_id, runs.run_id)),
        lambda: row_number(PARTITION_BY=runs.job_id),
        lambda: sql_function("upper"),
        lambda: sql_function("ngrams", runs.status),
        lambda: sql_function("rank", runs.status),
        lambda: LIMIT(0),
        lambda: UNION(q(SELECT(jobs.team), FROM(jobs)), q(SELECT(jobs.job_id), FROM(jobs))),
        lambda: UNION(q(SELECT(jobs.team), FROM(jobs)), q(SELECT(AS(jobs.job_id, "team")), FROM(jobs))),
        lambda: check_type("decimal(40,2)"),
        lambda: check_type("map<array<int>,int>"),
    ],
)
def test_refused(build):
    with pytest.raises(GuardRefused):
        build()


def test_unbounded_partitions_are_refused():
    with pytest.raises(LoadRefused):
        q(SELECT(runs.run_id), FROM(runs))
    q(SELECT(runs.run_id), FROM(runs, reads_all_partitions=True))
    q(SELECT(runs.run_id), FROM(runs), JOIN(alerts, ON=all_of(equals(alerts.run_id, runs.run_id), equals(alerts.dt, runs.dt)), many_matches=True), WHERE(DAY))
    with pytest.raises(LoadRefused):
        q(SELECT(runs.run_id), FROM(runs), LEFT_JOIN(alerts, ON=equals(alerts.run_id, runs.run_id), many_matches=True), WHERE(DAY))


def test_comparisons_and_truth_are_no_conditions():
    with pytest.raises(TypeError):
        runs.run_id > 5  # noqa: B015
    with pytest.raises(TypeError):
        bool(DAY)
    with pytest.raises(AttributeError, match="did you mean status"):
        runs.statu  # noqa: B018


def test_repeated_rows_warn():
    with pytest.warns(RepeatedRowsWarning):
        q(SELECT(jobs.team), FROM(jobs), JOIN(runs, ON=equals(runs.job_id, jobs.job_id)), WHERE(DAY))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        q(SELECT(runs.run_id, jobs.team), FROM(runs), JOIN(jobs, ON=equals(jobs.job_id, runs.job_id)), WHERE(DAY))


def test_keys():
    base = q(SELECT(runs.run_id, jobs.team), FROM(runs), JOIN(jobs, ON=equals(jobs.job_id, runs.job_id)), WHERE(DAY))
    assert base.key == ("run_id",)
    assert q(SELECT(jobs.team, AS(count_rows(), "n")), FROM(jobs), GROUP_BY(jobs.team)).key == ("team",)
    assert q(SELECT(AS(count_rows(), "n")), FROM(jobs)).key == ()
    assert q(SELECT_DISTINCT(jobs.team), FROM(jobs)).key == ("team",)
    assert q(SELECT(jobs.team), FROM(jobs)).key is None
    assert q(SELECT(jobs.team, AS(count_rows(), "n")), FROM(jobs), GROUP_BY(rollup(jobs.team))).key is None
    assert q(SELECT(jobs.job_id, jobs.team, AS(count_rows(), "n")), FROM(jobs), GROUP_BY(jobs.job_id, jobs.team)).key == ("job_id",)
    assert q(SELECT(runs.job_id, AS(row_number(PARTITION_BY=runs.job_id, ORDER_BY=runs.run_id), "place")), FROM(runs), WHERE(DAY)).key == ("job_id", "place")


def test_worked_rows(example):
    failed = q(SELECT(runs.run_id), FROM(runs), WHERE(DAY, equals(runs.status, "FAILED")))
    high = q(SELECT(alerts.run_id), FROM(alerts), WHERE(equals(alerts.dt, "2026-09-24"), equals(alerts.severity, "high")))
    rows = lambda s: sorted(r[0] for r in s.lower(example).collect())
    assert rows(UNION_ALL(failed, high)) == [101, 102, 102]
    assert rows(UNION(failed, high)) == [101, 102]
    assert rows(INTERSECT(failed, high)) == [102]
    assert rows(EXCEPT(high, failed)) == [101]
    assert rows(q(SELECT(runs.run_id), FROM(runs), WHERE(equals(runs.dt, "2026-09-23"), not_equals(runs.status, "TEST")))) == [97]
    assert rows(q(SELECT(AS(fill_null(max_of(runs.run_id), 0), "x")), FROM(runs), WHERE(equals(runs.dt, "none")))) == [0]
    with pytest.raises(LoadRefused):
        run_query(UNION_ALL(failed, high), example, rows=3)


def test_last_n_days():
    set_clock(lambda: datetime.datetime(2026, 9, 25, tzinfo=datetime.UTC))
    try:
        assert [a.args[0] for a in last_n_days(runs.dt, 7).expr.args[1:]] == ["2026-09-18", "2026-09-24"]
        assert last_n_days(runs.dt, 1).expr.op == "="
    finally:
        set_clock(None)


def test_anti_join_is_one_and_filters_reach_the_scan(spark):
    from plumbline.fixtures import catalog, lineitem, orders

    s = q(SELECT(orders.o_orderkey), FROM(orders), ANTI_JOIN(lineitem, ON=equals(lineitem.l_orderkey, orders.o_orderkey)), WHERE(at_most(orders.o_orderkey, 100)))
    plan = s.lower(catalog(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "PushedFilters: [IsNotNull(o_orderkey), LessThanOrEqual(o_orderkey,100)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_tables(spark, example):
    df = example["ops.run_alerts"]
    assert [tuple(r) for r in check_key(df, ["run_id"]).collect()] == [(101, 2)]
    assert check_reference(alerts, df) and not check_reference(alerts, df.drop("dt").selectExpr("*", "1 AS new"))
    assert propose_key(df) == ("alert_id",)
    assert literal(True).kind == "boolean" and count_distinct(runs.job_id).why_not_additive and is_null(jobs.team).keeps == {"jobs"}


@pytest.mark.parametrize("partitions", [1, 3])
def test_rows_that_tie_give_the_least_value(spark, partitions):
    ties = Table("ties", {"k": "int", "n": "bigint", "t": "string", "x": "double", "m": "map<string,int>", "y": "double"}, key=["n"])
    least = -(2**63)
    made = [(1, None, None, None, None, 5.0), (1, 9, "ab", 9.5, {"a": 1}, 5.0), (1, 10, "a", 10.5, {"b": 1}, 5.0), (1, 11, "b", 11.5, {"c": 1}, 5.0), (1, 1, "0", 1.5, None, None),
            (2, least, "é", 0.0, None, 0.0), (2, 3, "z", -2.0, None, -0.0), (3, 4, "u", 4.0, None, None)]
    for given in (made, made[::-1]):
        df = spark.createDataFrame(given, ties.schema()).repartition(partitions)
        for f in ("min_by", "max_by"):
            s = q(SELECT(ties.k, *[AS(sql_function(f, ties[c], ties.y), c) for c in ("n", "t", "x")], AS(sql_function(f, ties.m, ties.y), "m")), FROM(ties), GROUP_BY(ties.k))
            got = {r[0]: tuple(r[1:4]) for r in s.lower({"ties": df}.get).collect()}
            assert got == {1: (9, "a", 9.5), 2: (least, "z", -2.0), 3: (None, None, None)}
