from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hemiciclo.operators import aggregates, dedup, filters, joins, limits, windows
from hemiciclo.plans import services


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_token_subset_prefers_exact(spark):
    people = spark.createDataFrame([("Ruiz Sol, Ana",), ("Ruiz, Ana",), ("Gil, Eva",)], "full_name string")
    wanted = spark.createDataFrame([("ana ruiz",), ("eva",), ("nadie",)], "w string")
    out = joins.token_subset_join(people, wanted, name="full_name", wanted_name="w")
    assert rows(out.select("w", "full_name", "matched_exactly"), "w") == [("ana ruiz", "Ruiz, Ana", True), ("eva", "Gil, Eva", False)]


def test_range_join_closed_end(spark):
    points = spark.createDataFrame([(1, 0), (1, 5), (1, 9), (1, 10)], "d int, at int")
    spans = spark.createDataFrame([(1, 0, 5, False, 1), (1, 5, 10, True, 2)], "d int, s int, e int, last boolean, page int")
    out = joins.range_join(points, spans, ["d"], at="at", start="s", end="e", closed="last", width=4)
    assert rows(out.select("at", "page"), "at") == [(0, 1), (5, 2), (9, 2), (10, 2)]


def test_nth_match_is_clamped(spark):
    left = spark.createDataFrame([("a", 0), ("a", 5), ("b", 0)], "k string, occurrence int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, o int, v string")
    assert rows(joins.nth_match(left, right, ["k"], occurrence="occurrence", order=["o"]).select("k", "occurrence", "v"), "k", "occurrence") == [("a", 0, "x"), ("a", 5, "y"), ("b", 0, None)]


def test_reconcile_and_sets(spark):
    e, a = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,), (3,)], "k int")
    assert tuple(joins.reconcile(e, a, ["k"]).first()) == (2, 2, 1, 1, 1)
    assert not joins.sets_equal(e, a).first()["equal"]
    assert joins.sets_equal(e, e.union(e)).first()["equal"]


def test_smallest_container(spark):
    p = spark.createDataFrame([(1, 5.0, 5.0), (1, 50.0, 50.0)], "d int, x double, y double")
    b = spark.createDataFrame([(1, [0.0, 0.0, 10.0, 10.0], "big"), (1, [4.0, 4.0, 6.0, 6.0], "small")], "d int, box array<double>, name string")
    assert rows(joins.smallest_container(p, b, ["d"], x="x", y="y", box="box").select("x", "name"), "x") == [(5.0, "small"), (50.0, None)]


def test_smallest_container_does_not_broadcast_boxes(spark):
    p = spark.sql("select * from values (1, 5D, 5D), (2, 5D, 5D), (null, 5D, 5D) as p(d, x, y)")
    b = spark.sql("select * from values (1, array(0D, 0D, 300D, 300D), 'big'), (1, array(4D, 4D, 6D, 6D), 'small'), (2, array(5D, 5D, 5D, 5D), 'point'), (2, array(0D, 0D, 3D, 3D), 'other'), (null, array(0D, 0D, 9D, 9D), 'none') as b(d, box, name)")
    out = joins.smallest_container(p, b, ["d"], x="x", y="y", box="box")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [d#" in plan and "BroadcastHashJoin [d#" not in plan
    assert {(r.d, r.name) for r in out.collect()} == {(1, "small"), (2, "point"), (None, None)}


def test_smallest_box_of_a_row(spark):
    boxes = [("big", [0.0, 0.0, 10.0, 10.0]), ("small", [4.0, 4.0, 6.0, 6.0]), ("as small", [5.0, 5.0, 7.0, 7.0]), ("inverted", [6.0, 6.0, 4.0, 4.0]), ("none", None)]
    points = spark.createDataFrame([(1, 5.0, 5.0, boxes), (2, 10.0, 0.0, boxes), (3, 10.1, 5.0, boxes), (4, 7.0, 7.0, boxes), (5, 5.0, 5.0, []), (6, 5.0, 5.0, None), (7, None, 5.0, boxes)], "k int, x double, y double, b array<struct<name: string, box: array<double>>>")
    found = points.select("k", joins.smallest_box(F.col("b"), x=F.col("x"), y=F.col("y"), box="box").alias("place"))
    assert rows(found, "k") == [(1, 1), (2, 0), (3, None), (4, 2), (5, None), (6, None), (7, None)]


def test_most_complete_first_of_ties(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (1, 2, 0, "y"), (1, 3, 5, "z"), (2, 4, None, "")], "id int, pos int, n int, t string")
    assert rows(dedup.most_complete(df, ["id"], ["pos"]), "id") == [(1, 2, 0, "y"), (2, 4, None, "")]


def test_keep_order_last_wins(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "pos int, k string, v int")
    assert [(r["k"], r["v"]) for r in dedup.keep_order(df, ["k"], "pos").collect()] == [("a", 3), ("b", 2)]


def test_occurrence_is_dense(spark):
    df = spark.createDataFrame([("d", "10:00"), ("d", "10:00"), ("d", "11:00"), ("d", None)], "d string, s string")
    assert rows(windows.occurrence_index(df, ["d"], ["s"]).select("s", "occurrence"), "occurrence", "s") == [(None, 0), ("10:00", 1), ("10:00", 1), ("11:00", 2)]


def test_islands_and_markers(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbba")], "k int, i int, v string")
    assert rows(windows.islands(df, ["k"], ["i"], F.col("v"), 2).select("value", "n", "first", "last"), "first") == [("a", 2, 0, 1), ("b", 3, 2, 4)]
    kept = windows.between_markers(df, ["k"], ["i"], F.col("i") == 1, F.col("i") == 4)
    assert rows(kept.select("i"), "i") == [(2,), (3,)]


def test_char_windows(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, "abc")], "k int, t string")
    assert rows(windows.char_windows(df, "t", size=4, overlap=1).select("k", "chunk", "start", "piece"), "k", "chunk") == [(1, 0, 0, "abcd"), (1, 1, 3, "defg"), (1, 2, 6, "ghij"), (3, 0, 0, "abc")]
    with pytest.raises(Exception, match="more than 2"):
        windows.char_windows(df, "t", size=4, overlap=1, most=2).count()


def test_fold_lines(spark):
    df = spark.createDataFrame([(["Uno", "sigue", "Dos.", "tres"],), ([],)], "l array<string>")
    out = windows.fold_lines(F.col("l"), lambda grown, line: line.rlike("^[a-z]") & ~grown.endswith("."))
    assert [r[0] for r in df.select(out).collect()] == [["Uno sigue", "Dos.", "tres"], []]


def test_repeated_lines_and_gates(spark):
    df = spark.createDataFrame([("s", 1, "x"), ("s", 1, "x"), ("s", 2, "x"), ("s", 2, "y")], "s string, p int, l string")
    assert rows(aggregates.repeated_lines(df, ["s"], "l", "p", 2), "l") == [("s", "x", 2)]
    g = aggregates.gates(df, {"some": F.count("*") > 0, "none": F.max("p") > 5}).first()
    assert (g["some"], g["none"], g["passed"]) == (True, False, False)


def test_caps_raise(spark):
    with pytest.raises(limits.IncompleteResult):
        limits.ensure_at_most(spark.range(3), 2)
    assert len(limits.collect_at_most(spark.range(3), 3)) == 3


def test_domain_predicate_null_rules(spark):
    df = spark.createDataFrame([("a", None, "Ruiz, Ana", None), ("b", "14", "Ruiz, Ana", dt.date(2020, 1, 1)), ("c", "foo", "Ruiz, Ana", None), ("d", "15", None, None), ("e", "15", "Ruiz Gil, Ana", dt.date(2026, 1, 1))], "id string, legislature string, full_name string, vote_date date")
    kept = df.where(filters.matches(df, {"name": "ana RUÍZ"}, legislatures=("XV",), date_to=dt.date(2025, 1, 1)))
    assert rows(kept.select("id"), "id") == [("a",)]
    assert df.where(filters.matches(df, {"missing_field": "x"})).count() == 0


def test_query_bounds(spark):
    q = services.Query(legislatures=(15, "XV", "Leg.14"), last_months=1, today=dt.date(2024, 3, 31))
    assert q.legislatures == ("XV", "XIV") and q.date_from == dt.date(2024, 2, 29)
    for bad in ({"legislatures": ("foo",)}, {"max_results": 0}, {"date_from": dt.date(2025, 1, 1), "date_to": dt.date(2024, 1, 1)}):
        with pytest.raises(services.QueryError):
            services.Query(**bad)
    with pytest.raises(services.QueryError):
        services.search(spark.range(1), services.Query(filters={"nope": "x"}), identity="id", service="organs")


def test_resolve_person(spark):
    index = spark.createDataFrame([("1", "Ruiz, Ana"), ("2", "Ruiz Gil, Ana"), ("3", "Sol, Luis"), ("4", "Sol Paz, Luis"), ("5", "Sol Gil, Luis")], "deputy_id string, full_name string")
    assert services.resolve_person(index, name="ana ruiz") == "1"
    with pytest.raises(services.AmbiguousIdentity):
        services.resolve_person(index.where("deputy_id > 3"), name="luis sol")
    with pytest.raises(services.IdentityNotFound):
        services.resolve_person(index, name="nadie")
