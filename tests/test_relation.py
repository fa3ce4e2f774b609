import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import aggregates as A
from tessera.functions.scalars import REGISTRY as S
from tessera.operators import ORACLE_SQL, QUERIES
from tessera.plans import Relation, changes
from tessera.sources import literal

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def rows(r):
    return sorted((tuple(x) for x in (r.df if isinstance(r, Relation) else r).collect()), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_projection_is_distinct_only_without_a_key(spark):
    t = literal(spark, [(1, "a"), (2, "a")], "id int, x string", ["id"])
    assert "Aggregate" not in t.over("id", "x").df._jdf.queryExecution().optimizedPlan().toString()
    assert rows(t.over("x")) == [("a",)]


def test_nil_rules(spark):
    t = literal(spark, [(1, "Blah"), (2, None), (3, None)], "id int, x string", ["id"])
    assert rows(t.over("x")) == [("Blah",), (None,)]
    assert rows(t.group(["x"], n=A.count())) == [("Blah", 1), (None, 2)]
    assert rows(t.join(t.rename({"id": "id2"}))) == [("Blah", 1, 1)]
    assert rows(t.quota(1, "x")) == [(2, None), (3, None)]
    assert rows(t.minus(t)) == [] and t.equals(t) and t.compare(t) == 0
    assert rows(t.where("x = x")) == [(1, "Blah")]
    assert t.quota(None, "x").df.count() == 0


def test_keys_of_joins(spark):
    a = literal(spark, [(1, 10), (2, 10)], "id int, g int", ["id"])
    b = literal(spark, [(10, "x")], "g int, name string", ["g"])
    assert a.join(b).keys == {frozenset(["id"])}
    assert b.join(a).keys == {frozenset(["id"])}
    with pytest.raises(ValueError):
        a.times(a)
    with pytest.raises(ValueError):
        a.row()


def test_explode_depth_first(spark):
    t = literal(spark, [(1, None), (2, 1), (3, 1), (4, 2)], "id int, up int", ["id"])
    got = t.explode("up is null", ("id", "up"), order=["id"]).df.orderBy("sequence").collect()
    assert [(r.id, r.level, r.sequence) for r in got] == [(1, 1, 1), (2, 2, 2), (4, 3, 3), (3, 2, 4)]
    loop = literal(spark, [(1, 2), (2, 1)], "id int, up int", ["id"])
    with pytest.raises(RecursionError):
        loop.explode("id = 1", ("id", "up"), most=4)


@pytest.mark.parametrize(("made", "want"), [
    (lambda: S["div"](-7, 2), -3), (lambda: S["compare"](1, 2), -1), (lambda: S["pos"]("b", "abc"), 1), (lambda: S["pos"]("z", "abc"), -1),
    (lambda: S["char_at"]("abc", 5), ""), (lambda: S["substring"]("abcdef", 2, 3), "cde"), (lambda: S["pad_left"]("abc", 2), "abc"),
    (lambda: S["count_of"]("aaaa", "aa"), 3), (lambda: S["last_index_of"]("abcabc", "bc"), 4), (lambda: S["between"](5, 6, F.lit(None).cast("int")), None),
    (lambda: S["day_of_week"](F.to_date(F.lit("2024-02-04"))), 0), (lambda: S["to_integer"](2.5), 2), (lambda: S["is_upper"]("AB"), True),
    (lambda: S["is_upper"]("A-1"), True), (lambda: S["is_upper"]("Ab"), False), (lambda: S["is_letter"](""), True),
    (lambda: S["last_index_of_start"]("abcabc", "bc", 4), 1), (lambda: S["index_of_range"]("abcabc", "c", 3, 2), -1), (lambda: S["index_of_range"]("abcabc", "c", 3, 3), 5),
    (lambda: S["unicode"]("aé😀"), [97, 233, 128512]), (lambda: S["from_unicode"](S["unicode"]("aé😀")), "aé😀"), (lambda: S["unicode"](""), []),
    (lambda: S["html_decode"](S["html_encode"]("<a&amp;>")), "<a&amp;>"), (lambda: S["concat_list"](F.array(F.lit("a"), F.lit(None).cast("string"))), None),
    (lambda: S["list_last_index_of"](F.array(*map(F.lit, (1, 2, 1))), 1), 2), (lambda: S["list_remove"](F.array(*map(F.lit, (1, 2, 1))), 1), [2, 1]),
    (lambda: S["to_guid"]("{0F8FAD5B-D9CB-469F-A165-70867728950E}"), "0f8fad5b-d9cb-469f-a165-70867728950e"), (lambda: S["to_byte"](254.5), 254),
    (lambda: S["span_millisecond"](S["time_span"](1, 2, 3, 4, 567)), 567), (lambda: S["span_second"](S["time_span"](1, 2, 3, 4, 567)), 4),
    (lambda: S["total_hours"](S["time_span"](1, 12)), 36), (lambda: S["span_ratio"](S["span_hours"](3), S["span_minutes"](90)), 2),
    (lambda: S["total_minutes"](S["span_multiply"](S["span_hours"](1), 1.5)), 90), (lambda: S["date_ticks"](S["from_ticks"](630822816000000000)), 630822816000000000),
    (lambda: S["with_month"](S["date_time"](2020, 5, 6, 7, 8, 9, 250), 2).cast("string"), "2020-02-06 07:08:09.25"),
    (lambda: S["total_minutes"](S["time_part"](S["date_time"](2020, 5, 6, 7, 8))), 428), (lambda: S["dynamic_get"]('{"a": [1, 2]}', "$.a[1]", "int"), 2),
    (lambda: S["random_between"](3, 3), 3), (lambda: S["total_ticks"](S["span_ticks"](70)), 70),
    (lambda: S["remove"]("abcdef", 1, 2), "adef"), (lambda: S["insert"]("ad", 1, "bc"), "abcd"), (lambda: S["days_in_month"](F.to_date(F.lit("2024-02-04"))), 29),
])
def test_scalars(spark, made, want):
    assert spark.range(1).select(made()).first()[0] == want


def test_outer_join_keys_and_numbers(spark):
    a = literal(spark, [(1, "x"), (2, "y"), (3, "z")], "id int, n string", ["id"])
    b = literal(spark, [(10, 1)], "k int, of int", ["k"])
    met = a.left_join(b, {"id": "of"})
    assert frozenset(["k"]) not in met.keys and rows(met.over("k")) == [(10,), (None,)]
    assert rows(b.right_join(a, {"of": "id"}).over("k")) == [(10,), (None,)]
    assert rows(a.full_join(b, {"id": "of"})) == [(1, "x", 10, 1), (2, "y", None, None), (3, "z", None, None)]
    assert rows(a.rename("r").over("r.n")) == [("x",), ("y",), ("z",)]
    many = literal(spark, [(i, i % 7) for i in range(500)], "id int, g int", ["id"]).order("-g", "id", sequence="s").df.orderBy("s").collect()
    assert [r.s for r in many] == list(range(1, 501)) and [(-r.g, r.id) for r in many] == sorted((-r.g, r.id) for r in many)
    assert rows(a.where("id > 5").order("id", sequence="s")) == []


def test_changes(spark):
    t = literal(spark, [(1, 5), (2, None), (3, -5)], "id int, x int", ["id"])
    assert rows(changes.delete(t, "x > 0")) == [(2, None), (3, -5)]
    assert rows(changes.update(t, "x < 0", x="x * 2")) == [(1, 5), (2, None), (3, -10)]
    assert rows(changes.insert(t, literal(spark, [(4,)], "id int", ["id"]))) == [(1, 5), (2, None), (3, -5), (4, None)]
    child = literal(spark, [("a", 1), ("b", 3), ("c", None)], "k string, of int", ["k"])
    gone = t.where("x < 0")
    assert rows(changes.delete_referring(child, gone, {"of": "id"})) == [("a", 1), ("c", None)]
    assert rows(changes.clear_referring(child, gone, {"of": "id"})) == [("a", 1), ("b", None), ("c", None)]
    assert rows(changes.clear_referring(child, gone, {"of": "id"}, of="1")) == [("a", 1), ("b", 1), ("c", None)]


def test_round_goes_up_at_halves(spark):
    assert float(spark.range(1).select(S["round"](F.lit("-2.5").cast("decimal(3,1)"), 0)).first()[0]) == -2.0
