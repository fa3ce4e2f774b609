"""Rules of the algebra on small relations, and streams that really run."""

import warnings

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera import sources, streaming
from tessera.functions import aggregates as A
from tessera.functions import rows as R
from tessera.functions import user
from tessera.functions.scalars import REGISTRY as S
from tessera.plans import Relation, changes
from tessera.sources import literal


def rows(r):
    return sorted((tuple(x) for x in (r.df if isinstance(r, Relation) else r).collect()), key=str)


def one(spark, **made):
    return spark.range(1).select(*(c.alias(n) for n, c in made.items())).first()


def test_sums_keep_their_type(spark):
    t = literal(spark, [(1, 2147483647), (2, 5)], "id int, x int", ["id"])
    with pytest.raises(PySparkException):
        t.group(s=A.total("x")).df.collect()
    assert t.where("id = 2").group(s=A.total("x")).df.dtypes == [("s", "int")]
    longs = literal(spark, [(1, 2**63 - 1), (2, 1)], "id int, x bigint", ["id"])
    with pytest.raises(PySparkException):
        longs.group(s=A.total("x")).df.collect()
    assert rows(t.where("id > 9").group(s=A.total("x"), n=A.count())) == [(None, 0)]


def test_texts_and_nil(spark):
    t = literal(spark, [(1, "b"), (2, None), (3, "A"), (4, None)], "id int, x string", ["id"])
    assert rows(t.group(low=A.least_text("x"), high=A.greatest_text("x"))) == [("A", "b")]
    assert rows(t.where("x is null").group(low=A.least_text("x"))) == [(None,)]
    assert rows(t.group(c=A.concat("x", "'\\"))) == [("A'\\b",)]


def test_browse_with_nil(spark):
    t = literal(spark, [(1, 1), (2, None), (3, None), (4, 2)], "id int, x int", ["id"])
    ids = lambda r: [x.id for x in r.df.collect()]
    assert ids(t.browse("-x", "id", after={"x": 1, "id": 1})) == [2, 3]
    assert ids(t.browse("x", "id", after={"x": None, "id": 2})) == [3, 1, 4]
    assert ids(t.browse("x", "id", before={"x": 1, "id": 1})) == [2, 3]
    assert ids(t.browse("-x", "id", before={"x": None, "id": 3}, page=2)) == [1, 2]
    for order in (("x", "id"), ("-x", "-id")):
        whole, page, seen = t.browse(*order).df.collect(), None, []
        while True:
            page = t.browse(*order, after=page, page=1).df.collect()
            if not page:
                break
            seen, page = seen + page, page[0].asDict()
        assert seen == whole


def test_divide_with_nil_and_empty(spark):
    t = literal(spark, [(1, "a"), (1, None), (2, "a"), (3, None)], "id int, x string")
    of = lambda *values: literal(spark, [(v,) for v in values], "x string")
    assert rows(t.divide(of("a", None))) == [(1,)] and rows(t.divide(of(None))) == [(1,), (3,)]
    assert rows(t.divide(of("a").where("false"))) == [(1,), (2,), (3,)] and rows(t.divide(of("a", "b"))) == []
    plan = t.divide(of("a")).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "LeftAnti" not in plan


def test_texts_by_place_and_replaced(spark):
    got = one(spark, a=S["index_of"](F.lit("abcabc"), F.lit("c"), 3), b=S["index_of"](F.lit("abcabc"), "c", 3), c=S["replace"](F.lit("aBb"), "B", "$1\\", ignore_case=True),
              d=S["replace"](F.lit("x\\Ey\\E"), "\\e", "-", ignore_case=True), e=S["index_of"](F.lit("abc"), "z", 1))
    assert tuple(got) == (5, 5, "a$1\\$1\\", "x-y-", -1)


def test_inserts_are_sets_and_bags_are_not_trusted(spark):
    t = literal(spark, [(1, "a")], "id int, x string", ["id"])
    assert rows(changes.insert(t, literal(spark, [(1, "a"), (2, None)], "id int, x string", ["id"]))) == [(1, "a"), (2, None)]
    bag = Relation.bag(spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "a int, b int"))
    assert rows(bag.over("a")) == [(1,)] and rows(bag.over("a", "b")) == [(1, 2), (1, 3)] and rows(bag.where("b = 2").specify(a="a", b="b")) == [(1, 2)]
    assert rows(bag.group(["a"], n=A.count())) == [(1, 3)]


def test_keys_from_values_and_copies(spark):
    t = literal(spark, [(1, 10), (2, 10)], "id int, g int", ["id", "g"])
    assert t.where(g=10).keys == {frozenset(["id"])} and t.where("g = 10").keys == {frozenset(["id", "g"])}
    assert t.add(k="id").keys == {frozenset(["id", "g"]), frozenset(["k", "g"])}
    assert t.add(k="id + 1").keys == t.keys


def test_types_meet_or_fail(spark):
    ints, longs, texts = (literal(spark, [(v,)], f"x {kind}") for v, kind in ((1, "int"), (1, "bigint"), ("a", "string")))
    assert ints.union(longs).df.dtypes == [("x", "bigint")] and rows(ints.union(longs)) == [(1,)]
    assert rows(ints.minus(longs)) == [] and rows(ints.intersect(longs)) == [(1,)]
    with pytest.raises(ValueError, match="no conversion"):
        ints.union(texts)
    with pytest.raises(ValueError, match="different columns"):
        ints.union(literal(spark, [(1,)], "y int"))


def test_comparisons_of_sets(spark):
    a, b, c = (literal(spark, [(v,) for v in values], "x int") for values in ([1, None], [None, 1, 2], [7]))
    assert a.proper_subset_of(b) and b.proper_superset_of(a) and b.superset_of(a) and a.differs(b) and a.compare(b) == -1 and b.compare(a) == 1
    assert tuple(a.comparison(b).first()) == (False, True, True, True, False, False, -1) and tuple(a.comparison(a).first())[-1] == 0
    assert a.comparison(c).first().compared is None
    with pytest.raises(ValueError):
        a.compare(c)


def test_membership_of_scalars_and_rows(spark):
    t = literal(spark, [(1, 1), (2, 2), (3, None)], "id int, x int", ["id"])
    of = lambda *values: literal(spark, [(v,) for v in values], "y int")
    flags = lambda r: [x.f for x in r.df.orderBy("id").collect()]
    assert flags(t.member("f", of(1), {"x": "y"})) == [True, False, None]
    assert flags(t.member("f", of(1, None), {"x": "y"})) == [True, None, None]
    assert flags(t.member("f", of(1).where("false"), {"x": "y"})) == [False, False, False]
    pairs = literal(spark, [(3, None), (1, 2)], "a int, b int")
    assert flags(t.member("f", pairs, {"id": "a", "x": "b"})) == [False, False, True]


def test_aggregates_in_parts(spark):
    t = Relation.bag(spark.range(1000).selectExpr("id", "id % 3 as g", "cast(id as double) as x"))
    made = t.aggregate(["g"], "s", ["x", "g"], F.lit(0.0), lambda s, r: s + r["x"] * r["g"], lambda a, b: a + b, lambda s: s / 2, parts=7)
    assert rows(made) == [(g, sum(x * g for x in range(g, 1000, 3)) / 2) for g in range(3)]


def test_rows_as_values(spark):
    r = R.row(id=1, name="Joe")
    got = one(spark, a=R.add(r, x=F.lit(2)), b=R.over(r, "name"), c=R.remove(r, "id"), d=R.rename(r, ["id", "name"], {"id": "key"}), e=R.rename(r, ["id"], "p"),
              f=R.join(r, ["id", "name"], R.row(id=1, x=5), ["id", "x"]), g=R.join(r, ["id", "name"], R.row(id=2, x=5), ["id", "x"]), h=R.equals(R.row(a=F.lit(None)), R.row(a=F.lit(None))),
              i=R.redefine(r, name=F.lit("Jo")), j=R.list_of(1, 2))
    assert [x.asDict() if hasattr(x, "asDict") else x for x in got] == [
        {"id": 1, "name": "Joe", "x": 2}, {"name": "Joe"}, {"name": "Joe"}, {"key": 1, "name": "Joe"}, {"p.id": 1}, {"id": 1, "name": "Joe", "x": 5}, None, True, {"id": 1, "name": "Jo"}, [1, 2]]


def test_overloads_by_type(spark):
    f, df = user.Overloads("f"), spark.createDataFrame([(1, 2, "a", True)], "i int, l bigint, s string, b boolean")
    f.add("bigint")(lambda x: F.concat(F.lit("long "), x.cast("string")))
    f.add("double")(lambda x: F.concat(F.lit("double "), x.cast("string")))
    f.add("string", "string")(F.concat)
    assert df.select(f(df, "i"), f(df, "l"), f(df, "s", "s")).first()[:] == ("long 1", "long 2", "aa")
    for wrong in (("b",), ("s",), ("i", "s")):
        with pytest.raises(TypeError):
            f(df, *wrong)
    with pytest.raises(ValueError):
        f.add("bigint")(F.abs)


def test_explode_paths_and_cycles(spark):
    links = literal(spark, [("A", None), ("B", "A"), ("C", "A"), ("D", "B"), ("D", "C"), ("E", None)], "id string, up string")
    got = [(x.id, x.level, x.sequence) for x in links.explode("up is null", ("id", "up"), order=["id"]).df.orderBy("sequence").collect()]
    # D is below B and below C, and each way down meets both of its rows' parents.
    assert got == [("A", 1, 1), ("B", 2, 2), ("D", 3, 3), ("C", 2, 4), ("D", 3, 5), ("E", 1, 6)]
    ring = literal(spark, [(1, 2), (2, 1)], "id int, up int")
    with pytest.raises(RecursionError):
        ring.explode("id = 1", ("id", "up"), most=5)
    assert links.explode("false", ("id", "up")).df.count() == 0


def test_order_warns_where_it_is_not_unique(spark):
    t = literal(spark, [(1, "a"), (2, "a")], "id int, x string", ["id"])
    with pytest.warns(UserWarning, match="order"):
        t.order("x", sequence="n")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        t.order("x", "id", sequence="n")


def test_files_and_databases(spark, tmp_path):
    t = literal(spark, [(1, "a,b"), (2, None)], "id int, x string", ["id"])
    for kind in ("parquet", "json", "orc"):
        sources.save(t, str(tmp_path / kind), kind)
        back = sources.files(spark, str(tmp_path / kind), kind, ["id"]).df.selectExpr("cast(id as int) id", "x")
        assert rows(back) == rows(t)
    (tmp_path / "note.txt").write_text("first\nsecond", encoding="utf-8")
    assert [x.text for x in sources.text_file(spark, str(tmp_path / "note.txt")).df.collect()] == ["first\nsecond"]
    assert sources.listing(spark, str(tmp_path / "note.txt")).df.first().length == 12
    with pytest.raises(ValueError):
        sources.database(spark, "jdbc:none", table="t", query="select 1")


def test_databases(spark):
    url = "jdbc:derby:memory:tessera_test;create=true"
    t = literal(spark, [(k, f"name {k}") for k in range(20)], "id int, x string", ["id"])
    sources.store(t, url, "things")
    far = sources.database(spark, url, ["id"], table="things").where("id > 16").over("id", "x")
    assert rows(far) == [(k, f"name {k}") for k in (17, 18, 19)]
    assert "GreaterThan(id,16)" in far.df._jdf.queryExecution().executedPlan().toString()
    assert rows(sources.database(spark, url, query='SELECT count(*) AS "n" FROM things')) == [(20,)]
    sources.execute(spark, url, "CREATE TABLE owners (id INT NOT NULL PRIMARY KEY)", "CREATE TABLE pets (id INT, owner INT, CONSTRAINT owned FOREIGN KEY (owner) REFERENCES owners)",
                    "CREATE TABLE generators (id VARCHAR(40) NOT NULL PRIMARY KEY, next_key INT)")
    assert {"THINGS", "OWNERS", "PETS"} <= {x.name.upper() for x in sources.available_tables(spark, url, "APP").df.collect()}
    assert rows(sources.available_references(spark, url, "APP", "PETS")) == [("OWNED", 1, "OWNER", "OWNERS", "ID")]
    assert [sources.next_generator(spark, url, n, count=c) for n, c in (("a", 1), ("a", 5), ("a", 1), ("b", 1))] == [1, 2, 7, 1]


def test_streams_run_and_go_on(spark, tmp_path):
    feed, out, state = (str(tmp_path / x) for x in ("feed", "out", "state"))
    event = "id int, ts timestamp_ntz, kind string"

    def arrive(k, *made):
        spark.createDataFrame(made, "id int, t string, kind string").selectExpr("id", "cast(t as timestamp_ntz) ts", "kind").coalesce(1).write.mode("append").parquet(feed)
        stream = streaming.windowed(spark.readStream.schema(event).parquet(feed), "ts", "10 minutes", ["kind"], late="5 minutes", n=A.count())
        return rows(streaming.drained(stream, out, state).select("window_start", "kind", "n"))

    first = arrive(0, (1, "2024-01-01 00:01:00", "a"), (2, "2024-01-01 00:02:00", "a"), (3, "2024-01-01 00:21:00", "b"))
    assert [(str(t)[11:16], k, n) for t, k, n in first] == [("00:00", "a", 2)]
    # Too late for the closed window; a later event closes the next.
    second = arrive(1, (4, "2024-01-01 00:03:00", "a"), (5, "2024-01-01 00:22:00", "b"), (6, "2024-01-01 00:50:00", "b"))
    assert [(str(t)[11:16], k, n) for t, k, n in second] == [("00:00", "a", 2), ("00:20", "b", 2)]
