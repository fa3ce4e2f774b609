"""Each operator of the algebra applied to whole tables, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sql, streaming
from ..functions import aggregates as A
from ..functions.scalars import REGISTRY as S
from ..plans import Relation
from ..sources import key_violations, literal, upsert, violations

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "events": ["event_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
    "documents": ["doc_id"], "labels": ["doc_id"], "pages": ["page_id"], "embeddings": ["vec_id"],
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rel(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    """A driver table. lineitem has no key that holds: it is read as the bag it
    is and made a set where needed."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Relation.of(df, KEYS[name]) if name in KEYS else Relation.bag(df)


def query(oracle: str | None = None):
    def add(f: Callable[[Callable[[str], Relation]], Relation | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = f(lambda name: rel(spark, sf_dir, name))
            return made.df if isinstance(made, Relation) else made

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def money(e: str) -> Column:
    return F.sum(F.expr(e).cast("decimal(18,4)")).cast("double")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS sum_base,
  count(*)::INT AS count_order, min(l_discount) AS min_disc, max(l_tax) AS max_tax
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(t):
    return t("lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").group(
        ["l_returnflag", "l_linestatus"], sum_qty=money("l_quantity"), sum_base=money("l_extendedprice"),
        count_order=A.count(), min_disc=A.least("l_discount"), max_tax=A.greatest("l_tax"))


@query("SELECT * FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def restrict(t):
    return t("customer").where("c_acctbal > 5000 and c_mktsegment = 'BUILDING'")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def project_distinct(t):
    return t("customer").over("c_nationkey", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer")
def project_key(t):
    return t("customer").over("c_custkey", "c_name")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def remove(t):
    return t("part").remove("p_partkey", "p_name", "p_size", "p_retailprice")


@query("SELECT o_orderkey AS id, o_totalprice * 2 AS twice, o_orderstatus AS status FROM orders")
def specify(t):
    return t("orders").specify(id="o_orderkey", twice="o_totalprice * 2", status="o_orderstatus")


@query("SELECT *, s_acctbal > 0 AS solvent, upper(s_name) AS shout FROM supplier")
def extend(t):
    return t("supplier").add(solvent="s_acctbal > 0", shout=F.upper("s_name"))


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def rename(t):
    return t("nation").rename({"n_nationkey": "id", "n_name": "name"})


@query("SELECT r_regionkey, lower(r_name) AS r_name FROM region")
def redefine(t):
    return t("region").redefine(r_name=F.lower("r_name"))


@query("SELECT * FROM region")
def adorn(t):
    return t("region").adorn(["r_name"], metadata={"r_name": {"title": "Region"}})


@query("SELECT n_regionkey, n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def natural_join(t):
    return t("nation").join(t("region").rename({"r_regionkey": "n_regionkey"}))


@query("SELECT * FROM orders JOIN customer ON o_custkey = c_custkey")
def join_by(t):
    return t("orders").join(t("customer"), {"o_custkey": "c_custkey"})


@query("SELECT * FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)")
def times(t):
    return t("region").times(t("customer").over("c_mktsegment"))


@query("SELECT c_custkey, o_orderkey, o_orderkey IS NOT NULL AS ordered FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def left_join_row_exists(t):
    big = t("orders").where("o_totalprice > 200000").over("o_orderkey", "o_custkey")
    return t("customer").over("c_custkey").left_join(big, {"c_custkey": "o_custkey"}, "ordered").over("c_custkey", "o_orderkey", "ordered")


@query("SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 200000) RIGHT JOIN customer ON c_custkey = o_custkey")
def right_join(t):
    return t("orders").where("o_totalprice > 200000").right_join(t("customer"), {"o_custkey": "c_custkey"}).df.select("o_orderkey", "c_custkey")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_lookup(t):
    return t("orders").left_lookup(t("customer"), {"o_custkey": "c_custkey"}).over("o_orderkey", "c_name")


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def having(t):
    return t("customer").having(t("orders"), {"c_custkey": "o_custkey"})


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def without(t):
    return t("customer").without(t("orders"), {"c_custkey": "o_custkey"})


@query("SELECT * FROM region WHERE EXISTS (SELECT 1 FROM part WHERE p_size > 40)")
def having_no_common(t):
    return t("region").having(t("part").where("p_size > 40"))


@query("""SELECT DISTINCT l_suppkey FROM lineitem l WHERE (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem k WHERE k.l_suppkey = l.l_suppkey)
  = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)""")
def divide(t):
    lines = t("lineitem").over("l_suppkey", "l_returnflag", "l_linestatus")
    return lines.divide(t("lineitem").over("l_returnflag", "l_linestatus"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(t):
    return t("customer").specify(k="c_nationkey").union(t("supplier").specify(k="s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def minus(t):
    return t("customer").specify(k="c_custkey").minus(t("orders").specify(k="o_custkey"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect(t):
    return t("customer").specify(k="c_custkey").intersect(t("orders").specify(k="o_custkey"))


@query("""SELECT o_custkey, count(*)::INT AS n, count(DISTINCT o_orderstatus)::INT AS kinds, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total,
  bool_and(o_totalprice > 1000) AS all_big, bool_or(o_totalprice > 300000) AS any_huge FROM orders GROUP BY o_custkey""")
def group(t):
    return t("orders").add(big="o_totalprice > 1000", huge="o_totalprice > 300000").group(
        ["o_custkey"], n=A.count(), kinds=A.count("o_orderstatus", distinct=True), total=money("o_totalprice"), all_big=A.every("big"), any_huge=A.some("huge"))


@query("SELECT count(*)::INT AS n, sum(p_size)::INT AS size, max(p_retailprice) AS top FROM part WHERE p_size < 0")
def group_without_by(t):
    return t("part").where("p_size < 0").group(n=A.count(), size=A.total("p_size"), top=A.greatest("p_retailprice"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def concat_aggregate(t):
    return t("nation").group(["n_regionkey"], names=A.concat("n_name", ", "))


@query("SELECT p_brand, sum(DISTINCT p_size)::INT AS sizes, round(avg(p_size::DECIMAL(28,10)), 6)::DOUBLE AS mean FROM part GROUP BY p_brand")
def distinct_sum_average(t):
    return t("part").group(["p_brand"], sizes=A.total("p_size", distinct=True), mean=F.round(A.average("p_size"), 6).cast("double"))


@query("SELECT c_mktsegment, arg_min(c_name, lower(c_name)) AS first_name, arg_max(c_name, lower(c_name)) AS last_name FROM customer GROUP BY c_mktsegment")
def text_extremes(t):
    return t("customer").group(["c_mktsegment"], first_name=A.least_text("c_name"), last_name=A.greatest_text("c_name"))


@query("SELECT n_regionkey, sum((n_nationkey * n_nationkey)::BIGINT)::BIGINT AS squares FROM nation GROUP BY n_regionkey")
def user_aggregate(t):
    return t("nation").group(["n_regionkey"], squares=A.custom("n_nationkey", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long")))


@query("SELECT *, row_number() OVER (ORDER BY n_regionkey, n_name DESC) AS seq FROM nation")
def order_sequence(t):
    return t("nation").order("n_regionkey", "-n_name", sequence="seq")


@query("SELECT * EXCLUDE r FROM (SELECT *, dense_rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 3")
def quota_ties(t):
    return t("part").quota(3, "-p_size")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 25")
def quota_key(t):
    return t("orders").quota(25)


@query("SELECT * FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 20")
def browse_page(t):
    return t("customer").browse("c_custkey", after={"c_custkey": 40}, page=20)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS id, n_name AS name, 1 AS level, [n_nationkey] AS path FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT n_nationkey, n_name, level + 1, list_append(path, n_nationkey) FROM nation JOIN e ON n_nationkey > 0 AND (n_nationkey - 1) // 3 = e.id)
  SELECT id, name, level, row_number() OVER (ORDER BY path) AS sequence FROM e""")
def explode(t):
    tree = t("nation").specify(id="n_nationkey", name="n_name", up="case when n_nationkey > 0 then cast(floor((n_nationkey - 1) / 3) as int) end")
    return tree.explode("id = 0", ("id", "up"), order=["id"]).df.select("id", "name", "level", "sequence")


@query("SELECT c_custkey, o.n AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*)::INT AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def correlated_count(t):
    counts = t("orders").group(["o_custkey"], n=A.count())
    return t("customer").left_join(counts, {"c_custkey": "o_custkey"}).over("c_custkey", "n")


@query("SELECT DISTINCT n_name, c_mktsegment FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < 0")
def sql_select(t):
    nation, customer = t("nation"), t("customer")
    return sql.select(nation.df.sparkSession, "SELECT n_name, c_mktsegment FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey WHERE c_acctbal < 0",
                      nation=nation, customer=customer)


@query("""SELECT s_suppkey, (s_acctbal > 0) <> (s_nationkey > 12) AS x, CASE WHEN s_acctbal < 0 THEN -1 WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS c,
  (floor(s_acctbal::DECIMAL(28,10) * 10 + 0.5) / 10)::DOUBLE AS r, length(s_name)::INT AS n, substr(s_name, 2, 3) AS mid, strpos(s_name, '#')::INT - 1 AS at,
  trunc(s_suppkey / 7)::BIGINT AS d FROM supplier""")
def scalar_functions(t):
    return t("supplier").df.select(
        "s_suppkey", S["xor"](F.col("s_acctbal") > 0, F.col("s_nationkey") > 12).alias("x"), S["compare"](F.col("s_acctbal"), F.lit(0.0)).alias("c"),
        S["round"](F.col("s_acctbal"), 1).cast("double").alias("r"), S["length"](F.col("s_name")).alias("n"), S["substring"](F.col("s_name"), 1, 3).alias("mid"),
        S["pos"]("#", F.col("s_name")).alias("at"), S["div"](F.col("s_suppkey"), 7).alias("d"))


@query("""SELECT o_orderkey, dayofweek(o_orderdate)::INT AS dow, day(last_day(o_orderdate))::INT AS dim, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) AS leap,
  ((1998 - year(o_orderdate)) * 12 + 12 - month(o_orderdate))::INT AS months FROM orders""")
def date_functions(t):
    d = F.col("o_orderdate")
    return t("orders").df.select("o_orderkey", S["day_of_week"](d).alias("dow"), S["days_in_month"](d).alias("dim"), S["is_leap_year"](F.year(d)).alias("leap"),
                                 S["months_between"](d, F.lit("1998-12-01").cast("date")).alias("months"))


@query("SELECT c_custkey, c_acctbal BETWEEN 0 AND 1000 AS low, c_mktsegment IN ('BUILDING', 'MACHINERY') AS heavy, c_name LIKE '%1' AS one, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS seg FROM customer")
def predicates(t):
    return t("customer").df.select("c_custkey", S["between"](F.col("c_acctbal"), 0, 1000).alias("low"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("heavy"),
                                   F.col("c_name").like("%1").alias("one"), S["if_nil"](F.expr("nullif(c_mktsegment, 'BUILDING')"), "-").alias("seg"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey IN (1, 2) THEN 'changed' ELSE r_name END AS r_name FROM region UNION SELECT 99, 'new'")
def upsert_rows(t):
    region = t("region")
    rows = literal(region.df.sparkSession, [(1, "changed"), (2, "changed"), (99, "new")], "r_regionkey int, r_name string", ["r_regionkey"])
    return upsert(region, rows, ["r_regionkey"])


@query("SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def reference_violations(t):
    return violations(t("orders").df, t("customer").where("c_acctbal > 0").df, {"o_custkey": "c_custkey"})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_violation_report(t):
    return key_violations(t("lineitem").df, ["l_orderkey", "l_linenumber"])


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*)::INT AS n FROM events GROUP BY ALL")
def windowed_events(t):
    return streaming.windowed(t("events").df, "ts", "1 hour", ["event_type"], n=A.count())


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def dynamic_get(t):
    return t("events").df.select("event_id", F.get_json_object("props", "$.k").alias("k"))
