"""Queries of set comparison, rows, user operators, sources and the rest of the scalar families."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sources, streaming
from ..functions import aggregates as A
from ..functions import rows as R
from ..functions import user
from ..functions.scalars import REGISTRY as S
from ..plans import Relation
from ..plans.numbering import shared_dir
from .queries import query


def own_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Sets

@query("""SELECT false AS equal, true AS different, true AS subset, true AS proper_subset, false AS superset, false AS proper_superset, -1 AS compared
  WHERE NOT EXISTS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT c_custkey FROM customer)""")
def table_comparison(t):
    return t("customer").where("c_acctbal > 0").over("c_custkey").comparison(t("customer").over("c_custkey"))


@query("SELECT NOT EXISTS (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region) AS within")
def table_subset(t):
    nations, regions = t("nation").specify(k="n_regionkey"), t("region").specify(k="r_regionkey")
    return nations.df.sparkSession.range(1).select(nations.within(regions).alias("within"))


@query("""SELECT o_orderkey, nullif(o_custkey, 7) IN (SELECT nullif(c_custkey, 5) FROM customer WHERE c_acctbal > 0) AS asked,
  nullif(o_custkey, 7) IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS known FROM orders""")
def member_of(t):
    rich = t("customer").where("c_acctbal > 0")
    orders = t("orders").add(k="nullif(o_custkey, 7)")
    some = rich.specify(c="nullif(c_custkey, 5)")
    return orders.member("asked", some, {"k": "c"}).member("known", rich, {"k": "c_custkey"}).df.select("o_orderkey", "asked", "known")


@query("""SELECT s_suppkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey IS NOT DISTINCT FROM nullif(s_nationkey, 3) AND s_acctbal > c_acctbal - 50 AND s_acctbal < c_acctbal + 50) OR
  EXISTS (SELECT 1 FROM (SELECT DISTINCT nullif(s_nationkey, 3) AS n, 'x' AS m FROM supplier) q WHERE q.n IS NOT DISTINCT FROM nullif(s_nationkey, 3) AND q.m = 'x') AS there FROM supplier""")
def member_row(t):
    own = t("supplier").add(n="nullif(s_nationkey, 3)", m="'x'")
    return own.member("there", own.over("n", "m"), {"n": "n", "m": "m"}).df.select("s_suppkey", "there")


@query("SELECT c_custkey::DOUBLE AS k FROM customer UNION SELECT c_acctbal FROM customer UNION SELECT n_nationkey FROM nation")
def union_reconciled(t):
    return t("customer").specify(k="c_custkey").union(t("customer").specify(k="c_acctbal")).union(t("nation").specify(k="n_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT n_nationkey FROM nation")
def minus_reconciled(t):
    return t("orders").specify(k="o_custkey").minus(t("nation").specify(k="n_nationkey"))


@query("""SELECT l_suppkey, m FROM (SELECT DISTINCT l_suppkey, nullif(l_linenumber, 1) AS m FROM lineitem) WHERE m IS NULL""")
def nil_in_keys(t):
    return t("lineitem").specify(l_suppkey="l_suppkey", m="nullif(l_linenumber, 1)").where("m is null")


@query("""WITH a AS (SELECT DISTINCT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer), b AS (SELECT DISTINCT s FROM a WHERE s IS NULL OR s <> 'MACHINERY')
  SELECT c_nationkey FROM a WHERE s IS NULL OR s <> 'MACHINERY' GROUP BY c_nationkey HAVING count(*) = (SELECT count(*) FROM b)""")
def divide_nil(t):
    lines = t("customer").specify(c_nationkey="c_nationkey", s="nullif(c_mktsegment, 'BUILDING')")
    return lines.divide(lines.where("s is null or s <> 'MACHINERY'").over("s"))


# Joins

@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup(t):
    return t("orders").lookup(t("customer"), {"o_custkey": "c_custkey"}).over("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_custkey, o_orderkey IS NOT NULL AS ordered FROM (SELECT * FROM orders WHERE o_totalprice > 200000) RIGHT JOIN customer ON c_custkey = o_custkey")
def right_lookup_row_exists(t):
    return t("orders").where("o_totalprice > 200000").right_lookup(t("customer"), {"o_custkey": "c_custkey"}, "ordered").df.select("o_orderkey", "c_custkey", "ordered")


@query("SELECT * FROM region WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 1000)")
def without_no_common(t):
    return t("region").without(t("part").where("p_size > 1000"))


@query("SELECT * FROM customer WHERE false")
def having_empty(t):
    return t("customer").having(t("orders").where("o_totalprice < 0"), {"c_custkey": "o_custkey"})


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def natural_join_large(t):
    return t("lineitem").specify(l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_quantity="l_quantity", line="struct(*)").join(
        t("orders").where("o_orderstatus = 'F'").specify(l_orderkey="o_orderkey", o_orderstatus="o_orderstatus")).df.drop("line")


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders) AS top, NULL::BIGINT AS none FROM customer")
def scalar_extract(t):
    top = t("orders").group(top=A.greatest("o_totalprice"))
    return t("customer").df.select("c_custkey", top.value("top").alias("top"), t("orders").where("o_totalprice < 0").value("o_orderkey").alias("none"))


@query("SELECT * FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def restrict_values(t):
    return t("customer").where(c_nationkey=3, c_mktsegment="BUILDING")


@query("SELECT DISTINCT o_orderkey AS twin, o_orderstatus FROM orders")
def copied_key(t):
    return t("orders").add(twin="o_orderkey").over("twin", "o_orderstatus")


# Aggregates

@query("""SELECT o_custkey, len(list(o_orderkey))::INT AS n, (list(o_orderkey ORDER BY o_orderkey))[1] AS first, string_agg(o_orderkey, ' ' ORDER BY o_orderkey) AS said
  FROM orders GROUP BY o_custkey""")
def to_list(t):
    lists = t("orders").group(["o_custkey"], orders=A.to_list("o_orderkey"))
    return lists.df.select("o_custkey", S["list_count"](F.col("orders")).alias("n"), F.col("orders")[0].alias("first"), F.array_join("orders", " ").alias("said"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS kinds FROM orders GROUP BY o_custkey")
def concat_distinct(t):
    return t("orders").group(["o_custkey"], kinds=A.concat("o_orderstatus", "|", distinct=True))


@query("""SELECT o_custkey, substr(string_agg(CASE WHEN o_totalprice > 100000 THEN ' > ' ELSE ', ' END || o_orderkey, '' ORDER BY o_orderkey::VARCHAR),
  CASE WHEN arg_min(o_totalprice, o_orderkey::VARCHAR) > 100000 THEN 4 ELSE 3 END) AS orders FROM orders GROUP BY o_custkey""")
def concat_delimiter_column(t):
    named = t("orders").add(k="cast(o_orderkey as string)", mark="case when o_totalprice > 100000 then ' > ' else ', ' end")
    return named.group(["o_custkey"], orders=A.concat("k", delimiter_column="mark"))


@query("SELECT o_custkey, string_agg(o_orderpriority, ';' ORDER BY o_orderdate, o_orderpriority) AS told FROM orders GROUP BY o_custkey")
def concat_ordered(t):
    return t("orders").group(["o_custkey"], told=A.concat("o_orderpriority", ";", order="o_orderdate"))


@query("""SELECT c_nationkey, arg_min(s, lower(s)) AS first_name, arg_max(s, lower(s)) AS last_name
  FROM (SELECT c_nationkey, nullif(c_mktsegment, 'AUTOMOBILE') AS s FROM customer) GROUP BY c_nationkey""")
def text_extremes_nil(t):
    return t("customer").add(s="nullif(c_mktsegment, 'AUTOMOBILE')").group(["c_nationkey"], first_name=A.least_text("s"), last_name=A.greatest_text("s"))


@query("""SELECT user_id, sum(epoch_us(ts) - 1704067200000000)::DOUBLE / 1000000 AS total, floor(avg(epoch_us(ts) - 1704067200000000) / 1000000)::BIGINT AS mean FROM events GROUP BY user_id""")
def span_sum_average(t):
    spans = t("events").add(s=S["duration"](S["date_time"](2024, 1, 1), F.col("ts")))
    made = spans.group(["user_id"], total=A.total("s"), mean=A.average_span("s"))
    return made.df.select("user_id", S["total_seconds"](F.col("total")).cast("double").alias("total"), F.floor(S["total_seconds"](F.col("mean"))).cast("bigint").alias("mean"))


@query("SELECT l_suppkey, round(stddev_samp(l_quantity), 4) AS deviation FROM lineitem GROUP BY l_suppkey HAVING count(*) > 1")
def uda_stddev(t):
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    made = t("lineitem").aggregate(
        ["l_suppkey"], "deviation", ["l_quantity"], zero,
        lambda s, r: F.struct((s["n"] + 1).alias("n"), (s["s"] + r["l_quantity"]).alias("s"), (s["q"] + r["l_quantity"] * r["l_quantity"]).alias("q")),
        lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["s"] + b["s"]).alias("s"), (a["q"] + b["q"]).alias("q")),
        lambda s: F.when(s["n"] > 1, F.sqrt((s["q"] - s["s"] * s["s"] / s["n"]) / (s["n"] - 1))))
    return made.where("deviation is not null").df.select("l_suppkey", F.round("deviation", 4).alias("deviation"))


@query("SELECT l_returnflag, sum((l_quantity::DECIMAL(18,2) * l_discount::DECIMAL(18,2))::DECIMAL(28,4))::DOUBLE AS cost FROM lineitem GROUP BY l_returnflag")
def uda_two_columns(t):
    exact = t("lineitem").specify(f="l_returnflag", q="cast(l_quantity as decimal(18,2))", d="cast(l_discount as decimal(18,2))", line="struct(*)")
    kind = "decimal(28,4)"
    made = exact.aggregate(["f"], "cost", ["q", "d"], F.lit(0).cast(kind), lambda s, r: (s + r["q"] * r["d"]).cast(kind), lambda a, b: (a + b).cast(kind))
    return made.df.select(F.col("f").alias("l_returnflag"), F.col("cost").cast("double").alias("cost"))


# Order

@query("""SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders) WHERE s IS NOT NULL OR o_orderkey > 20 ORDER BY s NULLS FIRST, o_orderkey LIMIT 30""")
def browse_after_nil(t):
    return t("orders").specify(o_orderkey="o_orderkey", s="nullif(o_orderstatus, 'F')").browse("s", "o_orderkey", after={"s": None, "o_orderkey": 20}, page=30)


@query("""SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders) WHERE s < 'P' OR s IS NULL OR s = 'P' AND o_orderkey > 9 ORDER BY s DESC NULLS LAST, o_orderkey LIMIT 50""")
def browse_down_nil(t):
    return t("orders").specify(o_orderkey="o_orderkey", s="nullif(o_orderstatus, 'F')").browse("-s", "o_orderkey", after={"s": "P", "o_orderkey": 9}, page=50)


@query("SELECT * FROM customer WHERE c_custkey < 40 ORDER BY c_custkey DESC LIMIT 15")
def browse_backwards(t):
    return t("customer").browse("c_custkey", before={"c_custkey": 40}, page=15)


@query("SELECT *, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) AS seq FROM customer")
def order_custom_sort(t):
    return t("customer").order("c_mktsegment", "c_custkey", sort=lambda c: F.lower(c) if c == "c_mktsegment" else F.col(c), sequence="seq")


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS id, o_orderstatus AS status, 1 AS level, [o_orderkey] AS path FROM orders WHERE o_orderkey = 0
  UNION ALL SELECT o_orderkey, o_orderstatus, level + 1, list_append(path, o_orderkey) FROM orders JOIN e ON o_orderkey > 0 AND (o_orderkey - 1) // 20 = e.id)
  SELECT id, status, level, row_number() OVER (ORDER BY path) AS sequence FROM e""")
def explode_orders(t):
    tree = t("orders").specify(id="o_orderkey", status="o_orderstatus", up="case when o_orderkey > 0 then cast(floor((o_orderkey - 1) / 20) as bigint) end")
    return tree.explode("id = 0", ("id", "up"), order=["id"]).df.select("id", "status", "level", "sequence")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS id, c_nationkey AS n, 1 AS level, [c_custkey] AS path FROM customer WHERE c_custkey < 5
  UNION ALL SELECT c_custkey, c_nationkey, level + 1, list_append(path, c_custkey) FROM customer JOIN e ON c_nationkey = n AND c_custkey > id AND c_custkey <= id + 60)
  SELECT id, level, row_number() OVER (ORDER BY path) AS sequence FROM e""")
def explode_condition(t):
    people = t("customer").specify(id="c_custkey", n="c_nationkey")
    met = lambda parent, child: (child("n") == parent("n")) & (child("id") > parent("id")) & (child("id") <= parent("id") + 60)
    return people.explode("id < 5", met, order=["id"]).df.select("id", "level", "sequence")


# Rows and user operators

@query("""SELECT s_suppkey, s_name AS name, s_acctbal * 2 AS twice, 'kept' AS note, s_nationkey AS "r.nation", s_suppkey AS joined, s_suppkey + 1 AS pair FROM supplier""")
def row_operators(t):
    own = R.row(key=F.col("s_suppkey"), name=F.col("s_name"), balance=F.col("s_acctbal"), nation=F.col("s_nationkey"))
    made = R.redefine(R.add(own, note=F.lit("kept")), balance=F.col("s_acctbal") * 2)
    few = R.rename(R.over(R.remove(made, "name"), "nation"), ["nation"], "r")
    joined = R.join(own, ["key", "name", "balance", "nation"], R.row(key=F.col("s_suppkey"), more=F.lit(1)), ["key", "more"])
    rows = t("supplier").df.select("s_suppkey", made.alias("m"), few.alias("f"), joined.alias("j"), R.list_of(F.col("s_suppkey"), 1).alias("pair"))
    return rows.select("s_suppkey", "m.name", F.col("m.balance").alias("twice"), "m.note", F.col("f.`r.nation`").alias("r.nation"), F.col("j.key").alias("joined"), (F.col("pair")[0] + F.col("pair")[1]).alias("pair"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def udf_scalar(t):
    lines = t("lineitem")
    net = user.scalar_operator(lines.df.sparkSession, "net_price", "price DOUBLE, discount DOUBLE", "DOUBLE", "price * (1 - discount)")
    return lines.df.select("l_orderkey", "l_linenumber", net(F.col("l_extendedprice"), F.col("l_discount")).alias("net"))


@query("SELECT k::BIGINT AS k, (k * k)::BIGINT AS square FROM range(3, 41) r(k)")
def udtf_series(t):
    spark = t("region").df.sparkSession
    series = user.table_operator(spark, "squares", "low BIGINT, high BIGINT", "k BIGINT, square BIGINT", "SELECT k, k * k FROM (SELECT explode(sequence(low, high)) AS k)", ("k",))
    return series(3, 40)


@query("SELECT p_partkey, 'int ' || p_size AS a, 'text ' || p_type AS b, 'double ' || (p_retailprice > 1000) AS c FROM part")
def overloads(t):
    told = user.Overloads("told")
    told.add("int")(lambda x: F.concat(F.lit("int "), x.cast("string")))
    told.add("double")(lambda x: F.concat(F.lit("double "), (x > 1000).cast("string")))
    told.add("string")(lambda x: F.concat(F.lit("text "), x))
    parts = t("part").df.withColumn("small", F.col("p_size").cast("smallint"))
    return parts.select("p_partkey", told(parts, "small").alias("a"), told(parts, "p_type").alias("b"), told(parts, "p_retailprice").alias("c"))


@query("SELECT c_custkey, CASE WHEN nullif(c_acctbal > 0, true) THEN 'never' ELSE 'else' END AS a, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS b FROM customer")
def conditional(t):
    pick = F.when(F.expr("nullif(c_acctbal > 0, true)"), "never").otherwise("else")
    return t("customer").df.select("c_custkey", pick.alias("a"), F.expr("case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 else 0 end").alias("b"))


# Sources

@query("SELECT n_regionkey, count(*)::INT AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
def view_expansion(t):
    nation = t("nation")
    far = sources.view(nation.df.sparkSession, "far_nations", nation.where("n_nationkey > 3"))
    return far.group(["n_regionkey"], n=A.count())


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 0")
def create_table_from(t):
    made = t("customer").where("c_acctbal > 0").specify(c_custkey="c_custkey", twice="c_acctbal * 2")
    return sources.create_from(made, own_path(made.df.sparkSession, "made"))


@query("SELECT r_regionkey, r_name FROM region")
def text_file_round_trip(t):
    spark, path = t("region").df.sparkSession, own_path(t("region").df.sparkSession, "regions")
    sources.save(t("region"), path, "csv")
    told = sources.text_file(spark, f"{path}/part-*")
    lines = told.df.select(F.explode(F.split("text", "\\n")).alias("line")).where("line <> ''")
    return lines.select(F.split_part("line", F.lit(","), F.lit(1)).cast("int").alias("r_regionkey"), F.split_part("line", F.lit(","), F.lit(2)).alias("r_name"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def xml_round_trip(t):
    spark, path = t("nation").df.sparkSession, own_path(t("nation").df.sparkSession, "nations")
    t("nation").df.write.format("xml").options(rootTag="nations", rowTag="nation").save(path)
    schema = "n_nationkey int, n_name string, n_regionkey int"
    return Relation.of(spark.read.schema(schema).format("xml").options(rowTag="nation").load(path), ["n_nationkey"])


@query("SELECT n_regionkey, count(*)::INT AS n FROM nation WHERE n_nationkey > 5 GROUP BY n_regionkey")
def sql_device(t):
    """Through a database in the driver's memory, with the filter pushed down."""
    nation = t("nation")
    spark, url = nation.df.sparkSession, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    sources.store(nation, url, "nation")
    return sources.database(spark, url, ["n_nationkey"], table="nation").where("n_nationkey > 5").group(["n_regionkey"], n=A.count())


@query("SELECT n_regionkey, max(n_name) AS last_name FROM nation GROUP BY n_regionkey")
def sql_pass_through(t):
    nation = t("nation").redefine(n_name=F.substring("n_name", 1, 100))
    spark, url = nation.df.sparkSession, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    sources.store(nation, url, "nation", createTableColumnTypes="n_name VARCHAR(100)")
    return sources.database(spark, url, ["n_regionkey"], query='SELECT "n_regionkey", max("n_name") AS "last_name" FROM nation GROUP BY "n_regionkey"')


@query("SELECT c_custkey, CASE WHEN c_custkey < 20 THEN 'copied' ELSE c_name END AS c_name, (SELECT count(*) FROM customer WHERE c_custkey < 20)::BIGINT AS copied FROM customer")
def copy_rows(t):
    spark, people = t("customer").df.sparkSession, t("customer").over("c_custkey", "c_name")
    changed = people.where("c_custkey < 20").redefine(c_name=F.lit("copied")).adorn(["c_custkey"])
    made, n = sources.copy(people, changed, ["c_custkey"], own_path(spark, "copied"))
    return made.add(copied=F.lit(n).cast("bigint"))


@query("SELECT * FROM orders WHERE o_totalprice > 250000")
def row_constraint_violations(t):
    return sources.row_violations(t("orders").df, "o_totalprice <= 250000")


@query("SELECT c_custkey, c_name, c_acctbal, c_name AS new_c_name, c_acctbal - 10 AS new_c_acctbal FROM customer WHERE c_nationkey = 4")
def transition_violations(t):
    old = t("customer").over("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    new = old.redefine(c_acctbal="case when c_nationkey = 4 then c_acctbal - 10 else c_acctbal end").adorn(["c_custkey"])
    keep = ["c_custkey", "c_name", "c_acctbal"]
    return sources.transition_violations(old.over(*keep).df, new.over(*keep).df, ["c_custkey"], "new.c_acctbal >= old.c_acctbal")


@query("SELECT * FROM customer UNION SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'SUPPLY' FROM supplier")
def insert_twice(t):
    from ..plans import changes

    more = t("supplier").specify(c_custkey="s_suppkey", c_name="s_name", c_nationkey="s_nationkey", c_acctbal="s_acctbal", c_mktsegment="'SUPPLY'")
    return changes.insert(changes.insert(t("customer"), more), more)


@query("""SELECT c_custkey, 'rich' AS broken FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT c_custkey, 'near' FROM customer WHERE nullif(c_nationkey, 3) >= 20""")
def adorned_constraints(t):
    people = t("customer").adorn(constraints={"rich": "c_acctbal > 0", "near": "nullif(c_nationkey, 3) < 20"})
    return people.violations("broken").select("c_custkey", "broken")


@query("SELECT * FROM customer UNION SELECT s_suppkey + 5000000000, s_name, 7, NULL, 'NONE' FROM supplier")
def insert_defaults(t):
    from ..plans import changes

    people = t("customer").adorn(defaults={"c_nationkey": 7, "c_mktsegment": "NONE"})
    return changes.insert(people, t("supplier").specify(c_custkey="s_suppkey + 5000000000", c_name="s_name"))


# Scalar families

@query("""SELECT p_partkey, substr(p_name, 3, 1) AS char_at, CASE WHEN strpos(reverse(p_name), 'd') = 0 THEN -1 ELSE length(p_name) - strpos(reverse(p_name), 'd') END::INT AS last_d,
  coalesce(least(nullif(strpos(p_name, 'w'), 0), nullif(strpos(p_name, 'l'), 0)) - 1, -1)::INT AS any_first,
  greatest(CASE WHEN strpos(reverse(p_name), 'w') = 0 THEN -1 ELSE length(p_name) - strpos(reverse(p_name), 'w') END,
    CASE WHEN strpos(reverse(p_name), 'l') = 0 THEN -1 ELSE length(p_name) - strpos(reverse(p_name), 'l') END)::INT AS any_last,
  CASE WHEN strpos(reverse(left(p_name, 5)), 'l') = 0 THEN -1 ELSE length(left(p_name, 5)) - strpos(reverse(left(p_name, 5)), 'l') END::INT AS last_to,
  CASE WHEN strpos(substr(p_name, 2, 6), 'l') = 0 THEN -1 ELSE strpos(substr(p_name, 2, 6), 'l') END::INT AS ranged,
  CASE WHEN strpos(substr(p_name, 4), right(p_name, 1)) = 0 THEN -1 ELSE strpos(substr(p_name, 4), right(p_name, 1)) + 2 END::INT AS from_third FROM part""")
def fn_string_search(t):
    name = F.col("p_name")
    return t("part").df.select(
        "p_partkey", S["char_at"](name, 2).alias("char_at"), S["last_pos"]("d", name).alias("last_d"), S["index_of_any"](name, "w", "l").alias("any_first"),
        S["last_index_of_any"](name, "w", "l").alias("any_last"), S["last_index_of_start"](name, "l", 4).alias("last_to"),
        S["index_of_range"](name, "l", 1, 6).alias("ranged"), S["index_of"](name, F.right(name, F.lit(1)), 3).alias("from_third"))


@query("""SELECT p_partkey, starts_with(p_name, 'c') AS led, CASE WHEN length(p_brand) >= 8 THEN p_brand ELSE rpad(p_brand, 8, '*') END AS padded,
  CASE WHEN lower(p_name) < 'm' THEN -1 WHEN lower(p_name) > 'm' THEN 1 ELSE 0 END AS compared, regexp_full_match(p_name, '[\\p{Ll}\\P{L}]*') AS lows,
  regexp_full_match(p_type, '\\p{L}*') AS letters, regexp_full_match(p_size::VARCHAR, '\\p{Nd}*') AS digits, regexp_full_match(p_brand, '[\\p{L}\\p{Nd}]*') AS both,
  upper(p_name) AS up, p_name AS trimmed, p_name || '  ' AS ltrimmed, '  ' || p_name AS rtrimmed, replace(url_encode(p_brand || ' ' || p_name), '%20', '+') AS url,
  p_brand AS back, '$1\\' || substr(p_brand, 6) AS put, p_name AS utf8, strlen(p_name)::INT AS bytes, p_brand AS b64, p_name AS html, p_brand AS points,
  '0f8fad5b-d9cb-469f-a165-70867728950e' AS guid FROM part""")
def fn_string_more(t):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    wide = F.concat(F.lit("  "), name, F.lit("  "))
    return t("part").df.select(
        "p_partkey", S["starts_with"](name, "c").alias("led"), S["pad_right"](brand, 8, "*").alias("padded"), S["compare_text"](name, "M").alias("compared"),
        S["is_lower"](name).alias("lows"), S["is_letter"](kind).alias("letters"), S["is_digit"](S["to_string"](F.col("p_size"))).alias("digits"),
        S["is_letter_or_digit"](brand).alias("both"), S["upper"](name).alias("up"), S["trim"](wide).alias("trimmed"), S["ltrim"](wide).alias("ltrimmed"),
        S["rtrim"](wide).alias("rtrimmed"), S["url_encode"](F.concat(brand, F.lit(" "), name)).alias("url"), S["url_decode"](S["url_encode"](brand)).alias("back"),
        S["replace"](brand, "bRAND", "$1\\", ignore_case=True).alias("put"), S["from_utf8"](S["utf8"](name)).alias("utf8"),
        S["binary_length"](S["utf8"](name)).alias("bytes"), S["from_utf8"](S["from_base64"](S["base64"](S["utf8"](brand)))).alias("b64"),
        S["html_decode"](S["html_encode"](name)).alias("html"), S["from_unicode"](S["unicode"](brand)).alias("points"),
        S["to_guid"]("{0F8FAD5B-D9CB-469F-A165-70867728950E}").alias("guid"))


@query("""SELECT p_partkey, round(exp(p_size / 10), 6) AS e, factorial(p_size % 10)::BIGINT AS f, round(p_retailprice - trunc(p_retailprice), 6) AS rest, trunc(p_retailprice)::BIGINT AS whole,
  round_even(p_retailprice::DECIMAL(18,4), 0)::INT AS even, p_size + 7 AS more, p_size - 7 AS less, p_size * 7 AS times, -p_size AS minus, floor(p_retailprice / 7)::BIGINT AS part7,
  least(nullif(p_size, 1), 10)::INT AS low FROM part""")
def fn_math_more(t):
    n, price = F.col("p_size"), F.col("p_retailprice")
    return t("part").df.select(
        "p_partkey", F.round(S["exp"](n / 10), 6).alias("e"), S["factorial"](n % 10).alias("f"), F.round(S["frac"](price).cast("double"), 6).alias("rest"),
        S["truncate"](price).cast("bigint").alias("whole"), S["to_integer"](price).alias("even"), S["add"](n, 7).alias("more"), S["subtract"](n, 7).alias("less"),
        S["multiply"](n, 7).alias("times"), S["negate"](n).alias("minus"), S["div_decimal"](price, 7).cast("bigint").alias("part7"),
        S["min_of"](F.expr("nullif(p_size, 1)"), 10).alias("low"))


@query("""SELECT p_partkey, p_size::SMALLINT AS short, p_retailprice AS money, p_size > 10 AS flag, '1997-01-15' AS day, TIMESTAMP '1997-01-15 02:03:04' AS moment, 93784::DOUBLE AS seconds FROM part""")
def fn_convert_more(t):
    n = F.col("p_size")
    return t("part").df.select(
        "p_partkey", S["to_short"](n).alias("short"), S["to_money"](F.col("p_retailprice")).cast("double").alias("money"), S["to_boolean"]((n > 10).cast("string")).alias("flag"),
        S["to_date"](F.lit("1997-01-15")).cast("string").alias("day"), S["to_date_time"](F.lit("1997-01-15 02:03:04")).alias("moment"),
        S["total_seconds"](S["to_time_span"](F.lit("1 02:03:04"))).cast("double").alias("seconds"))


@query("""SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, minute(ts)::INT AS mi, second(ts)::INT AS s, dayofyear(ts)::INT AS doy, (2030 - year(ts))::INT AS years,
  ts + INTERVAL 3 YEAR AS later, ts::DATE::VARCHAR AS part, (epoch_us(ts) // 1000 % 1000)::INT AS ms, ts AS back, (epoch_us(ts) % 86400000000) / 1000000 AS since,
  make_timestamp(year(ts), 2, 1, 5, 6, 7.008) AS made FROM events""")
def fn_date_fields(t):
    ts = F.col("ts")
    made = S["with_month"](S["with_day"](ts, 1), 2)
    for name, n in (("hour", 5), ("minute", 6), ("second", 7), ("millisecond", 8)):
        made = S[f"with_{name}"](made, n)
    return t("events").df.select(
        "event_id", S["year"](ts).alias("y"), S["month"](ts).alias("mo"), S["day"](ts).alias("d"), S["minute"](ts).alias("mi"), S["second"](ts).alias("s"),
        S["day_of_year"](ts).alias("doy"), S["years_between"](ts, F.lit("2030-06-01").cast("date")).alias("years"), S["add_years"](ts, 3).alias("later"),
        S["date_part"](ts).cast("string").alias("part"), S["millisecond"](ts).alias("ms"), S["from_ticks"](S["date_ticks"](ts)).alias("back"),
        S["total_seconds"](S["time_part"](ts)).cast("double").alias("since"), made.alias("made"))


@query("""SELECT p_partkey, (p_size * 1.5)::DOUBLE AS ms, p_size * 60::DOUBLE AS minutes, (p_size * 24)::DOUBLE AS hours, (p_size * 90061) // 86400 AS d, (p_size * 90061) % 86400 // 3600 AS h,
  (p_size * 90061) % 3600 // 60 AS mi, (p_size * 90061) % 60 AS s, 250 AS z, (p_size * 10)::BIGINT AS ticks, (p_size * 2.5)::DOUBLE AS more, p_size / 4 AS less, p_size / 8 AS ratio FROM part""")
def fn_span(t):
    n = F.col("p_size")
    long = S["time_span"](n, n, n, n, 250)
    as_double = lambda x: x.cast("double")
    return t("part").df.select(
        "p_partkey", as_double(S["total_milliseconds"](S["span_milliseconds"](n * F.lit(1.5)))).alias("ms"), as_double(S["total_minutes"](S["span_hours"](n))).alias("minutes"),
        as_double(S["total_hours"](S["span_days"](n))).alias("hours"), S["span_day"](long).alias("d"), S["span_hour"](long).alias("h"), S["span_minute"](long).alias("mi"),
        S["span_second"](long).alias("s"), S["span_millisecond"](long).alias("z"), S["total_ticks"](S["span_ticks"](n * 10)).alias("ticks"),
        as_double(S["total_seconds"](S["span_multiply"](S["span_seconds"](n), 2.5))).alias("more"), as_double(S["total_seconds"](S["span_divide"](S["span_seconds"](n), 4))).alias("less"),
        as_double(S["span_ratio"](S["span_seconds"](n), S["span_seconds"](F.lit(8)))).alias("ratio"))


@query("""SELECT p_partkey, 'new|' || replace(p_name, ' ', '|') AS put, string_split(p_name, ' ')[2] AS cut, 'set|' || string_split(p_name, ' ')[2] AS changed, string_split(p_name, ' ')[1] AS removed,
  0 AS cleared, 1 AS last FROM part WHERE len(string_split(p_name, ' ')) = 2 AND string_split(p_name, ' ')[1] <> string_split(p_name, ' ')[2]""")
def fn_list_more(t):
    w = S["split"](F.col("p_name"), " ")
    two = t("part").df.where((F.size(w) == 2) & (w[0] != w[1]))
    join = lambda x: S["concat_list"](x, "|")
    return two.select(
        "p_partkey", join(S["list_insert"](w, 0, "new")).alias("put"), join(S["list_remove_at"](w, 0)).alias("cut"), join(S["list_set"](w, 0, "set")).alias("changed"),
        join(S["list_remove"](w, w[1])).alias("removed"), S["list_count"](S["list_clear"](w)).alias("cleared"), S["list_last_index_of"](w, w[1]).cast("int").alias("last"))


@query("SELECT event_id, 'OBJECT<k: BIGINT>' AS kind FROM events")
def fn_dynamic_type(t):
    return t("events").df.select("event_id", S["dynamic_type"](F.col("props")).alias("kind"))


@query("SELECT p_partkey, true AS fraction, true AS below, true AS between_ends, 36 AS guid FROM part")
def fn_random_ranges(t):
    drawn = t("part").df.select("p_partkey", S["random"](1).alias("r"), S["random_below"](6, 2).alias("n"), S["random_between"](5, 7, 3).alias("m"), S["new_guid"]().alias("g"))
    return drawn.select("p_partkey", F.expr("r >= 0 and r < 1").alias("fraction"), F.expr("n between 0 and 5").alias("below"), F.expr("m between 5 and 7").alias("between_ends"), F.length("g").alias("guid"))


# Streams, an extension: the same operators over the events as they come

def event_stream(t):
    """The events as a stream of files, its rows, and two folders for a sink."""
    events = t("events").df
    spark, (file, *_) = events.sparkSession, sorted(events.inputFiles())
    folder = file.rpartition("/")[0]
    folder, name = (folder, "*.parquet") if folder.endswith("events.parquet") else (folder, "events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)
    path = own_path(spark, "stream")
    return stream, f"{path}/rows", f"{path}/state"


@query("SELECT event_id, user_id, value * 2 AS twice FROM events WHERE event_type = 'purchase' AND value > 10")
def ext_stream_restrict(t):
    stream, path, state = event_stream(t)
    wanted = Relation.bag(stream).where("event_type = 'purchase' and value > 10").add(twice="value * 2").df.select("event_id", "user_id", "twice")
    return streaming.drained(wanted, path, state)


@query("""SELECT * FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*)::INT AS n
  FROM events GROUP BY ALL) WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def ext_stream_windows(t):
    """Windows that the watermark has closed."""
    stream, path, state = event_stream(t)
    return streaming.drained(streaming.windowed(stream, "ts", "1 hour", ["event_type"], n=A.count()), path, state)
