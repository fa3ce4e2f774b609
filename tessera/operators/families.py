"""Queries of the scalar families, of changes and of labelled extensions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import streaming
from ..functions import aggregates as A
from ..functions.scalars import REGISTRY as S
from ..plans import changes
from .queries import query


@query("SELECT * FROM part WHERE p_size BETWEEN 10 AND 20")
def restrict_range(t):
    return t("part").where("p_size >= 10 and p_size <= 20")


@query("SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '%U%'")
def restrict_in_like(t):
    return t("orders").where("o_orderstatus in ('F', 'P') and o_orderpriority like '%U%'")


@query('SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey" FROM nation')
def rename_all(t):
    return t("nation").rename("n")


@query("SELECT o_orderkey, c_custkey, c_custkey IS NOT NULL AND o_orderkey IS NOT NULL AS met FROM customer FULL JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 WHERE o_orderkey IS NULL OR o_totalprice > 200000")
def ext_full_join(t):
    big = t("orders").where("o_totalprice > 200000").over("o_orderkey", "o_custkey")
    return t("customer").over("c_custkey").full_join(big, {"c_custkey": "o_custkey"}).specify(
        o_orderkey="o_orderkey", c_custkey="c_custkey", met="c_custkey is not null and o_orderkey is not null")


@query("SELECT DISTINCT o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def left_join_lost_key(t):
    big = t("orders").where("o_totalprice > 200000").over("o_orderkey", "o_custkey")
    return t("customer").left_join(big, {"c_custkey": "o_custkey"}).over("o_orderkey")


@query("""SELECT c_nationkey, count(o_orderkey)::INT AS filled, count(*)::INT AS every_row, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total,
  coalesce(bool_and(o_totalprice > 1000), true) AS all_big, coalesce(bool_or(o_totalprice > 1000), false) AS any_big
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_nationkey""")
def agg_nil_rules(t):
    big = t("orders").where("o_totalprice > 300000")
    met = t("customer").left_join(big, {"c_custkey": "o_custkey"}).add(big="o_totalprice > 1000")
    return met.group(["c_nationkey"], filled=A.count("o_orderkey"), every_row=A.count(), total=F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double"),
                     all_big=A.every("big"), any_big=A.some("big"))


@query("SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey DESC) AS seq FROM orders)")
def order_sequence_orders(t):
    return t("orders").order("o_orderdate", "-o_orderkey", sequence="seq")


@query("""SELECT p_partkey, strpos(p_type, 'T')::INT - 1 AS first_t, left(p_type, 2) || '--' || substr(p_type, 3) AS put, substr(p_type, 1, 1) || substr(p_type, 4) AS cut,
  lower(p_name) AS low, ends_with(p_brand, '1') AS one, lpad(p_size::VARCHAR, 4, '0') AS padded, replace(p_type, 'E', '3') AS leet,
  length(p_type) - length(replace(p_type, 'E', '')) AS es, regexp_matches(p_brand, '#[0-9]+$') AS numbered, p_type = upper(p_type) AS shouted,
  unicode(p_brand)::INT AS point, replace(replace(p_brand, '&', '&amp;'), '<', '&lt;') AS safe, to_base64(encode(p_brand)) AS b64 FROM part""")
def fn_string(t):
    kind, brand = F.col("p_type"), F.col("p_brand")
    return t("part").df.select(
        "p_partkey", S["index_of"](kind, "T").alias("first_t"), S["insert"](kind, 2, "--").alias("put"), S["remove"](kind, 1, 2).alias("cut"),
        S["lower"](F.col("p_name")).alias("low"), S["ends_with"](brand, "1").alias("one"), S["pad_left"](S["to_string"](F.col("p_size")), 4, "0").alias("padded"),
        S["replace"](kind, "E", "3").alias("leet"), S["count_of"](kind, "E").cast("bigint").alias("es"), S["matches"](brand, "#[0-9]+$").alias("numbered"),
        S["is_upper"](kind).alias("shouted"), S["list_get"](S["unicode"](brand), 0).alias("point"), S["html_encode"](brand).alias("safe"),
        S["base64"](S["utf8"](brand)).alias("b64"))


@query("""SELECT p_partkey, floor(p_retailprice)::BIGINT AS low, ceil(p_retailprice)::BIGINT AS high, abs(p_size - 25)::INT AS away, round(ln(p_size), 6) AS ln, round(log10(p_size), 6) AS lg,
  round(ln(p_size) / ln(2), 6) AS lb, (p_size * p_size)::DOUBLE AS square, p_size % 7 AS rest, round(p_size / 7, 6) AS exact FROM part""")
def fn_math(t):
    n = F.col("p_size")
    return t("part").df.select(
        "p_partkey", S["floor"](F.col("p_retailprice")).alias("low"), S["ceiling"](F.col("p_retailprice")).alias("high"), S["abs"](n - 25).alias("away"),
        F.round(S["ln"](n), 6).alias("ln"), F.round(S["log10"](n), 6).alias("lg"), F.round(S["log"](n, 2), 6).alias("lb"), S["power"](n, 2).alias("square"),
        S["mod"](n, 7).alias("rest"), F.round(S["divide"](n, 7).cast("double"), 6).alias("exact"))


@query("SELECT p_partkey, p_size & 12 AS both, p_size | 3 AS either, xor(p_size, 5) AS one, ~p_size AS flipped, p_size << 2 AS up, p_size >> 1 AS down FROM part")
def fn_bitwise(t):
    n = F.col("p_size")
    return t("part").df.select(
        "p_partkey", S["bit_and"](n, 12).alias("both"), S["bit_or"](n, 3).alias("either"), S["bit_xor"](n, 5).alias("one"),
        S["bit_not"](n).alias("flipped"), S["shift_left"](n, 2).alias("up"), S["shift_right"](n, 1).alias("down"))


@query("""SELECT o_orderkey, hour(o_orderdate + INTERVAL 90 MINUTE)::INT AS hour, o_orderdate + INTERVAL 90 MINUTE AS later, make_timestamp(2000, month(o_orderdate), 1, 0, 0, 0) AS moved,
  (date_diff('second', TIMESTAMP '1990-01-01', o_orderdate))::DOUBLE / 86400 AS days, epoch_us(o_orderdate)::BIGINT * 10 + 621355968000000000 AS ticks,
  o_orderdate + INTERVAL 14 MONTH AS months FROM orders""")
def fn_datetime(t):
    d = F.col("o_orderdate").cast("timestamp_ntz")
    later = d + S["time_span"](hours=1, minutes=30)
    return t("orders").df.select(
        "o_orderkey", S["hour"](later).alias("hour"), later.alias("later"), S["with_day"](S["with_year"](S["with_day"](d, 1), 2000), 1).alias("moved"),
        S["total_days"](S["duration"](S["date_time"](1990, 1, 1), d)).cast("double").alias("days"), S["date_ticks"](d).alias("ticks"),
        S["add_months"](d, 14).alias("months"))


@query("""SELECT p_partkey, round_even(p_retailprice::DECIMAL(18,4), 0)::BIGINT AS whole, p_size::SMALLINT AS small, p_size::VARCHAR AS said, p_size::DECIMAL(28,10)::DOUBLE AS exact,
  (p_size * 60)::DOUBLE AS seconds FROM part""")
def fn_convert(t):
    n = F.col("p_size")
    return t("part").df.select(
        "p_partkey", S["to_long"](F.col("p_retailprice")).alias("whole"), S["to_byte"](n).alias("small"), S["to_string"](n).alias("said"),
        S["to_decimal"](n).cast("double").alias("exact"), S["total_seconds"](S["span_minutes"](n)).cast("double").alias("seconds"))


@query("""SELECT p_partkey, len(w)::INT AS n, w[1] AS first, coalesce(list_position(w, 'TIN'), 0)::INT - 1 AS at, array_to_string(list_append(w, 'end'), '|') AS more, len(list_distinct(w))::INT AS kinds
  FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)""")
def fn_list(t):
    w = S["split"](F.col("p_type"), " ")
    return t("part").df.select(
        "p_partkey", S["list_count"](w).alias("n"), S["list_get"](w, 0).alias("first"), S["list_index_of"](w, "TIN").cast("int").alias("at"),
        S["concat_list"](S["list_add"](w, "end"), "|").alias("more"), S["list_count"](S["list_distinct"](w)).alias("kinds"))


@query("SELECT p_partkey, nullif(p_size, 1) IS NULL AS none, nullif(p_size, 1) IS NOT NULL AS some, coalesce(nullif(p_size, 1), 0)::INT AS filled, greatest(nullif(p_size, 1), 10)::INT AS top FROM part")
def fn_nil(t):
    n = F.expr("nullif(p_size, 1)")
    return t("part").df.select("p_partkey", S["is_nil"](n).alias("none"), S["is_not_nil"](n).alias("some"), S["if_nil"](n, 0).alias("filled"), S["max_of"](n, 10).alias("top"))


@query("SELECT event_id, (props ->> '$.k')::VARCHAR AS k FROM events")
def fn_dynamic_json(t):
    return t("events").df.select("event_id", S["dynamic_get"](F.col("props"), "$.k").alias("k"))


@query("SELECT * FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_name, s_nationkey, NULL, NULL FROM supplier")
def insert_rows(t):
    return changes.insert(t("customer"), t("supplier").specify(c_custkey="s_suppkey + 1000000000", c_name="s_name", c_nationkey="s_nationkey"))


@query("SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal) FROM customer")
def update_rows(t):
    return changes.update(t("customer"), "c_acctbal < 0", c_acctbal=F.lit(0.0))


@query("SELECT * FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 20, false)")
def delete_rows(t):
    return changes.delete(t("customer"), "nullif(c_nationkey, 3) > 20")


@query("SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_cascade(t):
    return changes.delete_referring(t("orders"), t("customer").where("c_acctbal < 0"), {"o_custkey": "c_custkey"})


@query("SELECT * REPLACE (CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL ELSE o_custkey END AS o_custkey) FROM orders")
def delete_clear(t):
    return changes.clear_referring(t("orders"), t("customer").where("c_acctbal < 0"), {"o_custkey": "c_custkey"})


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS r FROM orders")
def ext_window_rank(t):
    return t("orders").df.select("o_orderkey", F.rank().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("r"))


@query("SELECT l_returnflag, l_linestatus, count(*)::INT AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(t):
    return t("lineitem").df.rollup("l_returnflag", "l_linestatus").agg(A.count().alias("n"))


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS s FROM marked)
  SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*)::INT AS n FROM numbered GROUP BY user_id, s""")
def ext_session_window(t):
    return streaming.sessions(t("events").df, "ts", "30 minutes", ["user_id"], n=A.count())
