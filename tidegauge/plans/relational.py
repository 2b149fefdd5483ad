"""Queries: projections, predicates, equi joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import finance, text
from ..operators import changes, joins
from ..operators.quantiles import exact_quantiles
from ..sources.market import events as market_events
from ..sources.market import fundamentals, oracle, table
from .registry import query


@query("PRJ-02", "SELECT c_custkey, regexp_replace(c_name, 'Customer#0+', 'C') || CASE c_custkey % 4 WHEN 0 THEN 'W' WHEN 1 THEN '-A' ELSE '' END AS symbol, (NOT regexp_matches(symbol, '[-.^/]') AND NOT (length(symbol) = 5 AND upper(right(symbol, 1)) IN ('W', 'U', 'R', 'Q', 'F'))) AS tradable FROM customer")
def prj_02(spark, sf_dir):
    tail = F.when(F.col("c_custkey") % 4 == 0, "W").when(F.col("c_custkey") % 4 == 1, "-A").otherwise("")
    symbol = F.concat(F.regexp_replace("c_name", "Customer#0+", "C"), tail)
    return table(spark, sf_dir, "customer").select("c_custkey", symbol.alias("symbol"), text.is_tradable(symbol).alias("tradable"))


@query("PRJ-03", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey::VARCHAR END AS cik FROM customer")
def prj_03(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), F.col("c_custkey"))).otherwise(
        F.concat(F.lit(" cik"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit(" "))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.normal_cik(raw).alias("cik"))


# Filing item codes and the event class of each.
ITEM_CLASSES = {
    "1.01": "8K_1.01_MATERIAL_AGMT",
    "1.03": "8K_1.03_BANKRUPTCY",
    "2.01": "8K_1.01_MATERIAL_AGMT",
    "2.02": "8K_2.02_EARNINGS",
    "4.01": "8K_4.01_AUDITOR_CHANGE",
    "4.02": "8K_4.02_RESTATEMENT",
    "5.02": "8K_5.02_MGMT_CHANGE",
    "8.01": "8K_8.01_OTHER",
}


@query("PRJ-04", """
    WITH m(code, class) AS (VALUES ('1.01', '8K_1.01_MATERIAL_AGMT'), ('2.01', '8K_1.01_MATERIAL_AGMT'), ('2.02', '8K_2.02_EARNINGS'), ('5.02', '8K_5.02_MGMT_CHANGE'), ('8.01', '8K_8.01_OTHER'))
    SELECT DISTINCT l_orderkey, class FROM lineitem JOIN m ON m.code = CASE l_linenumber WHEN 1 THEN '1.01' WHEN 2 THEN '2.01' WHEN 3 THEN '2.02' WHEN 4 THEN '5.02' WHEN 5 THEN '8.01' ELSE '9.99' END""")
def prj_04(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ("1.01", "2.01", "2.02", "5.02", "8.01", "9.99", "9.99"))), F.least("l_linenumber", F.lit(7)))
    codes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(code).alias("codes"))
    classes = F.create_map(*[F.lit(x) for pair in ITEM_CLASSES.items() for x in pair])
    found = F.array_distinct(F.filter(F.transform("codes", lambda c: classes[c]), lambda c: c.isNotNull()))
    return codes.select("l_orderkey", F.explode(found).alias("class"))


@query("PRJ-05", "SELECT p_partkey, CASE p_brand[7:8] WHEN '1' THEN 'XLB' WHEN '2' THEN 'XLK' WHEN '3' THEN 'XLF' ELSE 'SPY' END AS sector FROM part")
def prj_05(spark, sf_dir):
    proxy = F.create_map(*[F.lit(x) for pair in (("1", "XLB"), ("2", "XLK"), ("3", "XLF")) for x in pair])
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(proxy[F.substring("p_brand", 7, 2)], F.lit("SPY")).alias("sector"))


@query("PRJ-06", "SELECT c_custkey, coalesce(nullif(c_acctbal, 0) >= 5 AND c_acctbal * 1000000 >= 50000000 AND CASE WHEN c_custkey % 3 > 0 THEN c_acctbal * 1000 END >= 1000000, FALSE) AS investable FROM customer")
def prj_06(spark, sf_dir):
    traded = F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal") * 1000)
    flag = finance.is_investable(F.nullif(F.col("c_acctbal"), F.lit(0.0)), F.col("c_acctbal") * 1_000_000, traded)
    return table(spark, sf_dir, "customer").select("c_custkey", flag.alias("investable"))


@query("PRJ-07", "SELECT o_orderkey, CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'in' WHEN o_orderdate >= DATE '1998-02-01' THEN 'out' END AS sample FROM orders")
def prj_07(spark, sf_dir):
    side = finance.sample_side(F.col("o_orderdate").cast("date"), "1998-01-01", "1998-02-01")
    return table(spark, sf_dir, "orders").select("o_orderkey", side.alias("sample"))


@query("PRJ-08", """
    SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 500""")
def prj_08(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    waiting = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(done, "o_orderkey", "left_anti").join(rich, "o_custkey", "left_semi")
    return waiting.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(500).select("o_orderkey")


@query("PRJ-09", "SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '%high%' AND o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND o_totalprice >= 100000")
def prj_09(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    wanted = F.col("o_orderpriority").ilike("%high%") & day.between("1997-01-01", "1997-12-31") & (F.col("o_totalprice") >= 100_000)
    return table(spark, sf_dir, "orders").where(wanted).select("o_orderkey")


@query("PRJ-10", "SELECT l_returnflag IS DISTINCT FROM nullif(l_linestatus, 'F') AS differs, count(*) AS n FROM lineitem GROUP BY 1")
def prj_10(spark, sf_dir):
    differs = ~F.col("l_returnflag").eqNullSafe(F.nullif(F.col("l_linestatus"), F.lit("F")))
    return table(spark, sf_dir, "lineitem").groupBy(differs.alias("differs")).agg(F.count("*").alias("n"))


@query("PRJ-11", "SELECT p_partkey FROM part WHERE (p_name LIKE 'small%' OR p_name LIKE '%ring') AND p_type NOT IN ('ECONOMY', 'PROMO')")
def prj_11(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_name LIKE ANY ('small%', '%ring') AND p_type NOT IN ('ECONOMY', 'PROMO')").select("p_partkey")


@query("PRJ-12", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'red') THEN 'novelty' WHEN contains(p_name, 'widget') THEN 'confidence' WHEN contains(p_name, 'ring') THEN 'ev' ELSE 'other' END AS reason FROM part")
def prj_12(spark, sf_dir):
    rules = [("starts", "red", "novelty"), ("has", "widget", "confidence"), ("has", "ring", "ev")]
    return table(spark, sf_dir, "part").select("p_partkey", finance.first_category(F.col("p_name"), rules, "other").alias("reason"))


@query("PRJ-14", "SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 5 WHEN c_acctbal >= 1000 THEN 10 ELSE 25 END::BIGINT AS slippage_bps, 2 * 10 + 2 * CASE WHEN c_acctbal >= 5000 THEN 5 WHEN c_acctbal >= 1000 THEN 10 ELSE 25 END::BIGINT + 2 * 10 AS round_trip_bps FROM customer")
def prj_14(spark, sf_dir):
    slip = finance.stepped(F.col("c_acctbal"), [(5000, 5), (1000, 10)], 25).cast("bigint")
    return table(spark, sf_dir, "customer").select("c_custkey", slip.alias("slippage_bps"), finance.hedged_round_trip(slip, 10).cast("bigint").alias("round_trip_bps"))


@query("JON-01", "SELECT o_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def jon_01(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("qty"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey")


@query("JON-02", "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def jon_02(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


@query("JON-10", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT o_orderdate FROM orders ORDER BY o_orderdate DESC LIMIT 1)")
def jon_10(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate").alias("o_orderdate"))  # one row
    return orders.join(F.broadcast(last), "o_orderdate").select("o_orderkey", "o_totalprice")


@query("JON-11", "SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC) ON o_custkey = c_custkey")
def jon_11(spark, sf_dir):
    last = F.max(F.struct("o_orderdate", "o_orderkey")).alias("last")  # pre-summed: no window over all orders
    latest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(last)
    return table(spark, sf_dir, "customer").join(latest, "c_custkey", "left").select("c_custkey", "last.o_orderkey", "last.o_orderdate")


@query("JON-12", """
    SELECT DISTINCT ON (o_orderkey) o_orderkey, l_partkey, way FROM (
        SELECT o_orderkey, l_partkey, l_linenumber, 1 AS way FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate
        UNION ALL SELECT o_orderkey, l_partkey, l_linenumber, 0 FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_suppkey = o_custkey % 100)
    ORDER BY o_orderkey, way, l_partkey DESC, l_linenumber""")
def jon_12(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    dated = both.where("l_shipdate > o_orderdate").select("o_orderkey", "l_partkey", "l_linenumber", F.lit(1).alias("way"))
    same = both.where("l_suppkey = o_custkey % 100").select("o_orderkey", "l_partkey", "l_linenumber", F.lit(0).alias("way"))
    best = F.min(F.struct("way", (-F.col("l_partkey")).alias("newest"), "l_linenumber", "l_partkey"))
    return dated.unionByName(same).groupBy("o_orderkey").agg(best.alias("b")).select("o_orderkey", "b.l_partkey", "b.way")


@query("JON-13", "SELECT c_custkey, coalesce(n * 10, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
def jon_13(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    new = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") * 10).cast("double").alias("c_acctbal"))
    updated = changes.update_from(table(spark, sf_dir, "customer"), new, ["c_custkey"], ["c_acctbal"])
    gone = orders.where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    return changes.delete_using(updated, gone, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("JON-14", "SELECT event_id, s.k AS strategy, (props->>'k')::INT * s.f AS scaled FROM events, (VALUES ('a', 1), ('b', 2), ('c', 3)) AS s(k, f) WHERE event_type = 'purchase'")
def jon_14(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    forms = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(f).alias("f")) for n, f in (("a", 1), ("b", 2), ("c", 3))]))
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", k.alias("k"), forms.alias("s"))
    return rows.select("event_id", "s.strategy", (F.col("k") * F.col("s.f")).alias("scaled"))


@query("JON-15", oracle("events", """
    SELECT a.event_id, count(b.event_id) AS n_earlier FROM ev a LEFT JOIN (SELECT event_class, ticker, d0, min(event_id) AS event_id FROM ev GROUP BY ALL) b
    ON a.event_class = b.event_class AND a.ticker = b.ticker AND b.d0 < a.d0 - 20 GROUP BY a.event_id"""))
def jon_15(spark, sf_dir):
    """Earlier events of the same class and ticker with a known outcome, counted without making pairs."""
    events = market_events(spark, sf_dir)
    first = events.groupBy("event_class", "ticker", "d0").agg(F.lit(1).alias("one"))
    w = Window.partitionBy("event_class", "ticker").orderBy(F.unix_date("d0")).rangeBetween(Window.unboundedPreceding, -21)
    counted = first.select("event_class", "ticker", "d0", F.count("one").over(w).alias("n_earlier"))
    return events.join(counted, ["event_class", "ticker", "d0"]).select("event_id", "n_earlier")


@query("AGG-01", "SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg_01(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"),
        F.round(F.avg("o_totalprice"), 4).alias("mean"), F.countDistinct("o_custkey").alias("customers"),
    )


@query("AGG-02", "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) FILTER (l_discount > 0.05) AS suppliers, sum(l_quantity) FILTER (l_tax = 0) AS untaxed FROM lineitem GROUP BY 1")
def agg_02(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.countDistinct(F.when(F.col("l_discount") > 0.05, F.col("l_suppkey"))).alias("suppliers"),
        F.sum(F.when(F.col("l_tax") == 0, F.col("l_quantity"))).alias("untaxed"),
    )


@query("AGG-03", "SELECT l_suppkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1 HAVING max(l_shipdate) < TIMESTAMP '2001-11-01' OR count(*) > 620")
def agg_03(spark, sf_dir):
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last_ship"), F.count("*").alias("n"))
    return grouped.where((F.col("last_ship") < F.lit("2001-11-01").cast("timestamp_ntz")) | (F.col("n") > 620)).select("l_suppkey", "last_ship")


@query("AGG-05", "SELECT l_orderkey, round(coalesce(exp(sum(ln(1 - l_discount))), 1), 12) AS kept FROM lineitem GROUP BY 1")
def agg_05(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(finance.product(1 - F.col("l_discount")), 12).alias("kept"))


@query("AGG-06", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.99) AS p99 FROM (SELECT l_returnflag, round(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY 1")
def agg_06(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.round("l_extendedprice").alias("v"))
    return exact_quantiles(lines, "v", ["l_returnflag"], {"p01": 0.01, "p50": 0.5, "p99": 0.99})


@query("AGG-08", "SELECT c_mktsegment, n_name, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS rich FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY rich DESC, n DESC, c_mktsegment, n_name LIMIT 20")
def agg_08(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").groupBy("c_mktsegment", F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"))
    named = customers.join(table(spark, sf_dir, "nation"), "n_nationkey")
    return named.orderBy(F.desc("rich"), F.desc("n"), "c_mktsegment", "n_name").limit(20).select("c_mktsegment", "n_name", "n", "rich")


@query("AGG-15", "SELECT c_mktsegment, CASE WHEN count(*) >= 3 THEN round(regr_r2(c_acctbal, c_nationkey), 8) END AS r2 FROM customer GROUP BY 1")
def agg_15(spark, sf_dir):
    r = F.corr(F.col("c_acctbal"), F.col("c_nationkey").cast("double"))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(F.when(F.count("*") >= 3, r * r), 8).alias("r2"))


@query("AGG-24", "SELECT least(floor((v - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n FROM (SELECT value AS v FROM events WHERE value IS NOT NULL), (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def agg_24(spark, sf_dir):
    values = table(spark, sf_dir, "events").where("value is not null").select(F.col("value").alias("v"))
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    bin_of = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10)), F.lit(9)).cast("int")
    return values.crossJoin(F.broadcast(bounds)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))


@query("SRT-01", "SELECT o_orderkey FROM orders ORDER BY nullif(o_totalprice, 0) DESC NULLS LAST, o_orderdate, o_orderkey LIMIT 100")
def srt_01(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.nullif(F.col("o_totalprice"), F.lit(0.0)).desc_nulls_last(), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("SRT-02", "SELECT c_custkey FROM customer ORDER BY (nullif(c_mktsegment, 'HOUSEHOLD') IS NOT NULL), c_acctbal, c_custkey LIMIT 50")
def srt_02(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).isNotNull(), "c_acctbal", "c_custkey").limit(50).select("c_custkey")


@query("SRT-03", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def srt_03(spark, sf_dir):
    """Each task keeps the best five of a class before the shuffle."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 5").select("o_orderpriority", "o_orderkey")


@query("SRT-04", "SELECT o_orderkey FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 200")
def srt_04(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey > 5000").orderBy("o_orderkey").limit(200).select("o_orderkey")


@query("SRT-05", "SELECT o_custkey, arg_min(o_orderpriority, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey)) AS best FROM orders GROUP BY 1")
def srt_05(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(rank, "o_orderkey")).alias("best"))


@query("SET-01", "SELECT 'c' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier")
def set_01(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"))
    return customers.unionByName(table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id")))


@query("SET-02", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def set_02(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()


@query("SET-03", "SELECT unnest(generate_series(DATE '1995-01-02', DATE '1995-12-31', INTERVAL 1 DAY))::DATE AS day EXCEPT SELECT l_shipdate::DATE FROM lineitem WHERE l_returnflag = 'R'")
def set_03(spark, sf_dir):
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-02', DATE'1995-12-31')) AS day")
    return days.join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_shipdate").cast("date").alias("day")), "day", "left_anti")


@query("SET-04", "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_custkey || '|' || o_orderdate::DATE END, 'one' || o_orderkey)) AS rep FROM orders")
def set_04(spark, sf_dir):
    shared = F.when(F.col("o_orderstatus") != "P", F.concat_ws("|", "o_custkey", F.col("o_orderdate").cast("date")))
    return changes.with_representative(table(spark, sf_dir, "orders"), shared, "o_orderkey").select("o_orderkey", "rep")


@query("QRY-03", oracle("fundamentals", "SELECT cik, period_end, revenue FROM fundamentals WHERE period_end = (SELECT max(period_end) FROM fundamentals) ORDER BY revenue DESC NULLS LAST, cik LIMIT 100"))
def qry_03(spark, sf_dir):
    f = fundamentals(spark, sf_dir)
    last = f.agg(F.max("period_end").alias("period_end"))
    return f.join(F.broadcast(last), "period_end").orderBy(F.desc_nulls_last("revenue"), "cik").limit(100).select("cik", "period_end", "revenue")


@query("QRY-04", "SELECT DISTINCT o_orderpriority AS event_class FROM orders ORDER BY 1")
def qry_04(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("event_class")).distinct().orderBy("event_class")


@query("QRY-07", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, abs(o_totalprice) DESC, o_orderkey LIMIT 50")
def qry_07(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.abs("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("QRY-21", "SELECT o_orderkey, l_linenumber, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_shipdate > TIMESTAMP '2001-06-01'")
def qry_21(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > F.lit("2001-06-01").cast("timestamp_ntz"))
    waiting = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    return waiting.join(lines, waiting.o_orderkey == lines.l_orderkey).select("o_orderkey", "l_linenumber", "l_shipdate")


@query("QRY-24", oracle("events", "SELECT event_class, count(*) AS n, count(*) FILTER (cik IN (SELECT s_suppkey FROM supplier)) AS excluded FROM ev GROUP BY 1"))
def qry_24(spark, sf_dir):
    out = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cik"), F.lit(1).alias("hit")).distinct()
    marked = market_events(spark, sf_dir).join(out, "cik", "left")
    return marked.groupBy("event_class").agg(F.count("*").alias("n"), F.count("hit").alias("excluded"))
