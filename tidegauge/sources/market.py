"""Price bars, market factors, events and yearly accounts, built from the order tables.

Tickers are a column of ``part`` or ``lineitem``. Mean prices come from sums of whole
cents and units, which are exact in any order: reruns give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, ticker: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    if ticker.startswith("p_"):
        part = table(spark, sf_dir, "part").select("p_partkey", ticker, "p_size", "p_retailprice")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col(ticker).alias("ticker"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
        *[c for c in lines.columns if c != ticker],
    )


def prices(spark: SparkSession, sf_dir: str, ticker: str = "p_type") -> DataFrame:
    """Daily bars: ``ticker, trade_date, open, high, low, close, volume``. One shuffle; the open is a
    minimum over an ordering struct, so partial sums shrink the lines before it."""
    lines = _lines(spark, sf_dir, ticker)
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "unit"))["unit"]
    return lines.groupBy("ticker", "trade_date").agg(
        first.alias("open"),
        F.max("unit").alias("high"),
        F.min("unit").alias("low"),
        _mean_price().alias("close"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
    )


def _mean_price():
    return F.sum("cents").cast("double") / (100 * F.sum("l_quantity"))


def factors(spark: SparkSession, sf_dir: str, rf: float = 0.00005) -> DataFrame:
    """``trade_date, mkt_rf, smb, hml, rf``: market, small minus large ``p_size``, high minus low ``p_retailprice``.

    One pass over the lines makes the daily level of every part of the market; a
    part's return is against its last level before. Days on which a part has no line go.
    """
    typical = table(spark, sf_dir, "part").agg(F.avg("p_retailprice").alias("typical"))  # one row
    lines = _lines(spark, sf_dir, "p_type").crossJoin(F.broadcast(typical))
    parts = {
        "mkt": F.lit(True),
        "small": F.col("p_size") <= 25,
        "large": F.col("p_size") > 25,
        "value": F.col("p_retailprice") > F.col("typical"),
        "growth": F.col("p_retailprice") <= F.col("typical"),
    }
    level = lambda c: F.sum(F.when(c, F.col("cents"))).cast("double") / (100 * F.sum(F.when(c, F.col("l_quantity"))))
    day = lines.groupBy("trade_date").agg(*[level(c).alias(n) for n, c in parts.items()])
    before = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)  # a row per calendar day of the whole market
    returned = day.select("trade_date", *[(F.col(n) / F.last(n, ignorenulls=True).over(before) - 1).alias(n) for n in parts]).dropna()
    return returned.select(
        "trade_date",
        (F.col("mkt") - rf).alias("mkt_rf"),
        (F.col("small") - F.col("large")).alias("smb"),
        (F.col("value") - F.col("growth")).alias("hml"),
        F.lit(rf).alias("rf"),
    )


def events(spark: SparkSession, sf_dir: str, ticker: str = "p_type") -> DataFrame:
    """``event_id, ticker, event_class, filed_at, d0, cik``: orders that have lines."""
    orders = table(spark, sf_dir, "orders")
    first = _lines(spark, sf_dir, ticker).groupBy("l_orderkey").agg(F.min("ticker").alias("ticker"))
    return orders.join(first, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("event_id"),
        "ticker",
        F.col("o_orderpriority").alias("event_class"),
        F.col("o_orderdate").alias("filed_at"),
        F.col("o_orderdate").cast("date").alias("d0"),
        F.col("o_custkey").alias("cik"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly accounts by customer, filed 60 days after the year's end."""
    end = F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    done = F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", cents)), F.lit(0))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("cik"), end.alias("period_end"))
        .agg(
            (F.sum(cents).cast("double") / 100).alias("revenue"),
            ((10 * done - 3 * F.sum(cents)).cast("double") / 1000).alias("net_income"),
            F.count("*").alias("shares"),
        )
        .withColumn("filed_at", F.date_add("period_end", 60))
    )


#: The same tables for the oracle, as common table expressions.
ORACLE = {
    "lines": """lines AS (
        SELECT p_type AS ticker, l_shipdate::DATE AS trade_date, l_extendedprice / l_quantity AS unit,
               round(l_extendedprice * 100)::BIGINT AS cents, *
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0)""",
    "prices": """prices AS (
        SELECT ticker, trade_date,
               arg_min(unit, (l_orderkey, l_linenumber, l_partkey, l_suppkey, unit)) AS open,
               max(unit) AS high, min(unit) AS low,
               sum(cents)::DOUBLE / (100 * sum(l_quantity)) AS close, sum(l_quantity)::BIGINT AS volume
        FROM lines GROUP BY ticker, trade_date)""",
    "factors": """day AS (
        SELECT trade_date,
               sum(cents)::DOUBLE / (100 * sum(l_quantity)) AS a,
               sum(cents) FILTER (p_size <= 25)::DOUBLE / (100 * sum(l_quantity) FILTER (p_size <= 25)) AS s,
               sum(cents) FILTER (p_size > 25)::DOUBLE / (100 * sum(l_quantity) FILTER (p_size > 25)) AS l,
               sum(cents) FILTER (p_retailprice > typical)::DOUBLE / (100 * sum(l_quantity) FILTER (p_retailprice > typical)) AS v,
               sum(cents) FILTER (p_retailprice <= typical)::DOUBLE / (100 * sum(l_quantity) FILTER (p_retailprice <= typical)) AS g
        FROM lines CROSS JOIN (SELECT avg(p_retailprice) AS typical FROM part) GROUP BY trade_date),
    factors AS (
        SELECT m.trade_date, m.r - 0.00005::DOUBLE AS mkt_rf, s.r - l.r AS smb, v.r - g.r AS hml, 0.00005::DOUBLE AS rf
        FROM (SELECT trade_date, a / lag(a) OVER (ORDER BY trade_date) - 1 AS r FROM day WHERE a IS NOT NULL) m
        JOIN (SELECT trade_date, s / lag(s) OVER (ORDER BY trade_date) - 1 AS r FROM day WHERE s IS NOT NULL) s USING (trade_date)
        JOIN (SELECT trade_date, l / lag(l) OVER (ORDER BY trade_date) - 1 AS r FROM day WHERE l IS NOT NULL) l USING (trade_date)
        JOIN (SELECT trade_date, v / lag(v) OVER (ORDER BY trade_date) - 1 AS r FROM day WHERE v IS NOT NULL) v USING (trade_date)
        JOIN (SELECT trade_date, g / lag(g) OVER (ORDER BY trade_date) - 1 AS r FROM day WHERE g IS NOT NULL) g USING (trade_date)
        WHERE m.r IS NOT NULL AND s.r IS NOT NULL AND l.r IS NOT NULL AND v.r IS NOT NULL AND g.r IS NOT NULL)""",
    "events": """ev AS (
        SELECT o_orderkey AS event_id, min(ticker) AS ticker, o_orderpriority AS event_class,
               o_orderdate AS filed_at, o_orderdate::DATE AS d0, o_custkey AS cik
        FROM orders JOIN lines ON o_orderkey = l_orderkey
        GROUP BY ALL)""",
    "fundamentals": """fundamentals AS (
        SELECT o_custkey AS cik, make_date(year(o_orderdate), 12, 31) AS period_end,
               sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100 AS revenue,
               (10 * coalesce(sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = 'F'), 0) - 3 * sum(round(o_totalprice * 100)::BIGINT))::DOUBLE / 1000 AS net_income,
               count(*) AS shares, make_date(year(o_orderdate), 12, 31) + 60 AS filed_at
        FROM orders GROUP BY ALL)""",
}


def oracle(names: str, body: str) -> str:
    """``body`` after the common table expressions called ``names`` (and ``lines`` where they need it)."""
    wanted = names.split()
    if {"prices", "factors", "events"} & set(wanted):
        wanted = ["lines", *[n for n in wanted if n != "lines"]]
    ctes = ",\n    ".join(ORACLE[n] for n in wanted)
    body = body.strip()
    return f"WITH {ctes}" + (f",\n    {body[5:]}" if body.startswith("WITH ") else f"\n    {body}")
