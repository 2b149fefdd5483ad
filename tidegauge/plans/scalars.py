"""Queries: scalar functions on JSON, texts and days, the exchange calendar, and time and model predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import finance, text
from ..operators import joins, lookback
from ..sources import market
from .registry import query


def _table(spark, sf_dir, name):
    return market.table(spark, sf_dir, name)


@query("SCL-01", "SELECT event_id, (props->>'k')::INT AS k, props->>'missing' AS missing FROM events")
def scl_01(spark, sf_dir):
    """JSON paths; one that is not there is null."""
    get = lambda path: F.get_json_object("props", path)
    return _table(spark, sf_dir, "events").select("event_id", get("$.k").cast("int").alias("k"), get("$.missing").alias("missing"))


@query("SCL-02", "SELECT event_id, key, (props->>key)::INT AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def scl_02(spark, sf_dir):
    each = F.explode(F.from_json("props", "map<string,int>"))
    return _table(spark, sf_dir, "events").select("event_id", each.alias("key", "value"))


@query("SCL-03", """SELECT event_id, '{"type":"' || event_type || '","k":' || (props->>'k') || '}' AS doc FROM events""")
def scl_03(spark, sf_dir):
    built = F.to_json(F.struct(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    return _table(spark, sf_dir, "events").select("event_id", built.alias("doc"))


@query("SCL-04", "SELECT url_shape, count(*) AS n FROM (SELECT regexp_replace(url, '[-+]?[0-9][0-9.,]*', 'N', 'g') AS url_shape FROM pages) GROUP BY 1")
def scl_04(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(text.masked_numbers(F.col("url")).alias("url_shape")).agg(F.count("*").alias("n"))


@query("SCL-05", """
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN e >= 101 THEN left(text, e) ELSE left(text, 200) END AS cut
    FROM (SELECT doc_id, text, greatest(CASE WHEN a > 0 THEN 201 - a END, CASE WHEN b > 0 THEN 201 - b END, CASE WHEN c > 0 THEN 201 - c END) AS e
          FROM (SELECT doc_id, text, instr(reverse(left(text, 200)), '.') AS a, instr(reverse(left(text, 200)), '!') AS b, instr(reverse(left(text, 200)), '?') AS c FROM documents))""")
def scl_05(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.cut_at_sentence(F.col("text"), 200).alias("cut"))


# Words that tell of guidance, and of rumours.
GUIDANCE = (
    "guidance", "outlook", "we expect", "we anticipate", "reaffirm", "raising our", "raising its", "lowering our",
    "lowering its", "full-year outlook", "full year outlook", "forecast",
)
RUMOURS = (
    "rumored", "rumoured", "reportedly", "sources familiar", "sources say", "media reports",
    "according to people familiar", "speculation", "expected to announce", "in talks", "under consideration",
)
#: Words that occur in the sample texts.
SAMPLE_WORDS = ("the of", "chen", "est", "mail")


def _any_of(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("SCL-06", f"""
    SELECT source, bool_or({_any_of(GUIDANCE)}) AS guidance, bool_or({_any_of(RUMOURS)}) AS rumour, bool_or({_any_of(SAMPLE_WORDS)}) AS sample,
           count(*) FILTER ({_any_of(SAMPLE_WORDS)}) AS n FROM documents GROUP BY 1""")
def scl_06(spark, sf_dir):
    """Whether any text of a source holds one of the words; null where a source has no text."""
    has = {n: text.contains_any(F.col("text"), list(w)) for n, w in (("guidance", GUIDANCE), ("rumour", RUMOURS), ("sample", SAMPLE_WORDS))}
    return _table(spark, sf_dir, "documents").groupBy("source").agg(*[F.bool_or(c).alias(n) for n, c in has.items()], F.count_if(has["sample"]).alias("n"))


@query("SCL-07", market.oracle("events", """
    SELECT a.event_id, count(b.event_id) AS n_texts, bool_or(b.said LIKE '%urgent%') AS any_urgent
    FROM ev a LEFT JOIN LATERAL (
        SELECT event_id, lower(event_class) AS said FROM ev b WHERE b.cik = a.cik AND b.d0 < a.d0 AND b.d0 >= a.d0 - 180 ORDER BY b.d0 DESC, b.event_id DESC LIMIT 10) b ON TRUE
    GROUP BY a.event_id"""))
def scl_07(spark, sf_dir):
    """Of the newest ten texts of the same company in the 180 days before, whether any holds a word."""
    texts = market.events(spark, sf_dir).withColumn("hit", text.contains_any(F.col("event_class"), ["urgent"]))
    found = lookback.newest_before(texts, "cik", "d0", "event_id", "hit", days=180, most=10)
    return found.select("event_id", F.size("before").cast("bigint").alias("n_texts"), F.when(F.size("before") > 0, F.exists("before", lambda x: x)).alias("any_urgent"))


@query("SCL-08", "SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderpriority) AS digest, left(sha256(o_orderkey || '|' || o_orderpriority), 12) AS id FROM orders")
def scl_08(spark, sf_dir):
    parts = (F.col("o_orderkey").cast("string"), F.col("o_orderpriority"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.digest_id(*parts, length=64).alias("digest"), text.digest_id(*parts).alias("id"))


@query("SCL-09", """
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN '+' ELSE '-' END || printf('%.1f', floor(abs(c_acctbal) / 10 + 0.5) / 10) || '%' AS change, '$' || floor(abs(c_acctbal) + 0.5)::BIGINT AS amount,
           CASE WHEN c_acctbal IS NULL THEN 'n/a' ELSE printf('[%.2f, %.2f]', c_acctbal - 1, c_acctbal + 1) END AS interval_text FROM customer""")
def scl_09(spark, sf_dir):
    v = F.col("c_acctbal")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", text.signed_percent(v / 100).alias("change"), text.money(v).alias("amount"), text.interval_text(v - 1, v + 1).alias("interval_text")
    )


#: Sample phrases and patterns of the translation.
PHRASES = {"1-URGENT": "urgente", "5-LOW": "baja"}
PATTERNS = (("^([0-9])-(.*)$", "$2 ($1)"), ("MEDIUM", "media"))


@query("SCL-10", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgente' WHEN '5-LOW' THEN 'baja' ELSE replace(o_orderpriority[3:] || ' (' || o_orderpriority[1] || ')', 'MEDIUM', 'media') END AS phrase FROM orders")
def scl_10(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.translated(F.col("o_orderpriority"), PHRASES, PATTERNS).alias("phrase"))


@query("SCL-11", r"""
    SELECT page_id, regexp_replace(html, '(?i)<(/?\s*title[^>]*)>', '[\1]', 'g') AS neutral,
           replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
           CASE WHEN length(flat) <= 80 THEN flat ELSE rtrim(left(flat, 79)) || '…' END AS clip
    FROM (SELECT *, trim(regexp_replace(html, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS flat FROM pages)""")
def scl_11(spark, sf_dir):
    html = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", text.neutral_tags(html, "title").alias("neutral"), text.escaped_html(F.col("url")).alias("escaped"), text.clipped(html, 80).alias("clip"))


@query("SCL-12", """SELECT event_id, CASE WHEN event_type <> 'error' AND (props->>'k')::DOUBLE BETWEEN 10 AND 90 THEN (props->>'k')::DOUBLE END AS k, event_type = 'error' OR (props->>'k')::DOUBLE NOT BETWEEN 10 AND 90 AS rejected FROM events""")
def scl_12(spark, sf_dir):
    """A number in its range, or null: a boolean (here: of errors), a text or a number out of range is rejected."""
    doc = F.when(F.col("event_type") == "error", F.lit('{"k": true}')).otherwise(F.col("props"))
    value = text.json_number(doc, "$.k", 10, 90)
    return _table(spark, sf_dir, "events").select("event_id", value.alias("k"), value.isNull().alias("rejected"))


@query("SCL-13", "SELECT c_custkey, round(greatest(0, least(100, (c_acctbal - 1000) / 4000 * 100)), 6) AS up, round(greatest(0, least(100, (c_acctbal - 5000) / -4000 * 100)), 6) AS down FROM customer")
def scl_13(spark, sf_dir):
    v = F.col("c_acctbal")
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(finance.scaled(v, 1000, 5000), 6).alias("up"), F.round(finance.scaled(v, 5000, 1000), 6).alias("down"))


_HOLIDAYS = """y AS (SELECT unnest(range(1990, 2036))::INT AS y),
    e0 AS (SELECT y, y % 19 AS g, y // 100 AS c, (y // 100 - (y // 100) // 4 - (8 * (y // 100) + 13) // 25 + 19 * (y % 19) + 15) % 30 AS h FROM y),
    e1 AS (SELECT *, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM e0),
    e2 AS (SELECT *, i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS l FROM e1),
    easter AS (SELECT y, make_date(y, (3 + (l + 40) // 44)::INT, (l + 28 - 31 * ((3 + (l + 40) // 44) // 4))::INT) AS d FROM e2),
    fixed AS (
        SELECT make_date(y, 1, 1) AS d, FALSE AS back FROM y UNION ALL SELECT make_date(y, 6, 19), TRUE FROM y WHERE y >= 2022
        UNION ALL SELECT make_date(y, 7, 4), TRUE FROM y UNION ALL SELECT make_date(y, 12, 25), TRUE FROM y),
    hol AS (
        SELECT CASE isodow(d) WHEN 7 THEN d + 1 WHEN 6 THEN d - 1 ELSE d END AS d FROM fixed WHERE back OR isodow(d) <> 6
        UNION SELECT d - 2 FROM easter
        UNION SELECT d FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2035-12-31', INTERVAL 1 DAY))::DATE AS d)
              WHERE isodow(d) = 1 AND ((month(d) IN (1, 2) AND day(d) BETWEEN 15 AND 21) OR (month(d) = 5 AND day(d) >= 25) OR (month(d) = 9 AND day(d) <= 7))
                 OR isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28
        UNION SELECT DATE '2025-01-09'),
    days AS (
        SELECT d AS day, isodow(d) < 6 AND d NOT IN (SELECT d FROM hol) AS is_session FROM (
            SELECT unnest(generate_series(DATE '1995-01-01', DATE '2030-12-31', INTERVAL 1 DAY))::DATE AS d)),
    cal AS (
        SELECT day, is_session, is_session AND (isodow(day) = 5 AND month(day) = 11 AND day(day) BETWEEN 23 AND 29
                   OR strftime(day, '%m-%d') IN ('07-03', '12-24') AND isodow(day) <= 4) AS closes_early,
               min(CASE WHEN is_session THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_session
        FROM days)"""


@query("CAL-01", f"WITH {_HOLIDAYS} SELECT day, is_session, next_session FROM cal")
def cal_01(spark, sf_dir):
    return cal.calendar(spark, "1995-01-01", "2030-12-31").select("day", "is_session", "next_session")


@query("CAL-02", f"WITH {_HOLIDAYS} SELECT day FROM cal WHERE closes_early")
def cal_02(spark, sf_dir):
    return cal.calendar(spark, "1995-01-01", "2030-12-31").where("closes_early").select("day")


@query("CAL-03", f"""
    WITH {_HOLIDAYS},
    t AS (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS local FROM events),
    s AS (SELECT event_id, local::DATE + CASE WHEN local::TIME = TIME '00:00:00' OR local::TIME >= CASE WHEN closes_early THEN TIME '13:00:00' ELSE TIME '16:00:00' END THEN 1 ELSE 0 END AS d
          FROM t JOIN cal ON cal.day = local::DATE)
    SELECT event_id, next_session AS d0 FROM s JOIN cal ON cal.day = s.d""")
def cal_03(spark, sf_dir):
    """The session on which an event counts: the next one if its hour is unknown or after the close."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    events = _table(spark, sf_dir, "events").select("event_id", local.alias("local"))
    return cal.assigned(events, "local", "d0", cal.calendar(spark, "1995-01-01", "2030-12-31")).select("event_id", "d0")


@query("CAL-04", """
    SELECT event_id, strftime(local, '%Y-%m-%d') || CASE WHEN local::TIME = TIME '00:00:00' THEN ' (hour unknown)' WHEN hour(local) < 9 OR (hour(local) = 9 AND minute(local) < 30) THEN ' before the open'
        WHEN hour(local) >= 16 THEN ' after the close' ELSE ' during the session' END AS moment
    FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS local FROM events)""")
def cal_04(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    return _table(spark, sf_dir, "events").select("event_id", cal.moment_text(local).alias("moment"))


@query("CAL-05", """
    SELECT o_orderkey, (date_trunc('week', d) - INTERVAL 7 DAY)::DATE + CASE WHEN isodow(d) >= 6 THEN 7 ELSE 0 END AS week_start, (date_trunc('week', d) - INTERVAL 3 DAY)::DATE + CASE WHEN isodow(d) >= 6 THEN 7 ELSE 0 END AS week_end,
           date_trunc('month', d)::DATE AS month_floor, CASE WHEN day(d) = 1 THEN d ELSE (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE END AS month_ceil,
           isoyear(d) || '-W' || lpad(week(d)::VARCHAR, 2, '0') AS week_id
    FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def cal_05(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    start, end = cal.last_complete_week(day)
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", start.alias("week_start"), end.alias("week_end"), cal.month_floor(day).alias("month_floor"), cal.month_ceil(day).alias("month_ceil"), cal.week_id(day).alias("week_id")
    )


@query("PRJ-01", """
    SELECT 'o' || o_orderkey AS id, timezone('America/New_York', timezone('UTC', o_orderdate))::TIME = TIME '00:00:00' OR (o_orderdate < TIMESTAMP '2026-09-26' AND o_orderdate::TIME = TIME '00:00:00') AS unknown FROM orders
    UNION ALL SELECT 'e' || event_id, timezone('America/New_York', timezone('UTC', ts))::TIME = TIME '00:00:00' OR (ts < TIMESTAMP '2026-09-26' AND ts::TIME = TIME '00:00:00') FROM events""")
def prj_01(spark, sf_dir):
    times = _table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    times = times.unionByName(_table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("ts").alias("at")))
    at = F.col("at").cast("timestamp")
    return times.select("id", cal.hour_unknown(at, at).alias("unknown"))


#: Sample cut-off days of models; a name matches its key or the key with a suffix.
CUTOFFS = {"1-URGENT": "1996-06-30", "2": "1997-01-31", "2-HIGH": "1997-06-30"}


@query("PRJ-13", """
    SELECT o_orderkey, m.cutoff, coalesce(o_orderdate::DATE > m.cutoff, FALSE) AS usable
    FROM orders LEFT JOIN (SELECT p, max(c) AS cutoff FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (VALUES ('1-URGENT', DATE '1996-06-30'), ('2', DATE '1997-01-31'), ('2-HIGH', DATE '1997-06-30')) AS k(k, c)
        WHERE p = k OR starts_with(p, k || '-') GROUP BY p) m ON m.p = o_orderpriority""")
def prj_13(spark, sf_dir):
    """Events after the latest cut-off of the models that match: a table of a few rows, joined by broadcast."""
    keys = spark.createDataFrame(list(CUTOFFS.items()), "key string, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("d0"))
    names = orders.select("o_orderpriority").distinct()
    match = (F.col("o_orderpriority") == F.col("key")) | F.startswith("o_orderpriority", F.concat("key", F.lit("-")))
    latest = names.join(F.broadcast(keys), match).groupBy("o_orderpriority").agg(F.max("cutoff").alias("cutoff"))
    found = orders.join(latest, "o_orderpriority", "left")
    return found.select("o_orderkey", "cutoff", F.coalesce(F.col("d0") > F.col("cutoff"), F.lit(False)).alias("usable"))


@query("UDF-01", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS class, o_orderdate::DATE + 1 AS day FROM orders")
def udf_01(spark, sf_dir):
    """Callables given by the caller classify and date the events; they take and return columns."""
    classify = lambda price: F.when(price > 250_000, "large").otherwise("small")
    day_of = lambda at: F.date_add(at.cast("date"), 1)
    return lookback.labelled(_table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", classify, day_of).select("o_orderkey", "class", "day")


@query("DEC-05", market.oracle("events", """
    SELECT event_id FROM ev a WHERE event_class = '1-URGENT' AND NOT EXISTS (
        SELECT 1 FROM ev b WHERE b.cik = a.cik AND b.event_class <> '1-URGENT' AND b.d0 BETWEEN a.d0 - 10 AND a.d0)"""))
def dec_05(spark, sf_dir):
    """Urgent events without a filing of the company's own in the ten days before."""
    events = market.events(spark, sf_dir)
    urgent, own = events.where("event_class = '1-URGENT'"), events.where("event_class <> '1-URGENT'").select("cik", F.col("d0").alias("own_day"))
    last = joins.as_of(urgent.select("event_id", "cik", "d0"), own.withColumn("seen", F.lit(1)), ["cik"], "d0", "own_day", ["seen"])
    recent = F.col("match.own_day") >= F.date_sub("d0", 10)
    return last.where(~F.coalesce(recent, F.lit(False))).select("event_id")


@query("AGG-22", """
    SELECT event_type, round(avg(value), 4) AS mean_value, round(100 * count(*) FILTER (value > 100) / count(*), 4) AS pct_traded,
           CASE WHEN 100 * count(*) FILTER (value > 100) / count(*) < 10 THEN 'too few' WHEN 100 * count(*) FILTER (value > 100) / count(*) > 70 THEN 'too many' ELSE 'ok' END AS advice
    FROM events GROUP BY 1""")
def agg_22(spark, sf_dir):
    pct = 100 * F.count_if(F.col("value") > 100) / F.count("*")
    sums = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean_value"), pct.alias("pct"))
    advice = F.when(F.col("pct") < 10, "too few").when(F.col("pct") > 70, "too many").otherwise("ok")
    return sums.select("event_type", "mean_value", F.round("pct", 4).alias("pct_traded"), advice.alias("advice"))


@query("TSQ-04", market.oracle("prices", """
    SELECT p.ticker, count(*) AS bars FROM prices p JOIN (SELECT ticker, max(trade_date) AS captured FROM prices GROUP BY 1) c USING (ticker)
    LEFT JOIN (SELECT p_type AS ticker, DATE '2001-09-20' + length(p_type)::INT * 7 AS reviewed FROM part GROUP BY ALL) r USING (ticker) WHERE reviewed IS NULL OR captured > reviewed GROUP BY 1"""))
def tsq_04(spark, sf_dir):
    """Only series that were captured after their last review are reviewed again."""
    bars = market.prices(spark, sf_dir)
    reviewed = _table(spark, sf_dir, "part").select(F.col("p_type").alias("ticker"), F.date_add(F.lit("2001-09-20").cast("date"), F.length("p_type") * 7).alias("reviewed")).distinct()
    return lookback.captured_after(bars, "trade_date", reviewed).groupBy("ticker").agg(F.count("*").alias("bars"))


@query("TSQ-06", market.oracle("prices", """
    WITH sp AS (SELECT ticker, trade_date AS split_date, 1.01::DOUBLE AS ratio FROM prices WHERE high > 6 * low AND volume < 150)
    SELECT p.ticker, p.trade_date, round(p.close * coalesce(s.f, 1), 4) AS traded FROM prices p LEFT JOIN (
        SELECT p.ticker, p.trade_date, exp(sum(ln(ratio))) AS f FROM prices p JOIN sp ON sp.ticker = p.ticker AND sp.split_date > p.trade_date AND sp.split_date <= DATE '1996-01-01' GROUP BY ALL) s
    ON s.ticker = p.ticker AND s.trade_date = p.trade_date WHERE p.trade_date <= DATE '1996-01-01'"""))
def tsq_06(spark, sf_dir):
    """Prices as traded at capture: closes times the ratios of all splits after the bar, up to the capture."""
    bars = market.prices(spark, sf_dir)
    at = F.lit("1996-01-01").cast("date")
    marked = bars.where("high > 6 * low and volume < 150").select("ticker", F.col("trade_date").alias("split_date"), F.lit(1.01).alias("ratio"))
    factors = lookback.later_product(bars.where(F.col("trade_date") <= at), marked.where(F.col("split_date") <= at))
    return factors.select("ticker", "trade_date", F.round(F.col("close") * F.col("factor"), 4).alias("traded"))


@query("TSQ-08", market.oracle("prices", """
    SELECT ticker, last_day + 1 AS start, DATE '2001-12-31' AS stop, DATE '2001-12-31' - last_day AS days FROM (SELECT ticker, max(trade_date) AS last_day FROM prices WHERE volume > 60 GROUP BY 1)
    WHERE DATE '2001-12-31' - last_day > 7 ORDER BY days DESC, ticker"""))
def tsq_08(spark, sf_dir):
    """What is to be downloaded: from the day after the last one stored, unless that is a week ago or less."""
    stored = market.prices(spark, sf_dir).where("volume > 60")
    return lookback.pending_ranges(stored, F.lit("2001-12-31").cast("date"), slack=7)


@query("TSQ-09", """
    SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def tsq_09(spark, sf_dir):
    """What retention removes: poor customers without orders, old orders without lines."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    poor = lookback.without_dependants(_table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey", [(orders, "o_custkey")])
    old = lookback.without_dependants(orders.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")), "o_orderkey", [(lines, "l_orderkey")])
    return poor.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).unionByName(old.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")))


@query("CHK-01", """
    SELECT 'price' AS rule, l_orderkey AS key, l_linenumber::VARCHAR AS value FROM lineitem WHERE NOT l_extendedprice < 100000
    UNION ALL SELECT 'discount', l_orderkey, l_linenumber::VARCHAR FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.09
    UNION ALL SELECT 'unique', l_orderkey, count(*)::VARCHAR FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'reference', l_orderkey, l_linenumber::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def chk_01(spark, sf_dir):
    """Rows that break a rule: checks, a unique key and a reference."""
    lines = _table(spark, sf_dir, "lineitem")
    rules = {"price": F.col("l_extendedprice") < 100_000, "discount": F.col("l_discount").between(0, 0.09)}
    known = _table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    value = F.col("l_linenumber").cast("string")
    return (
        lookback.violations(lines, rules, "l_orderkey", value)
        .unionByName(lookback.repeated_keys(lines, ["l_orderkey", "l_linenumber"], "l_orderkey"))
        .unionByName(lines.join(known, "l_orderkey", "left_anti").select(F.lit("reference").alias("rule"), F.col("l_orderkey").alias("key"), value.alias("value")))
    )


@query("QRY-25", market.oracle("prices events", """
    SELECT bucket, count(*) AS n FROM (
        SELECT CASE WHEN before = 0 THEN 'no bars' WHEN before < 60 THEN 'few bars' WHEN after = 0 THEN 'no bars after' ELSE 'complete' END AS bucket FROM (
            SELECT ev.event_id, count(p.ticker) FILTER (p.trade_date BETWEEN d0 - 250 AND d0 - 30) AS before, count(p.ticker) FILTER (p.trade_date BETWEEN d0 + 1 AND d0 + 20) AS after
            FROM ev LEFT JOIN prices p ON p.ticker = ev.ticker AND p.trade_date BETWEEN d0 - 250 AND d0 + 20 GROUP BY ev.event_id)) GROUP BY bucket"""))
def qry_25(spark, sf_dir):
    """Events by what bars they have: counts in a range are differences of running counts, no pair is made."""
    found = lookback.counts_in_ranges(market.events(spark, sf_dir), market.prices(spark, sf_dir), {"before": (-250, -30), "after": (1, 20)})
    bucket = F.when(F.col("before") == 0, "no bars").when(F.col("before") < 60, "few bars").when(F.col("after") == 0, "no bars after").otherwise("complete")
    return found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SIM-05", "SELECT user_id, event_type, min(ts) AS claimed_at FROM events GROUP BY ALL")
def sim_05(spark, sf_dir):
    """Claim once: of equal notifications the first is sent; each task keeps its first before the shuffle."""
    first = F.min(F.struct("ts", "event_id"))["ts"]
    return _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(first.alias("claimed_at"))
