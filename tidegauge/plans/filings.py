"""Queries: parsers of filings, factor tables, company facts and vendor prices, and what is written.

The texts are rendered from the tables, then parsed; the SQL takes the values from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes
from ..sources import filings, market, sinks
from .registry import query


def _index_lines(spark, sf_dir):
    """Index lines of all orders: forms by status, days in both spellings, and a preamble."""
    orders = market.table(spark, sf_dir, "orders").join(market.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    form = F.when(F.col("o_orderstatus") == "F", "8-K").when(F.col("o_orderstatus") == "O", "8-K/A").otherwise("10-Q")
    day = F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    company = F.concat("c_name", F.lit(", Inc."))
    line = F.concat_ws("  ", F.rpad(form, 12, " "), F.rpad(company, 40, " "), F.lpad("o_custkey", 7, "0"), day, F.concat(F.lit("edgar/data/"), "o_orderkey", F.lit(".txt  ")))
    head = spark.createDataFrame([("Form Type   Company Name   CIK   Date Filed  File Name",), ("-" * 80,)], "value string")
    return head.unionByName(orders.select(line.alias("value")))


@query("SRC-01", "SELECT c_name || ', Inc.' AS company, o_custkey::VARCHAR AS cik, o_orderdate::DATE AS filed, 'edgar/data/' || o_orderkey || '.txt' AS file FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def src_01(spark, sf_dir):
    return filings.index_rows(_index_lines(spark, sf_dir))


@query("SRC-02", "SELECT o_orderkey, '/Archives/edgar/daily-index/' || year(o_orderdate) || '/QTR' || quarter(o_orderdate) || '/form.' || strftime(o_orderdate, '%Y%m%d') || '.idx' AS index_path, '/Archives/edgar/data/' || o_orderkey || '.txt' AS archive_path FROM orders")
def src_02(spark, sf_dir):
    prefix = F.when(F.col("o_orderstatus") == "F", "/Archives/").otherwise("")
    file = F.concat(prefix, F.lit("edgar/data/"), "o_orderkey", F.lit(".txt"))
    return market.table(spark, sf_dir, "orders").select("o_orderkey", filings.index_path(F.col("o_orderdate")).alias("index_path"), filings.archive_path(file).alias("archive_path"))


#: Items in the headers of the sample, by priority of the order; the first is a number, the others are titles.
_HEADER_ITEMS = {
    "1-URGENT": ("Results of Operations and Financial Condition", "9.01"),
    "2-HIGH": ("Entry into a Material Definitive Agreement.", "Other Events"),
    "3-MEDIUM": ("5.02 Departure", "Nothing that is known"),
    "4-NOT SPECIFIED": ("Termination of a Material Definitive Agreement", "Financial Statements and Exhibits"),
    "5-LOW": ("Regulation FD Disclosure",),
}


def _headers(spark, sf_dir):
    lines = F.create_map(*[F.lit(x) for k, v in _HEADER_ITEMS.items() for x in (k, "".join(f"ITEM INFORMATION:\t\t{i}\n" for i in v))])
    at = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_custkey") % 12 + 8).cast("string"), 2, "0"), F.lit("3015"))
    stamp = F.when(F.col("o_orderstatus") == "P", "none").otherwise(at)
    header = F.concat(F.lit("<ACCEPTANCE-DATETIME>"), stamp, F.lit("\nACCESSION NUMBER:\t\t0000-"), "o_orderkey", F.lit("\n"), F.coalesce(lines[F.col("o_orderpriority")], F.lit("")))
    return market.table(spark, sf_dir, "orders").select("o_orderkey", header.alias("header"))


@query("SRC-03", """
    SELECT o_orderkey, '0000-' || o_orderkey AS accession, CASE o_orderpriority WHEN '1-URGENT' THEN '2.02,9.01' WHEN '2-HIGH' THEN '1.01,8.01' WHEN '3-MEDIUM' THEN '5.02'
        WHEN '4-NOT SPECIFIED' THEN '1.02,9.01' WHEN '5-LOW' THEN '7.01' ELSE '' END AS items FROM orders""")
def src_03(spark, sf_dir):
    header = F.col("header")
    return _headers(spark, sf_dir).select("o_orderkey", filings.accession(header, F.lit("?")).alias("accession"), F.array_join(filings.item_codes(header), ",").alias("items"))


@query("SRC-04", """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN timezone('UTC', timezone('America/New_York', o_orderdate + to_hours(o_custkey % 12 + 8) + INTERVAL 30 MINUTE + INTERVAL 15 SECOND)) END AS accepted_at FROM orders""")
def src_04(spark, sf_dir):
    return _headers(spark, sf_dir).select("o_orderkey", filings.accepted_at(F.col("header")).cast("timestamp_ntz").alias("accepted_at"))


def _submissions(spark, sf_dir):
    """A submission for each document: the text as the primary one and, for two languages, a press release before it."""
    body = F.coalesce("text", F.lit(""))
    primary = F.concat(F.lit("<DOCUMENT>\n<TYPE>8-K\n<SEQUENCE>1\n<FILENAME>a.htm\n<TEXT>"), body, F.lit("</TEXT>\n</DOCUMENT>\n"))
    release = F.concat(F.lit("<document>\n<TYPE>EX-99.1\n<SEQUENCE>2\n<TEXT><p>Release &amp; more.</p> "), body, F.lit("</TEXT>\n</document>\n"))
    raw = F.when(F.col("lang").isin("de", "fr"), F.concat(release, primary)).otherwise(primary)
    return market.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query("SRC-05", """
    SELECT doc_id, '8-K' AS type, 1 AS sequence, 'a.htm' AS filename, length(coalesce(text, '')) AS chars FROM documents
    UNION ALL SELECT doc_id, 'EX-99.1', 2, NULL, length(coalesce(text, '')) + length('<p>Release &amp; more.</p> ') FROM documents WHERE lang IN ('de', 'fr')""")
def src_05(spark, sf_dir):
    found = _submissions(spark, sf_dir).select("doc_id", F.explode(filings.submission_documents(F.col("raw"))).alias("d"))
    return found.select("doc_id", "d.type", "d.sequence", "d.filename", F.length("d.raw_text").cast("bigint").alias("chars"))


def _visible(raw: str) -> str:
    """SQL for the visible text of a page."""
    out = f"regexp_replace({raw}, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g')"
    for pattern in (r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query("SRC-06", f"SELECT page_id, {_visible('html')} AS text FROM pages")
def src_06(spark, sf_dir):
    return market.table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


def _cut(value: str, limit: int) -> str:
    last = [f"CASE WHEN instr(reverse(left({value}, {limit})), '{c}') > 0 THEN {limit} - instr(reverse(left({value}, {limit})), '{c}') + 1 END" for c in ".!?"]
    end = f"greatest({', '.join(last)})"
    return f"CASE WHEN length({value}) <= {limit} THEN {value} WHEN {end} >= {limit} * 0.5 + 1 THEN left({value}, {end}) ELSE left({value}, {limit}) END"


@query("SRC-07", rf"""
    WITH d AS (SELECT doc_id, lang IN ('de', 'fr') AS ex, {_visible("coalesce(text, '')")} AS own, {_visible("'<p>Release &amp; more.</p> ' || coalesce(text, '')")} AS release FROM documents),
    j AS (SELECT doc_id, ex, CASE WHEN ex THEN trim(({_cut('own', 2500)}) || chr(10) || chr(10) || release, ' ' || chr(10)) ELSE own END AS body FROM d)
    SELECT doc_id, coalesce(ex, FALSE) AS includes_exhibit, sha256({_cut('body', 8000)}) AS digest, length({_cut('body', 8000)}) AS length_chars FROM j""")
def src_07(spark, sf_dir):
    best = _submissions(spark, sf_dir).select("doc_id", filings.best_text(filings.submission_documents(F.col("raw"))).alias("b"))
    return best.select("doc_id", "b.includes_exhibit", F.sha2("b.text", 256).alias("digest"), F.length("b.text").cast("bigint").alias("length_chars"))


@query("SRC-08", market.oracle("prices factors", "SELECT trade_date, round(round(mkt_rf * 100, 4) / 100, 6) AS mkt_rf, round(round(smb * 100, 4) / 100, 6) AS smb, round(round(hml * 100, 4) / 100, 6) AS hml, round(round(rf * 100, 4) / 100, 6) AS rf FROM factors"))
def src_08(spark, sf_dir):
    """Factors written as text with a preamble and a footer that looks like more rows, and read again."""
    f = market.factors(spark, sf_dir)
    percent = [F.format_string("%.4f", F.round(F.col(c) * 100, 4)) for c in ("mkt_rf", "smb", "hml", "rf")]
    rows = f.select(F.unix_date("trade_date").alias("line_no"), F.concat_ws(",", F.date_format("trade_date", "yyyyMMdd"), *percent).alias("value"))
    frame = [(-3, "Daily factors, in percent"), (-2, ""), (-1, ",Mkt-RF,SMB,HML,RF"), (10**6, "Copyright"), (10**6 + 1, "20300101,1,1,1,1")]
    lines = rows.unionByName(spark.createDataFrame(frame, "line_no int, value string"))
    found = filings.factor_table(lines)
    return found.select("trade_date", *[F.round(c, 6).alias(c) for c in ("mkt_rf", "smb", "hml", "rf")])


@query("SRC-09", market.oracle("fundamentals", "SELECT cik::VARCHAR AS cik, period_end, filed_at + 3 AS filed_at, revenue, net_income, shares::DOUBLE AS shares_outstanding FROM fundamentals"))
def src_09(spark, sf_dir):
    """Company facts with a restated value filed a year later, a second tag and a quarterly entry, none of which counts."""
    f = market.fundamentals(spark, sf_dir)
    entry = lambda val, days, form="10-K", fp="FY": F.struct(
        F.date_format("period_end", "yyyy-MM-dd").alias("end"), F.date_format(F.date_add("filed_at", days), "yyyy-MM-dd").alias("filed"),
        val.cast("double").alias("val"), F.lit(form).alias("form"), F.lit(fp).alias("fp"),
    )
    facts = {
        ("Revenues", "USD"): F.flatten(F.collect_list(F.array(entry(F.col("revenue") * 2, 365), entry(F.col("revenue"), 0), entry(F.lit(1.0), -30, "10-Q", "Q3")))),
        ("SalesRevenueNet", "USD"): F.collect_list(entry(F.lit(7.0), 0)),
        ("NetIncomeLoss", "USD"): F.collect_list(entry(F.col("net_income"), 3)),
        ("CommonStockSharesOutstanding", "shares"): F.collect_list(entry(F.col("shares"), 0)),
    }
    tags = F.create_map(*[x for (tag, unit), es in facts.items() for x in (F.lit(tag), F.struct(F.create_map(F.lit(unit), es).alias("units")))])
    raw = f.groupBy(F.col("cik").cast("string").alias("cik")).agg(F.to_json(F.struct(F.struct(tags.alias("us-gaap")).alias("facts"))).alias("json"))
    return filings.company_facts(raw).select("cik", "period_end", "filed_at", "revenue", "net_income", "shares_outstanding")


_SYMBOL = "regexp_replace(c_name, 'Customer#0+', 'C') || CASE c_mktsegment WHEN 'FURNITURE' THEN 'W' WHEN 'MACHINERY' THEN '-A' ELSE '' END"


@query("SRC-10", f"""
    SELECT DISTINCT ON (c_nationkey) c_nationkey AS cik, symbol FROM (SELECT *, {_SYMBOL} AS symbol FROM customer)
    ORDER BY c_nationkey, regexp_matches(symbol, '[-.^/]') OR (length(symbol) = 5 AND symbol LIKE '%W'), c_acctbal, c_custkey""")
def src_10(spark, sf_dir):
    tail = F.when(F.col("c_mktsegment") == "FURNITURE", "W").when(F.col("c_mktsegment") == "MACHINERY", "-A").otherwise("")
    listed = market.table(spark, sf_dir, "customer").withColumn("symbol", F.concat(F.regexp_replace("c_name", "Customer#0+", "C"), tail))
    listed = listed.withColumn("pos", F.struct("c_acctbal", "c_custkey"))
    return filings.preferred_symbols(listed, "c_nationkey", "symbol", "pos")


@query("SRC-11", market.oracle("prices", "SELECT ticker, trade_date, close, volume::DOUBLE AS volume, round(0.5::DOUBLE, 6) AS adj_factor FROM prices"))
def src_11(spark, sf_dir):
    """Bars melted to a vendor's rows, with days that have no value, and put together again."""
    bars = market.prices(spark, sf_dir).withColumns({"Adj Close": F.col("close") * 0.5, "Volume": F.col("volume").cast("double")})
    named = bars.select("ticker", "trade_date", *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close")], "Adj Close", "Volume")
    long = named.unpivot(["ticker", "trade_date"], list(filings.PRICE_FIELDS), "field", "value")
    empty = long.select("ticker", F.date_add("trade_date", 40_000).alias("trade_date"), "field", F.lit(None).cast("double").alias("value"))
    return filings.price_frame(long.unionByName(empty)).select("ticker", "trade_date", "close", "volume", F.round("adj_factor", 6).alias("adj_factor"))


@query("SRC-12", "SELECT l_partkey AS ticker, l_shipdate::DATE AS split_date, l_discount * 20 AS ratio FROM lineitem WHERE l_discount * 20 > 0")
def src_12(spark, sf_dir):
    lines = market.table(spark, sf_dir, "lineitem")
    return filings.splits(lines.select(F.col("l_partkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("split_date"), (F.col("l_discount") * 20).alias("ratio")))


@query("SRC-15", market.oracle("prices", "SELECT ticker, count(*) AS bars, max(trade_date) AS last_bar FROM prices WHERE trade_date < DATE '1998-01-01' GROUP BY ticker"))
def src_15(spark, sf_dir):
    """A scan with a cut-off day."""
    bars = market.prices(spark, sf_dir).where(F.col("trade_date") < F.lit("1998-01-01").cast("date"))
    return bars.groupBy("ticker").agg(F.count("*").alias("bars"), F.max("trade_date").alias("last_bar"))


@query("SNK-01", """
    SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(s_name, c_name) AS name, coalesce(c_nationkey, s_nationkey) AS nation, greatest(c_acctbal, s_acctbal) AS balance
    FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3""".replace("s_suppkey)", "s_suppkey * 3)", 1))
def snk_01(spark, sf_dir):
    """Customers upserted by suppliers: names are replaced, nations stay, balances keep the larger value."""
    put = lambda name, p, key: market.table(spark, sf_dir, name).select(key.alias("id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_acctbal").alias("balance"))
    return changes.upsert(put("customer", "c", F.col("c_custkey")), put("supplier", "s", F.col("s_suppkey") * 3), ["id"], greatest=("balance",), keep=("nation",))


@query("SNK-02", r"""
    SELECT doc_id, doc_id || ',' || CASE WHEN regexp_matches(coalesce(text, ''), '[,"\n\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END || ',' || coalesce(lang, '') AS line FROM documents""")
def snk_02(spark, sf_dir):
    docs = market.table(spark, sf_dir, "documents")
    return docs.select("doc_id", sinks.csv_line("doc_id", "text", "lang").alias("line"))


@query("SNK-03", """SELECT c_custkey, '{"segment":"' || c_mktsegment || '"' || CASE WHEN c_acctbal < 0 THEN '' ELSE ',"nation":' || c_nationkey END || '}' AS report FROM customer""")
def snk_03(spark, sf_dir):
    """Reports as JSON, where what is not a number is left out."""
    value = F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_nationkey").cast("double"))
    safe = sinks.json_safe(market.table(spark, sf_dir, "customer").withColumn("value", value))
    return safe.select("c_custkey", F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("value").cast("int").alias("nation"))).alias("report"))


@query("SNK-04", "SELECT n_nationkey, '| ' || n_name || ' | ' || n_regionkey || ' | ' || coalesce(k, 0) || ' |' AS line FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def snk_04(spark, sf_dir):
    counts = market.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    nations = market.table(spark, sf_dir, "nation").join(counts, "n_nationkey", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return nations.select("n_nationkey", sinks.markdown_row("n_name", "n_regionkey", "k").alias("line"))


@query("SNK-06", """
    SELECT o_orderkey, CASE WHEN l IS NOT NULL AND o_orderstatus = 'O' THEN 'closed' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN l END AS closed_at
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS l FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def snk_06(spark, sf_dir):
    """Open states are closed by the rows that end them; closed ones do not change."""
    ends = market.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("at"))
    ends = ends.select(F.col("l_orderkey").alias("o_orderkey"), F.lit("closed").alias("status"), F.col("at").alias("closed_at"))
    states = market.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(None).cast("timestamp_ntz").alias("closed_at"))
    is_open = F.col("status") == "O"
    return changes.update_from(states.where(is_open), ends, ["o_orderkey"], ["status", "closed_at"]).unionByName(states.where(~is_open))
