"""Parsers, joins in time and table checks on small hand-made inputs."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import calendar, text
from tidegauge.operators import changes, joins, lookback
from tidegauge.sources import filings, sinks


def d(s):
    return dt.date.fromisoformat(s)


def test_index_rows(spark):
    lines = spark.createDataFrame(
        [
            ("Form Type   Company Name",),
            ("8-K         ACME, Inc.   320193   20240105   edgar/data/320193/a.txt  ",),
            ("8-K/A       ACME, Inc.   320193   20240105   edgar/data/320193/b.txt",),
            ("8-K         B Corp       0000042   2024-01-06   edgar/data/42/c.txt",),
        ],
        "value string",
    )
    got = [tuple(r) for r in filings.index_rows(lines).orderBy("cik").collect()]
    assert got == [("ACME, Inc.", "320193", d("2024-01-05"), "edgar/data/320193/a.txt"), ("B Corp", "42", d("2024-01-06"), "edgar/data/42/c.txt")]
    with pytest.raises(ValueError):
        filings.index_rows(lines.limit(1))
    assert filings.index_rows(lines.limit(0)).count() == 0


def test_headers_and_submissions(spark):
    header = "<ACCEPTANCE-DATETIME>20240703161500\nACCESSION NUMBER:\t\t0001-24-5\nITEM INFORMATION:\t\tMaterial Impairments\nITEM INFORMATION:\t\t9.01\n"
    raw = "<DOCUMENT><TYPE>EX-99.2\n<SEQUENCE>2\n<TEXT>Later.</TEXT></DOCUMENT><document><type>8-K\n<SEQUENCE>1\n<FILENAME>a.htm\n<text><b>First</b> things.</text></document>"
    row = spark.createDataFrame([(header, raw), (None, None)], "h string, r string").select(
        filings.accession(F.col("h"), F.lit("none")).alias("acc"), filings.item_codes(F.col("h")).alias("items"), filings.accepted_at(F.col("h")).cast("timestamp_ntz").alias("at"),
        filings.best_text(filings.submission_documents(F.col("r"))).alias("b"),
    ).collect()
    assert row[0].acc == "0001-24-5" and row[0]["items"] == ["2.06", "9.01"] and row[0].at == dt.datetime(2024, 7, 3, 20, 15)
    assert row[0].b.text == "First things.\n\nLater." and row[0].b.includes_exhibit
    assert row[1].acc == "none" and row[1].at is None


def test_company_facts_take_the_first_filing(spark):
    e = lambda end, filed, val, form="10-K", fp="FY": {"end": end, "filed": filed, "val": val, "form": form, "fp": fp}
    facts = {"Revenues": {"units": {"USD": [e("2020-12-31", "2022-02-01", 9), e("2020-12-31", "2021-02-01", 5), e("2020-12-31", "2020-11-01", 1, "10-Q", "Q3")]}},
             "SalesRevenueNet": {"units": {"USD": [e("2019-12-31", "2020-02-01", 7)]}}, "Assets": {"units": {"USD": [e("2020-12-31", "2021-03-01", 50)]}}}
    raw = spark.createDataFrame([("1", json.dumps({"cik": 1, "facts": {"us-gaap": facts}})), ("2", "not json"), ("3", None)], "cik string, json string")
    got = filings.company_facts(raw).collect()
    assert [(r.cik, r.period_end, r.filed_at, r.revenue, r.total_assets, r.net_income) for r in got] == [("1", d("2020-12-31"), d("2021-03-01"), 5.0, 50.0, None)]


def test_price_frame_wants_all_fields(spark):
    rows = [("A", d("2024-01-02"), f, 2.0) for f in filings.PRICE_FIELDS] + [("A", d("2024-01-03"), "Open", None)]
    frame = spark.createDataFrame(rows, "ticker string, trade_date date, field string, value double")
    assert [(r.close, r.adj_factor) for r in filings.price_frame(frame).collect()] == [(2.0, 1.0)]
    with pytest.raises(ValueError):
        filings.price_frame(frame.where("field <> 'Volume'"))


def test_as_of_with_nulls_ties_and_repeats(spark):
    left = spark.createDataFrame([(1, "a", d("2024-01-05")), (2, "a", d("2024-01-05")), (2, "a", d("2024-01-05")), (3, None, d("2024-01-05")), (4, "a", None), (5, "b", d("2024-01-01"))], "id int, k string, t date")
    right = spark.createDataFrame([("a", d("2024-01-03"), 1.0), ("a", d("2024-01-04"), None), ("a", d("2024-01-05"), 5.0), ("a", d("2024-01-05"), 6.0), (None, d("2024-01-01"), 9.0)], "k string, t2 date, v double")

    def got(**options):
        found = joins.as_of(left, right, ["k"], "t", "t2", ["v"], **options)
        return sorted([(r.id, r.match.v if r.match else None) for r in found.collect()], key=repr)

    assert got() == [(1, 6.0), (2, 6.0), (2, 6.0), (3, None), (4, None), (5, None)]
    assert got(strict=True) == [(1, 1.0), (2, 1.0), (2, 1.0), (3, None), (4, None), (5, None)]
    assert got(strict=True, null_values=True)[0] == (1, None)
    assert got(forward=True)[0] == (1, 6.0)


def test_newest_before_and_counts(spark):
    rows = spark.createDataFrame([(i, "a", d("2024-01-01") + dt.timedelta(days=i // 2), i) for i in range(8)], "key int, by string, day date, v int")
    got = {r.key: r.before for r in lookback.newest_before(rows, "by", "day", "key", "v", days=2, most=3).collect()}
    assert got[0] == [] and got[2] == [1, 0] and got[7] == [5, 4, 3]
    events = spark.createDataFrame([(1, "a", d("2024-01-02")), (2, "b", d("2024-01-02"))], "event_id int, ticker string, d0 date")
    bars = rows.select(F.col("by").alias("ticker"), F.col("day").alias("trade_date")).distinct()
    found = {r.event_id: (r.near, r.after) for r in lookback.counts_in_ranges(events, bars, {"near": (-1, 0), "after": (1, 9)}).collect()}
    assert found == {1: (2, 2), 2: (0, 0)}


def test_upserts_and_violations(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 9)], "id int, name string, top int")
    new = spark.createDataFrame([(2, "c", 3), (3, "d", 1)], "id int, name string, top int")
    assert {tuple(r) for r in changes.upsert(old, new, ["id"], greatest=("top",)).collect()} == {(1, "a", 5), (2, "c", 9), (3, "d", 1)}
    broken = lookback.violations(old, {"low": F.col("top") < 6, "named": F.col("name") != "a"}, "id", F.col("name"))
    assert {(r.rule, r.key) for r in broken.collect()} == {("low", 2), ("named", 1)}


def test_days_and_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    day = lambda s: F.lit(s).cast("date")
    assert one(calendar.easter_sunday(F.lit(2024))) == d("2024-03-31")
    assert one(calendar.is_session(day("2024-03-29"))) is False and one(calendar.is_session(day("2022-01-03"))) is True
    assert one(calendar.is_session(day("2021-12-31"))) is True  # a New Year's Day on a Saturday is not moved
    assert one(calendar.closes_early(day("2024-11-29"))) is True
    assert one(calendar.last_complete_week(day("2024-07-05"))[1]) == d("2024-06-28")  # a Friday is not over
    assert one(calendar.last_complete_week(day("2024-07-06"))[0]) == d("2024-07-01")
    assert one(text.cut_at_sentence(F.lit("One two. Three four five"), 12)) == "One two."
    assert one(text.cut_at_sentence(F.lit("A. bcdefghijklmnop"), 12)) == "A. bcdefghij"
    assert one(text.json_number(F.lit('{"k": true}'), "$.k", 0, 5)) is None and one(text.json_number(F.lit('{"k": 4.5}'), "$.k", 0, 5)) == 4.5
    frame = spark.createDataFrame([(1, 'a "q", b', float("nan"))], "id int, t string, v double")
    assert one(F.lit(1)) == 1 and frame.select(sinks.csv_line("id", "t").alias("x")).first().x == '1,"a ""q"", b"'
    assert sinks.json_safe(frame).first().v is None


def test_the_factor_query_reads_every_day(spark):
    """No day is left out of what is written and read again."""
    from tidegauge.plans.filings import src_08
    from tidegauge.sources import market

    data = "/root/testdata/sf0.001"
    wanted = {r.trade_date for r in market.factors(spark, data).select("trade_date").collect()}
    got = [r.trade_date for r in src_08(spark, data).select("trade_date").collect()]
    assert len(got) == len(wanted) and set(got) == wanted and min(wanted) < d("1995-07-01")
