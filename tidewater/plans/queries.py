"""Queries of the cleansing operators over the driver's tables, with the same result as SQL.

Dirt is made from key columns inside a query, so that the SQL can state the clean truth by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.missing import drop_blank_rows, read_missing
from tidewater.functions.temporal import hours_between, iso8601, to_utc, use_utc
from tidewater.functions.text import currency, squeeze, title_case
from tidewater.operators import profile
from tidewater.operators.contract import CATEGORIES, EMAIL, PRIORITIES, STATUSES, TICKETS, Contract, Rule, one_of
from tidewater.operators.flatten import flatten_json
from tidewater.operators.impute import impute_by_group, interpolate
from tidewater.operators.unify import are_unified, unify_names
from tidewater.plans.tickets import run_pipeline
from tidewater.session import shared_folder
from tidewater.sources.synthetic import dirty_tickets, first_repeat, parts_of
from tidewater.sources.tables import TICKET_COLUMNS, read_csv, write_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_choice(key: Column, *options: Column) -> Column:
    return F.element_at(F.array(*options), (F.pmod(key, F.lit(len(options))) + 1).cast("int"))


# -- missing values ---------------------------------------------------------------------------------------------------


def _dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    lost = text_choice(key, *map(F.lit, ("N/A", "null", "NaN", "", "-")))
    dirty = c.select(
        key.cast("string").alias("c_custkey"),
        F.when(key % 7 == 0, lost).otherwise(F.col("c_name")).alias("c_name"),
        F.when(key % 11 == 0, F.lit("None")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return read_missing(dirty.select(*[F.when(F.col("c_custkey").cast("long") % 50 == 0, F.lit("")).otherwise(F.col(n)).alias(n) for n in dirty.columns]))


_CUSTOMERS = """
WITH d AS (
  SELECT CASE WHEN c_custkey % 50 <> 0 THEN c_custkey::VARCHAR END AS c_custkey,
         CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 5 = 4 THEN '-' END ELSE c_name END AS c_name,
         CASE WHEN c_custkey % 50 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer
)
"""


@query(_CUSTOMERS + "SELECT * FROM d WHERE c_custkey IS NOT NULL OR c_name IS NOT NULL OR c_mktsegment IS NOT NULL")
def na_drop_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_blank_rows(_dirty_customers(spark, sf_dir))


@query(
    _CUSTOMERS
    + """SELECT 'c_custkey' AS column_name, count(*) - count(c_custkey) AS nulls FROM d
UNION ALL SELECT 'c_name', count(*) - count(c_name) FROM d UNION ALL SELECT 'c_mktsegment', count(*) - count(c_mktsegment) FROM d"""
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_counts(_dirty_customers(spark, sf_dir))


@query(_CUSTOMERS + "SELECT count(*) FILTER (c_custkey IS NULL AND c_name IS NULL AND c_mktsegment IS NULL) AS blank_rows, count(*) AS n_rows, blank_rows / n_rows AS ratio FROM d")
def blank_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.blank_ratio(_dirty_customers(spark, sf_dir))


@query("SELECT count(*) AS n_rows, 5::INTEGER AS n_columns FROM customer")
def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shape(table(spark, sf_dir, "customer"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_name || ', \"x\"' END AS p_name FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with commas and quotes to CSV and back; missing names are null again."""
    key = F.col("p_partkey").cast("string")
    rows = table(spark, sf_dir, "part").select(key.alias("p_partkey"), F.when(F.col("p_partkey") % 9 != 0, F.concat("p_name", F.lit(', "x"'))).alias("p_name"))
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


@query("SELECT c_name AS value FROM customer ORDER BY md5('42:' || c_name), c_name LIMIT 10")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_of(table(spark, sf_dir, "customer"), "c_name", 10, seed=42)


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY md5('42:' || o_orderkey)")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shuffled(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", seed=42)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


# -- text -------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part")
def strip_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    wide = F.concat(F.lit(" \t"), F.replace(F.col("p_name"), F.lit(" "), text_choice(F.col("p_partkey"), F.lit("  "), F.lit("  "), F.lit("\n　"))), F.lit("  "))
    return p.select("p_partkey", squeeze(wide).alias("p_name"))


@query(
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium'
WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' WHEN '5-LOW' THEN '5-Low' END AS priority FROM orders"""
)
def title_case_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", title_case(F.concat(F.lit(" "), text_choice(F.col("o_orderkey"), F.col("o_orderpriority"), F.lower("o_orderpriority")))).alias("priority"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 20 = 0 THEN -o_totalprice ELSE o_totalprice END, 2) AS amount FROM orders")
def parse_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, english = F.col("o_orderkey"), F.format_number(F.col("o_totalprice"), 2)
    european = F.translate(english, ",.", ".,")
    shown = text_choice(
        key, F.concat(F.lit("$"), english), F.concat(european, F.lit(" €")), F.concat(F.lit("€"), english), F.concat(english, F.lit(" USD")), F.concat(F.lit("US$ "), english)
    )
    return table(spark, sf_dir, "orders").select(key, currency(F.when(key % 20 == 0, F.concat(F.lit("-"), shown)).otherwise(shown)).alias("amount"))


# -- dates ------------------------------------------------------------------------------------------------------------

#: Zones and patterns of the dates that the SQL below takes apart.
_ZONES = ("", " Z", " EST", " CET", " +02:00", " PST")
_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "MM/dd/yyyy hh:mm a", "MMMM dd, yyyy HH:mm", "dd-MMM-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")


@query(
    """WITH t AS (SELECT event_id, date_trunc('minute', ts) AS m FROM events), s AS (
  SELECT event_id, CASE WHEN event_id % 6 = 1 AND day(m) <= 12
    THEN make_timestamp(year(m), day(m), month(m), hour(m), minute(m), 0.0) ELSE m END AS m FROM t
)
SELECT event_id, m - to_minutes(CASE (event_id // 6) % 6 WHEN 2 THEN -300 WHEN 3 THEN 60 WHEN 4 THEN 120 WHEN 5 THEN -480 ELSE 0 END) AS utc FROM s"""
)
def parse_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    shown = F.concat(text_choice(F.col("event_id"), *[F.date_format(minute, p) for p in _PATTERNS]), text_choice(F.floor(F.col("event_id") / 6), *map(F.lit, _ZONES)))
    return e.select("event_id", to_utc(shown).cast("timestamp_ntz").alias("utc"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM orders")
def to_iso8601(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", iso8601(F.col("o_orderdate").cast("timestamp")).alias("iso"))


@query("SELECT l_orderkey, l_linenumber, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9 AS hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def duration_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", hours_between(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")).alias("hours"))


# -- JSON -------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS props_k FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    broken = text_choice(F.floor(F.col("event_id") / 10), *map(F.lit, ("null", "{bad", "", "[1]")))
    return flatten_json(e.select("event_id", F.when(F.col("event_id") % 10 == 0, broken).otherwise(F.col("props")).alias("props")), "props")


@query(
    """SELECT n_nationkey, n_name AS doc_where_name, n_regionkey::BIGINT AS doc_where_region,
CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name || ', True, None, ' || n_regionkey END AS doc_tags FROM nation"""
)
def json_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    items = F.concat(F.lit('["'), "n_name", F.lit('", true, null, '), F.col("n_regionkey").cast("string"), F.lit("]"))
    tags = F.when(F.col("n_nationkey") % 3 == 0, F.lit("[]")).otherwise(items)
    doc = F.concat(F.lit('{"tags": '), tags, F.lit(', "where": {"name": "'), "n_name", F.lit('", "region": '), F.col("n_regionkey").cast("string"), F.lit("}}"))
    return flatten_json(n.select("n_nationkey", doc.alias("doc")), "doc")


# -- imputation -------------------------------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)
SELECT event_id, event_type, round(coalesce(value, CASE WHEN event_type IS NOT NULL THEN avg(value) OVER (PARTITION BY event_type) END, avg(value) OVER ()), 4) AS value FROM d"""
)
def impute_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    dirty = table(spark, sf_dir, "events").select(key, F.when(key % 11 != 0, F.col("event_type")).alias("event_type"), F.when(key % 7 != 0, F.col("value")).alias("value"))
    return impute_by_group(dirty, "value", "event_type").withColumn("value", F.round("value", 4))


@query(
    """WITH d AS (SELECT event_id, ts, CASE WHEN event_id % 5 >= 2 THEN value END AS x, row_number() OVER (ORDER BY ts, event_id) AS p FROM events), k AS (
  SELECT *, last_value(x IGNORE NULLS) OVER b AS x0, last_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0,
         first_value(x IGNORE NULLS) OVER a AS x1, first_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1
  FROM d WINDOW b AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)
SELECT event_id, round(coalesce(x, x0 + (x1 - x0) * (p - p0) / (p1 - p0), x0, x1), 4) AS value FROM k"""
)
def interpolate_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    dirty = table(spark, sf_dir, "events").select(key, "ts", F.when(key % 5 >= 2, F.col("value")).alias("value"))
    return interpolate(dirty, "value", sort_by="ts", tie="event_id").select(key, F.round("value", 4).alias("value"))


# -- names ------------------------------------------------------------------------------------------------------------

_NAMES = ("Harbor Lantern", "Granite Ledger", "Quokka Mobility", "Zephyr Insurance", "Birch Payments")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN CASE c_custkey % 5 WHEN 0 THEN 'Harbor Lantern' WHEN 1 THEN 'Granite Ledger' WHEN 2 THEN 'Quokka Mobility' WHEN 3 THEN 'Zephyr Insurance' ELSE 'Birch Payments' END END AS company FROM customer"
)
def unify_company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    base = text_choice(key, *map(F.lit, _NAMES))
    form = F.pmod(F.floor(key / 5), F.lit(8))
    shown = F.when(form == 0, F.upper(base)).when(form == 1, F.concat(base, F.lit(" Inc."))).when(form == 2, F.concat(F.lit("  "), F.replace(base, F.lit(" "), F.lit("  ")))).otherwise(base)
    return unify_names(table(spark, sf_dir, "customer").select(key, F.when(key % 13 != 0, shown).otherwise(F.lit("  ")).alias("company")), "company")


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "part"), "p_name")


@query("SELECT count(DISTINCT p_name) AS distinct_p_name, count(DISTINCT p_brand) AS distinct_p_brand FROM part")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_count(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query("SELECT DISTINCT p_name AS value FROM part WHERE lower(p_name) LIKE '%a%' AND lower(p_name) LIKE '%e%'")
def names_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.containing(table(spark, sf_dir, "part"), "p_name", "a", "e")


@query(
    """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderpriority, min(o_totalprice) AS low, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, max(o_totalprice) AS high
FROM orders JOIN q USING (o_orderpriority) WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY o_orderpriority"""
)
def boxplot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.box_stats(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


# -- contract ---------------------------------------------------------------------------------------------------------


def _order_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets made of orders, with faults by their keys."""
    key = F.col("o_orderkey")
    fault = lambda n, bad, good: F.when(key % n == 0, bad).otherwise(good)
    return table(spark, sf_dir, "orders").select(
        key,
        fault(41, F.lit(""), F.concat(F.lit("T"), key.cast("string"))).alias("ticket_id"),
        fault(13, F.lit("?"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("company_name"),
        fault(17, F.lit("nobody"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com"))).alias("customer_email"),
        fault(19, F.lit(None), iso8601(F.col("o_orderdate").cast("timestamp"))).alias("created_at"),
        fault(43, F.lit("yesterday"), F.when(key % 3 != 0, iso8601(F.col("o_orderdate").cast("timestamp")))).alias("resolved_at"),
        fault(23, F.lit("Urgent"), F.lit("High")).alias("priority"),
        fault(47, F.lit("Lost"), text_choice(key, *map(F.lit, ("Open", "pending", "RESOLVED", "Closed")))).alias("status"),
        fault(29, F.lit(None), F.lit("Bug Report")).alias("category"),
        fault(31, F.lit("x"), F.lit("A. Agent")).alias("agent_name"),
        fault(37, F.lit(2e6), F.col("o_totalprice")).alias("cost"),
    )


_FAULTS = """
WITH f AS (SELECT o_orderkey, unnest([CASE WHEN o_orderkey % 13 = 0 THEN 'company_name' END, CASE WHEN o_orderkey % 17 = 0 THEN 'customer_email' END,
  CASE WHEN o_orderkey % 19 = 0 THEN 'created_at' END, CASE WHEN o_orderkey % 23 = 0 THEN 'priority' END, CASE WHEN o_orderkey % 29 = 0 THEN 'category' END,
  CASE WHEN o_orderkey % 31 = 0 THEN 'agent_name' END, CASE WHEN o_orderkey % 37 = 0 THEN 'cost' END, CASE WHEN o_orderkey % 41 = 0 THEN 'ticket_id' END,
  CASE WHEN o_orderkey % 43 = 0 THEN 'resolved_at' END, CASE WHEN o_orderkey % 47 = 0 THEN 'status' END]) AS field FROM orders), g AS (
  SELECT o_orderkey, count(field) AS errors FROM f GROUP BY o_orderkey)
"""


@query(_FAULTS + "SELECT o_orderkey, errors = 0 AS valid, errors FROM g")
def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, invalid = TICKETS.split(_order_tickets(spark, sf_dir))
    good = valid.select("o_orderkey", F.lit(True).alias("valid"), F.lit(0).cast("long").alias("errors"))
    return good.unionByName(invalid.select("o_orderkey", F.lit(False).alias("valid"), F.size("errors").cast("long").alias("errors")))


@query(_FAULTS + "SELECT field, count(*) AS n FROM f WHERE field IS NOT NULL GROUP BY field")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.reasons(TICKETS.split(_order_tickets(spark, sf_dir))[1])


@query(
    _FAULTS
    + """SELECT errors || CASE WHEN errors = 1 THEN ' validation error for CleanTicket' ELSE ' validation errors for CleanTicket' END AS first_line, count(*) AS n
FROM g WHERE errors > 0 GROUP BY 1 ORDER BY n DESC, first_line LIMIT 10"""
)
def error_count_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.error_count_top(TICKETS.split(_order_tickets(spark, sf_dir))[1])


@query(_FAULTS + "SELECT count(*) AS n_rows, count(*) FILTER (errors = 0) AS n_valid, count(*) FILTER (errors > 0) AS n_invalid, n_invalid / n_rows AS share_invalid FROM g")
def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.outcome(TICKETS.annotate(_order_tickets(spark, sf_dir)))


@query(
    """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END IS NULL OR o_totalprice > 200000 AS rejected,
round(coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END, avg(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END) OVER (PARTITION BY o_orderpriority)), 2) AS amount FROM orders"""
)
def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency text to numbers, group means, and a range rule on what was given."""
    key = F.col("o_orderkey")
    shown = F.when(key % 9 == 0, F.lit("N/A")).otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    rows = table(spark, sf_dir, "orders").select(key, "o_orderpriority", currency(shown).alias("amount"))
    rule = Contract("Order", (Rule("amount", kind="double", check=lambda c: c <= 200000, message="too much"),))
    return impute_by_group(rows.withColumn("rejected", F.size(rule.errors()) > 0), "amount", "o_orderpriority").withColumn("amount", F.round("amount", 2))


# -- whole plans ------------------------------------------------------------------------------------------------------


def _clean_order_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty ticket text of orders, with JSON metadata and a blank row for every 50th key."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    created = F.date_trunc("minute", F.col("o_orderdate").cast("timestamp"))
    fault = lambda n, bad, good: F.when(key % n == 0, F.lit(bad)).otherwise(good)
    resolved = F.timestamp_seconds(F.unix_seconds(created) + (key % 24 + 1) * 3600)
    meta = F.concat(F.lit('{"os": "Linux", "plan": {"seats": '), F.pmod(key, F.lit(50)).cast("string"), F.lit("}}"))
    columns = {
        "ticket_id": F.concat(F.lit("TCK-"), key.cast("string")),
        "company_name": fault(13, "-", text_choice(key, *map(F.lit, _NAMES))),
        "customer_email": F.concat(F.lit(" c"), F.col("o_custkey").cast("string"), F.lit("@example.com ")),
        "created_at": F.date_format(created, "yyyy-MM-dd HH:mm:ss"),
        "resolved_at": fault(8, "null", F.date_format(resolved, "MMMM dd, yyyy HH:mm")),
        "priority": text_choice(key, F.lit("LOW"), F.lit("high")),
        "status": F.lit("Open"),
        "category": fault(29, "?", F.lit("bug report")),
        "agent_name": F.lit("A.  Agent"),
        "cost": fault(9, "N/A", F.concat(F.lit("$"), F.format_number("o_totalprice", 2))),
        "user_metadata": fault(6, "null", meta),
    }
    return o.select(*[F.when(key % 50 != 0, columns[c]).alias(c) for c in TICKET_COLUMNS])


@query(
    """WITH t AS (SELECT *, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 24 + 1.0::DOUBLE END AS x,
    row_number() OVER (ORDER BY date_trunc('minute', o_orderdate), 'TCK-' || o_orderkey) AS p FROM orders WHERE o_orderkey % 50 <> 0), k AS (
  SELECT *, last_value(x IGNORE NULLS) OVER b AS x0, last_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0,
         first_value(x IGNORE NULLS) OVER a AS x1, first_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1
  FROM t WINDOW b AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), c AS (
  SELECT o_orderkey, o_orderkey % 13 = 0 OR o_orderkey % 29 = 0 AS bad, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 50 END AS seats,
    coalesce(x, x0 + (x1 - x0) * (p - p0) / (p1 - p0), x0, x1) AS hours,
    coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END, avg(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END) OVER (PARTITION BY o_orderkey % 29 = 0)) AS cost FROM k
)
SELECT bad, count(*) AS n, round(sum(cost), 0) AS cost, round(sum(hours), 2) AS hours, count(seats) AS with_seats, sum(seats)::BIGINT AS seats FROM c GROUP BY bad"""
)
def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ticket plan over tickets made of orders, summed up by outcome."""
    valid, invalid = run_pipeline(spark, _clean_order_tickets(spark, sf_dir))
    rows = valid.withColumn("bad", F.lit(False)).unionByName(invalid.drop("errors", "validation_error").withColumn("bad", F.lit(True)))
    return rows.groupBy("bad").agg(
        F.count("*").alias("n"), F.round(F.sum("cost"), 0).alias("cost"), F.round(F.sum("response_time_hours"), 2).alias("hours"),
        F.count("user_metadata_plan_seats").alias("with_seats"), F.sum("user_metadata_plan_seats").alias("seats"),
    )


@query(None)
def generate_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many synthetic dirty tickets as there are orders."""
    use_utc(spark)
    return dirty_tickets(spark, table(spark, sf_dir, "orders").count())


#: Shares in hundredths, of a table of so many rows: each is right if it is nearer than four standard deviations to what is asked for.
_SHARES = {"company_name": 0.04, "priority": 0.04, "category": 0.04, "agent_name": 0.04, "cost": 0.04, "resolved_at": 0.08}


@query(
    """WITH o AS (SELECT count(*) AS n FROM orders)
SELECT n AS n_rows, floor(n * 0.005::DOUBLE) AS blanks, floor(n * 0.03::DOUBLE) AS repeats, n - floor(n * 0.005::DOUBLE) AS ids, 0::BIGINT AS bad_mails,
       0::BIGINT AS bad_metadata, 0::BIGINT AS bad_words, 0::BIGINT AS bad_dates, 0::BIGINT AS bad_costs, true AS shares FROM o"""
)
def generated_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for synthetic tickets: numbers of rows, blank rows, repeats and ids; values that no operator could read; shares missing."""
    many = table(spark, sf_dir, "orders").count()
    t = dirty_tickets(spark, many)
    lost = {c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "nan", "none", "null", "n/a", "na", "-", "?") for c in t.columns}
    given = {c: F.col("ticket_id").isNotNull() & ~lost[c] for c in t.columns}
    words = {"priority": PRIORITIES, "status": STATUSES, "category": CATEGORIES}
    near = F.lit(True)
    for c, share in _SHARES.items():
        n = F.count("ticket_id")
        near = near & (F.abs(F.count_if(F.col("ticket_id").isNotNull() & lost[c]) / n - share) < 4 * F.sqrt(F.lit(share * (1 - share)) / n))
    out = t.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("ticket_id").isNull() & F.col("customer_email").isNull() & F.col("user_metadata").isNull()).cast("double").alias("blanks"),
        F.count_if(F.substring("ticket_id", 5, 20).cast("long") >= first_repeat(parts_of(many)[0])).cast("double").alias("repeats"),
        F.count_distinct("ticket_id").cast("double").alias("ids"),
        F.count_if(given["customer_email"] & ~F.rlike("customer_email", F.lit(EMAIL))).alias("bad_mails"),
        F.count_if(given["user_metadata"] & F.try_parse_json("user_metadata").isNull()).alias("bad_metadata"),
        sum((F.count_if(given[c] & ~F.lower(c).isin(*w)) for c, w in words.items()), F.lit(0)).cast("long").alias("bad_words"),
        sum((F.count_if(given[c] & to_utc(F.col(c)).isNull()) for c in ("created_at", "resolved_at")), F.lit(0)).cast("long").alias("bad_dates"),
        F.count_if(given["cost"] & currency(F.col("cost")).isNull()).alias("bad_costs"),
        near.alias("shares"),
    )
    return out


@query(None)
def clean_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows of the ticket plan over synthetic tickets."""
    return run_pipeline(spark, generate_tickets(spark, sf_dir))[0]


@query(
    """WITH o AS (SELECT count(*) AS n FROM orders)
SELECT n - floor(n * 0.005::DOUBLE)::BIGINT AS n_rows, 0::BIGINT AS unread, 0::BIGINT AS without_hours, 0::BIGINT AS without_cost, true AS names_unified FROM o"""
)
def clean_generated_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for cleansed synthetic tickets: no row but blank ones goes, dates are read, gaps are filled, and names are unified
    as far as they are similar. How many names that leaves grows with the rows, as names spoilt twice may be like no other."""
    tickets = generate_tickets(spark, sf_dir)
    valid, invalid = run_pipeline(spark, tickets)
    rows = valid.unionByName(invalid.drop("errors", "validation_error"))
    given = read_missing(tickets).select("ticket_id", squeeze(F.col("company_name")).alias("given"))
    names = given.join(rows.select("ticket_id", F.col("company_name").alias("name")), "ticket_id").select("given", "name")
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("created_at").isNull()).alias("unread"),
        F.count_if(F.col("response_time_hours").isNull()).alias("without_hours"),
        F.count_if(F.col("cost").isNull()).alias("without_cost"),
        F.lit(are_unified(names)).alias("names_unified"),
    )


@query("SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent FROM orders")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", one_of("1-urgent", "2-high")(F.col("o_orderpriority")).alias("urgent"))
