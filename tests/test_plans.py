from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewater.operators.flatten import discover_paths
from tidewater.operators.unify import are_unified, canonical_names
from tidewater.plans.tickets import run_pipeline, summary, write_outcome
from tidewater.sources.synthetic import BLANKS, DUPLICATES, dirty_tickets
from tidewater.sources.tables import TICKET_COLUMNS, read_csv, write_csv
from tidewater.streaming.tickets import clean_stream, write_split


def test_csv_round_trip(spark, tmp_path):
    raw = dirty_tickets(spark, 300)
    write_csv(raw, str(tmp_path / "raw"))
    back = read_csv(spark, str(tmp_path / "raw"))
    assert back.columns == list(TICKET_COLUMNS) and back.count() == 300
    meta = {r[0] for r in back.where("user_metadata IS NOT NULL").select("user_metadata").collect()}
    assert meta <= {r[0] for r in raw.select("user_metadata").collect()} and any('"plan"' in m for m in meta)


def test_synthetic_rates_and_determinism(spark):
    n = 4000
    one = dirty_tickets(spark, n).toPandas()
    two = dirty_tickets(spark, n).repartition(7).toPandas()
    assert len(one) == n and one.isna().all(axis=1).sum() == int(n * BLANKS)
    key = lambda d: sorted(map(tuple, d.fillna("").values.tolist()))
    assert key(one) == key(two)
    assert one["ticket_id"].str.startswith("TCK-2").sum() == int(n * DUPLICATES)
    assert one["ticket_id"].dropna().is_unique
    lost = {"", "NaN", "null", "NULL", "N/A", "NA", "-", "None", "?"}
    assert abs(one["agent_name"].isin(lost).mean() - 0.04) < 0.012
    assert abs(one["resolved_at"].isin(lost).mean() - 0.08) < 0.016


def test_plan_invariants(spark, tmp_path):
    raw = dirty_tickets(spark, 800, seed=7)
    valid, invalid = run_pipeline(spark, raw)
    blank = int(800 * BLANKS)
    assert valid.count() + invalid.count() == 800 - blank
    ids = valid.select("ticket_id").unionByName(invalid.select("ticket_id"))
    assert ids.distinct().count() == 800 - blank
    assert valid.where("cost IS NULL OR response_time_hours IS NULL").count() == 0
    assert len(valid.columns) == 19
    assert 0.08 < invalid.count() / (800 - blank) < 0.25
    write_outcome(valid, invalid, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "clean_tickets")).count() == valid.count()


def test_plan_on_any_partitions(spark):
    raw = dirty_tickets(spark, 400, seed=9)
    results = []
    for parts in (1, 5):
        valid, _ = run_pipeline(spark, raw.repartition(parts))
        results.append(sorted((r["ticket_id"], r["company_name"], round(r["cost"], 6), r["created_at"], round(r["response_time_hours"], 6)) for r in valid.collect()))
    assert results[0] == results[1]


def test_summary(spark):
    from tidewater.operators.contract import TICKETS
    from tidewater.plans.tickets import clean_tickets
    from tidewater.functions.missing import read_missing

    counts, top = summary(clean_tickets(read_missing(dirty_tickets(spark, 200))))
    assert counts.first()["n_rows"] == 199 and top.count() >= 1 and TICKETS.name == "CleanTicket"


def test_stream_matches_batch_stages(spark, tmp_path):
    raw = dirty_tickets(spark, 200, seed=5)
    raw.write.parquet(str(tmp_path / "in"))
    static = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "in"))
    out = clean_stream(stream, discover_paths(static, "user_metadata"), names=canonical_names(static, "company_name"))
    write_split(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    valid, invalid = (spark.read.parquet(str(tmp_path / "out" / x)) for x in ("valid", "invalid"))
    assert valid.count() + invalid.count() == 199
    assert valid.where("cost IS NULL").count() == 0 and invalid.where(F.size("errors") == 0).count() == 0


def test_names_left_may_be_many(spark, monkeypatch):
    import tidewater.plans.queries as module

    names = [chr(k) * 5 for k in (*range(97, 123), *range(945, 965))]  # no two are similar
    tickets = dirty_tickets(spark, 400).where("ticket_id IS NOT NULL")
    place = F.pmod(F.xxhash64("ticket_id"), F.lit(len(names))).cast("int")
    own = tickets.withColumn("company_name", F.element_at(F.array(*map(F.lit, names)), place + 1))
    monkeypatch.setattr(module, "generate_tickets", lambda *_: own)
    assert own.select("company_name").distinct().count() > 40
    assert module.clean_generated_profile(spark, "").first()["names_unified"]


@pytest.mark.parametrize("pairs, good", [([("Acme Tools", "Acme Tools"), ("ACME TOOLS", "Acme Tools"), ("-", "-"), (None, None)], True), ([("Acme Tools", "Zebra")], False), ([("Acme Tools", "Acme Tools"), ("ACME TOOLS", "ACME TOOLS")], False), ([("Acme", None)], False)])
def test_unified_names(spark, pairs, good):
    assert are_unified(spark.createDataFrame(pairs, "given string, name string")) == good
