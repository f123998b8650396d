from __future__ import annotations

import json
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions.similarity import Bounds, partial_ratio, prepared, ratio, similarity, token_ratio, weighted_ratio
from tidewater.operators import profile
from tidewater.operators.contract import TICKETS
from tidewater.operators.flatten import discover_paths, flatten_json
from tidewater.operators.impute import impute_by_group, interpolate
from tidewater.operators.unify import unify_names


# -- JSON -------------------------------------------------------------------------------------------------------------


def test_nested_objects_become_columns(spark):
    df = spark.createDataFrame([(1, '{"os": "Linux", "browser": {"name": "Edge", "version": "99"}}')], "id int, user_metadata string")
    out = flatten_json(df)
    assert out.columns == ["id", "user_metadata_browser_name", "user_metadata_browser_version", "user_metadata_os"]
    assert tuple(out.first()) == (1, "Edge", "99", "Linux")


def test_missing_objects_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "null"), (2, ""), (3, None), (4, "{bad"), (5, "[1]"), (6, "{}")], "id int, user_metadata string")
    out = flatten_json(df)
    assert out.columns == ["id"] and out.count() == 6


def test_lists_are_text(spark):
    df = spark.createDataFrame([(1, '{"tags": ["vip", "beta"]}'), (2, '{"tags": []}'), (3, '{"tags": ["x", true, null, 1, 2.5]}')], "id int, user_metadata string")
    assert [r[1] for r in flatten_json(df).orderBy("id").collect()] == ["vip, beta", "", "x, True, None, 1, 2.5"]


def test_types_mixed_kinds_and_collisions(spark):
    rows = [(1, '{"n": 1, "b": true, "m": 1, "a": {"b": 1}, "a_b": 2, "o": {"p": 1}}'), (2, '{"n": 2, "m": "x", "o": "s", "v": null}')]
    df = spark.createDataFrame(rows, "id int, j string")
    out = flatten_json(df, "j", prefix="d")
    kinds = dict(out.dtypes)
    assert (kinds["d_n"], kinds["d_b"], kinds["d_m"], kinds["d_v"]) == ("bigint", "boolean", "string", "string")
    first, second = out.orderBy("id").collect()
    assert first["d_a_b"] == 1 and first["d_o_p"] == 1 and second["d_o"] == "s" and second["d_v"] is None


def test_any_depth_and_any_keys(spark):
    deep = "".join(f'{{"k{i}": ' for i in range(100)) + "7" + "}" * 100
    keys = {"a'\"b": 1, "": 2, "q?": 3, "x.y": 4, "[z]": 5, "tick`": 6, "back\\slash": 7}
    rows = [(1, deep), (2, json.dumps({"o": keys, "e": {}})), (3, json.dumps({"o": {"a'\"b": {"in": [1, "x"]}}}))]
    df = spark.createDataFrame(rows, "id int, j string")
    paths = discover_paths(df, "j")
    assert paths[tuple(f"k{i}" for i in range(100))] == {"BIGINT"}
    assert len(paths) == 1 + len(keys) + 1 and paths["o", "a'\"b", "in"] == {"ARRAY"}
    out = {r["id"]: r.asDict() for r in flatten_json(df, "j", paths=paths).collect()}
    assert out[1]["j_" + "_".join(f"k{i}" for i in range(100))] == 7
    assert [out[2][f"j_o_{k}"] for k in keys] == ["1", 2, 3, 4, 5, 6, 7] or [out[2][f"j_o_{k}"] for k in keys] == [1, 2, 3, 4, 5, 6, 7]
    assert out[3]["j_o_a'\"b_in"] == "1, x"


def test_too_many_paths_raise(spark):
    df = spark.createDataFrame([(json.dumps({f"k{i}": i for i in range(30)}),)], "j string")
    with pytest.raises(ValueError):
        discover_paths(df, "j", max_paths=20)


def test_known_paths_need_no_pass(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": "x"}}')], "id int, j string")
    paths = discover_paths(df, "j")
    assert paths == {("a", "b"): {"STRING"}}
    assert flatten_json(df, "j", paths=paths).first()["j_a_b"] == "x"


# -- imputation -------------------------------------------------------------------------------------------------------


def test_group_mean_and_fallback(spark):
    rows = [("p", "red", 3.0), ("q", "red", None), ("r", "red", 8.0), ("s", "blue", None), ("t", None, None), ("u", None, 40.0), ("v", "green", 1.0), ("w", "green", float("nan"))]
    out = impute_by_group(spark.createDataFrame(rows, "k string, colour string, weight double"), "weight", "colour")
    assert {r["k"]: r["weight"] for r in out.collect()} == {"p": 3.0, "q": 5.5, "r": 8.0, "s": 13.0, "t": 13.0, "u": 40.0, "v": 1.0, "w": 1.0}
    assert out.columns == ["k", "colour", "weight"]


CLASHING = ["__x", "__mean", "__group", "__known", "__range", "__value", "__at", "__before", "__after", "__carried", "__name", "__stripped", "__leader", "__object", "of", "row", "a.b", "n"]


def test_other_columns_may_have_any_names(spark):
    """Operators add columns while they work; none of a table's own may change or clash."""
    rows = [(k, f"name {k // 2}", '{"p": 1}', None if k == 1 else float(k), *[f"{c}{k}" for c in CLASHING]) for k in range(4)]
    df = spark.createDataFrame(rows, ["id", "company", "j", "v", *CLASHING])
    for out in (impute_by_group(df, "v", "company"), interpolate(df, "v", tie="id"), unify_names(df, "company"), flatten_json(df, "j")):
        assert [c for c in out.columns if c in df.columns] == [c for c in df.columns if c in out.columns]
        for r in out.collect():
            assert [r[c] for c in CLASHING] == [f"{c}{r['id']}" for c in CLASHING]
    assert interpolate(df, "v", tie="id").where("id = 1").first()["v"] == 1.0
    assert unify_names(df, "a.b", threshold=101).count() == 4 and impute_by_group(df, "v", "a.b").count() == 4


def test_interpolation_has_no_frame_that_follows(spark):
    """A frame from the current row to the end is summed anew for each row."""
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("v"))
    plan = interpolate(df, "v", tie="id")._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan and "unboundedpreceding$(), currentrow$()" in plan


def test_all_missing_stays_missing(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, c string, v double")
    assert [r["v"] for r in impute_by_group(df, "v", "c").collect()] == [None, None]
    assert [r["v"] for r in interpolate(df, "v", tie="id").collect()] == [None, None]


def test_line_between_neighbours(spark):
    rows = [(1, None), (2, 1.0), (3, None), (4, None), (5, 4.0), (6, None)]
    out = interpolate(spark.createDataFrame(rows, "id int, v double"), "v", tie="id")
    assert [r["v"] for r in out.orderBy("id").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


@pytest.mark.parametrize("known", [0.5, 0.02, 0.0])
@pytest.mark.parametrize("parts", [1, 7])
def test_interpolation_like_pandas_on_any_partitions(spark, known, parts):
    rng = random.Random(3)
    rows = [(i, None if rng.random() < 0.03 else rng.randrange(400), rng.random() if rng.random() < known else None) for i in range(800)]
    out = interpolate(spark.createDataFrame(rows, "id int, at int, v double").repartition(3), "v", sort_by="at", tie="id", partitions=parts).toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "at", "v"]).sort_values(["at", "id"], na_position="last")
    pdf["v"] = pdf["v"].astype(float).interpolate(method="linear", limit_direction="both")
    both = out.merge(pdf, on="id", suffixes=("", "_p"))
    assert len(both) == 800 and ((both["v"] - both["v_p"]).abs().fillna(0) < 1e-9).all() and (both["v"].isna() == both["v_p"].isna()).all()


# -- names ------------------------------------------------------------------------------------------------------------


def test_scores_by_hand():
    assert ratio("abcd", "abed") == 75.0
    assert token_ratio("blue harbor", "harbor blue") == 100.0
    assert partial_ratio("harbor", "old harbor inc") == 100.0
    assert similarity("Blue Harbor", "BLUE HARBOR!") == 100.0
    assert similarity("-", "?") == 0.0
    assert similarity("Blue Harbor", "Blue Harbor Inc.") == pytest.approx(95.0)
    assert similarity("Quanta Hosting", "Zephyr Mail") < 80


def test_variants_share_a_name(spark):
    """The most frequent form leads; what is near enough to it follows, and what isn't leads by itself."""
    forms = {"Tidal Freight": 4, "TIDAL  FREIGHT": 1, "Freight Tidal": 1, "Tidal Freigth plc": 2, "Onyx Payroll": 2, "onyx payrol": 1}
    df = spark.createDataFrame([(n,) for n, many in forms.items() for _ in range(many)], "n string")
    out = {(r["was"], r["n"]) for r in unify_names(df.withColumn("was", F.col("n")), "n").collect()}
    assert out == {(n, "Tidal Freight" if "id" in n.lower() else "Onyx Payroll") for n in forms}


@pytest.mark.parametrize("given, expected", [(None, None), ("", None), (" \t ", None), (" - ", "-"), ("?", "?")])
def test_missing_names_stay_missing(spark, given, expected):
    df = spark.createDataFrame([(given,), ("Opal Robotics",)], "n string")
    assert {r["n"] for r in unify_names(df, "n").collect()} == {expected, "Opal Robotics"}


def test_too_many_names_raise(spark):
    df = spark.createDataFrame([(f"name{k}",) for k in range(12)], "n string")
    with pytest.raises(ValueError):
        unify_names(df, "n", most_names=11)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text("ab c", max_size=12), st.text(max_size=8), st.lists(st.sampled_from(["inc", "blue", "harbor", "x"]), max_size=5).map(" ".join)), min_size=2, max_size=8))
def test_no_score_is_over_its_bound(names):
    texts = [prepared(n) for n in names]
    bounds = Bounds(texts)
    for i, a in enumerate(texts):
        reach = bounds.reach(i, np.arange(len(texts)))
        assert all(weighted_ratio(a, b) <= r for b, r in zip(texts, reach))


def test_greedy_order_on_any_blocks(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(120)]
    counts = pd.Series(names).value_counts()
    order = sorted(counts.index, key=lambda n: (-counts[n], n))
    leader: dict[str, str] = {}
    for n in order:
        if n not in leader:
            leader[n] = n
            for m in order:
                if m not in leader and similarity(n, m) >= 75:
                    leader[m] = n
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    for block in (1000, 13):
        out = {r["i"]: r["n"] for r in unify_names(df, "n", threshold=75, block=block).collect()}
        assert out == {i: leader[n] for i, n in enumerate(names)}


# -- contract and profiles --------------------------------------------------------------------------------------------


@pytest.fixture()
def tickets(spark):
    good = ("T1", "Blue Harbor", "a@b.co", "2024-01-01T00:00:00+00:00", None, "Low", "Open", "Bug Report", "A. B", 5.0)
    rows = [
        good, ("T2", "?", *good[2:]), ("T3", None, "nobody", *good[3:]), (*good[:5], "Urgent", "open", "x", "B", 2e6),
        (*good[:3], None, "bad", "LOW", "Closed", "billing", "A. B", None), (*good[:9], 1e6), (*good[:9], -100000.01),
        (None, *good[1:6], "Lost", *good[7:]), ("", *good[1:6], " open", *good[7:]),
    ]
    schema = "ticket_id string, company_name string, customer_email string, created_at string, resolved_at string, priority string, status string, category string, agent_name string, cost double"
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_split_loses_no_row_and_lists_all_errors(tickets):
    valid, invalid = TICKETS.split(tickets)
    assert valid.count() == 2 and invalid.count() == 7
    found = [[(e["field"], e["type"]) for e in r["errors"]] for r in invalid.collect()]
    assert found == [
        [("company_name", "string_too_short")],
        [("company_name", "string_type"), ("customer_email", "value_error")],
        [("priority", "value_error"), ("category", "value_error"), ("agent_name", "string_too_short"), ("cost", "value_error")],
        [("created_at", "datetime_type"), ("resolved_at", "datetime_from_date_parsing"), ("cost", "float_type")],
        [("cost", "value_error")],
        [("ticket_id", "string_type"), ("status", "value_error")],
        [("ticket_id", "string_too_short"), ("status", "value_error")],
    ]
    first = invalid.collect()[1]["validation_error"].split("\n")
    assert first[0] == "2 validation errors for CleanTicket" and first[1] == "company_name" and first[3] == "customer_email"


def test_profiles_of_errors(tickets):
    _, invalid = TICKETS.split(tickets)
    assert {r["field"]: r["n"] for r in profile.reasons(invalid).collect()} == {"company_name": 2, "customer_email": 1, "priority": 1, "category": 1, "agent_name": 1, "cost": 3, "created_at": 1, "resolved_at": 1, "ticket_id": 2, "status": 2}
    assert tuple(profile.error_count_top(invalid, 1).first()) == ("2 validation errors for CleanTicket", 3)
    assert tuple(profile.outcome(TICKETS.annotate(tickets)).first())[:3] == (9, 2, 7)


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "a"), (4.0, "a"), (100.0, "a"), (None, "b"), (None, None)], "v double, g string")
    assert [tuple(r) for r in profile.null_counts(df).collect()] == [("v", 2), ("g", 1)]
    assert tuple(profile.blank_ratio(df).first())[:2] == (1, 7)
    assert tuple(profile.box_stats(df, "v", "g").first()) == ("a", 1.0, 2.0, 3.0, 4.0, 4.0)
    rng = random.Random(5)
    drawn = pd.DataFrame([(rng.choice("pqr"), rng.choice([1.0, 2.0, rng.random() * 9, rng.random() ** 9 * 400])) for _ in range(700)], columns=["g", "v"])
    boxes = {r["g"]: r for r in profile.box_stats(spark.createDataFrame(drawn).repartition(3), "v", "g").collect()}
    for g, own in drawn.groupby("g")["v"]:
        low, mid, high = (own.quantile(q) for q in (0.25, 0.5, 0.75))
        near = own[(own >= low - 1.5 * (high - low)) & (own <= high + 1.5 * (high - low))]
        assert [boxes[g][c] for c in ("low", "q1", "median", "q3", "high")] == pytest.approx([near.min(), low, mid, high, near.max()])
    assert [tuple(r) for r in profile.value_counts(df, "g").collect()] == [("a", 5), ("b", 1)]
    assert profile.distinct_count(df, "g").first()[0] == 2
    assert {r[0] for r in profile.sample_of(df, "v", 3).collect()} == {r[0] for r in profile.sample_of(df.repartition(5), "v", 3).collect()}
    assert [tuple(r) for r in profile.containing(df, "g", "A").collect()] == [("a",)]
    assert profile.shuffled(df.where("v IS NOT NULL"), "v").count() == 5
