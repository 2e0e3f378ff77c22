import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusgate.operators import skew


def plain_profile(data):
    out = {}
    for k, group in itertools.groupby(sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1])), key=lambda r: r[0]):
        values = [v or "" for _, _, v in group]
        runs = [len(list(g)) for _, g in itertools.groupby(values)]
        out[k] = (len(values), len(runs) - 1, max(runs))
    return out


@pytest.mark.parametrize("chunk,fan", [(1, 2), (3, 2), (7, 3), (1000, 50)])
def test_ordered_states_equal_brute_force_when_one_key_holds_most(spark, chunk, fan):
    rnd = random.Random(chunk)
    data = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]), i, rnd.choice(["e", "e", "w", None])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i int, v string").repartition(5)
    numbered = skew.offset_numbers(df, ["k"], ["i"], 4)
    got = {r.k: (r.n, r.changes, r.longest) for r in skew.ordered_states(numbered, ["k"], "v", chunk, fan).collect()}
    assert got == plain_profile(data)


def test_numbers_are_exact_and_gapless(spark):
    data = [("hot", i % 50, i) for i in range(300)] + [("cold", 1, 1000)]
    df = spark.createDataFrame(data, "k string, o int, id int")
    got = {(r.k, r.id): r.seq for r in skew.offset_numbers(df, ["k"], ["o", "id"], 6).collect()}
    want = {(k, i): n for key in ("hot", "cold") for n, (k, o, i) in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2])))}
    assert got == want


def test_taken_column_names_are_refused(spark):
    df = spark.createDataFrame([("a", 1)], "k string, seq int")
    with pytest.raises(ValueError):
        skew.offset_numbers(df, ["k"], ["seq"])


SCHEMA = "violation_id long, rule_id string, file string, severity string, reported_at timestamp_ntz, ingested_at timestamp_ntz, n int"


def test_profiles_count_repeats_once_and_keep_null_keys(spark):
    from datetime import datetime as d

    t = lambda i: d(2025, 1, i)
    data = [
        (1, "r", "f", "error", t(1), t(1), 9), (1, "r", "f", "warn", t(1), t(2), 9), (2, "r", None, "WARNING", t(2), t(2), 9), (3, None, "f", None, t(3), t(3), 9),
        (3, None, "f", None, t(3), t(3), 9), (4, "r", "", "error", t(4), t(4), 9),
    ]
    got = {(r.key_kind, r.key): (r.n, r.others, r.errors, r.warnings, r.unrated, r.changes, r.longest) for r in skew.key_profiles(spark.createDataFrame(data, SCHEMA), 2, 2).collect()}
    assert got == {
        ("rule", "r"): (3, 2, 1, 2, 0, 1, 2), ("rule", None): (1, 1, 0, 0, 1, 0, 1), ("file", "f"): (2, 1, 0, 1, 1, 1, 1), ("file", None): (1, 1, 0, 1, 0, 0, 1),
        ("file", ""): (1, 1, 1, 0, 0, 0, 1),
    }


def test_empty_table_gives_no_rows(spark):
    assert skew.key_profiles(spark.createDataFrame([], SCHEMA)).count() == 0


def test_latest_rows_take_the_last_version(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, None)], "id int, at int, v string")
    assert pytest.rows(skew.latest_rows(df, "id", "at", ["v"])) == [(1, "b"), (2, None)]
    assert skew.latest_rows(df.where(F.lit(False)), "id", "at", ["v"]).count() == 0
