import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgate.llm import quantiles, topn

SCHEMA = "file_path string, fact_id long, complexity int, line_number int, extra string"


def brute(data, n=5):
    out = []
    for path in {r[0] for r in data if r[0]}:
        items = sorted({(-r[2], r[3] is None, r[3] or 0, r[1]) for r in data if r[0] == path and r[2] is not None})
        out += [(path, i[3], k + 1) for k, i in enumerate(items[:n])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_n_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    data = [(rnd.choice(["hot"] * 6 + ["a", "b", "", None]), i, rnd.choice([None, 0, 1, 1, 5, 40, 4000]), rnd.choice([None, 1, 2]), "x") for i in range(600)]
    data += data[:100]
    got = topn.most_complex_facts(spark.createDataFrame(data, SCHEMA)).select("file_path", "fact_id", "rank")
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_top_n_thresholds_drop_nothing_that_counts(spark):
    data = [("hot", i, i % 7, 1, "x") for i in range(3000)] + [("tied", i, 3, 1, "x") for i in range(50)]
    df = spark.createDataFrame(data, SCHEMA)
    got = topn.top_n(df, ["file_path"], "complexity", [F.col("line_number"), F.col("fact_id")], 5, large_share=0.001)
    assert sorted(map(tuple, got.select("file_path", "fact_id", "rank").collect())) == brute(data)


def test_infinite_scores_are_items(spark):
    inf = float("inf")
    data = [("a", inf, 1), ("a", -inf, 2), ("a", 1e308, 3), ("a", float("nan"), 4), ("a", None, 5), ("a", -1e308, 6), ("b", -inf, 7), *[("a", float(i), 10 + i) for i in range(40)]]
    df = spark.createDataFrame(data, "g string, s double, id long")
    for n, share in ((1, 0.0005), (3, 0.0005), (3, 0.99), (46, 0.99)):
        got = topn.top_n(df, ["g"], "s", [F.col("id")], n, large_share=share)
        want = sorted((g, r[1]) for g in "ab" for r in sorted((-s, i) for h, s, i in data if h == g and s is not None and s == s)[:n])
        assert sorted((r.g, r.id) for r in got.collect()) == want


def test_top_n_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topn.most_complex_facts(empty).count() == 0
    assert topn.top_n(empty, ["file_path"], "complexity", [], 0).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(empty.withColumn("rank", F.lit(1)), ["file_path"], "complexity", [], 1)
    values = [-5000, -40, -1, 0, 1, 31, 32, 33, 1000, 10**9]
    bins = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(topn.score_bin(F.col("v"))).collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("shape", ["uniform", "skewed", "constant", "ascending"])
def test_summary_errors_stay_in_their_bound(shape):
    rng = np.random.default_rng(5)
    data = {"uniform": rng.random(30_000), "skewed": rng.pareto(1.2, 30_000), "constant": np.ones(30_000), "ascending": np.arange(30_000.0)}[shape]
    parts = []
    for chunk in np.array_split(data, 7):
        s = quantiles.Summary(64)
        for piece in np.array_split(chunk, 5):
            s.add(piece)
        parts.append(s.rows())
    whole = quantiles.Summary(64)
    for rows in parts:
        offsets = np.cumsum([0, *[len(x) for _, x, _ in rows]])
        whole.take(np.array([y for y, *_ in rows]), offsets, np.concatenate([x for _, x, _ in rows]), np.array([e for *_, e in rows]))
    v = np.concatenate([np.asarray(x) for _, x, _ in whole.rows()])
    w = np.concatenate([np.full(len(x), y) for y, x, _ in whole.rows()])
    assert w.sum() == len(data)
    order = np.argsort(v, kind="stable")
    v, upto = v[order], np.cumsum(w[order])
    bound, ranked = whole.err + max(w), np.sort(data)
    assert bound < 0.12 * len(data)
    for q in (0.01, 0.5, 0.9, 0.99):
        x = v[np.searchsorted(upto, np.ceil(q * len(data)))]
        low, high = np.searchsorted(ranked, x, "left"), np.searchsorted(ranked, x, "right")
        assert low - bound <= q * len(data) <= high + bound


def test_language_percentiles(spark):
    schema = "fact_id long, language string, file_path string, complexity int, param_count int, scanned_at timestamp"
    from datetime import datetime as d

    data = [(i, [" Go", "go", "GO "][i % 3], "a", i % 100, None, d(2025, 1, 1 + i % 9)) for i in range(5000)] + [(9000, None, None, 7, 1, None), (9000, None, None, 7, 1, None), (9001, "", "", None, 3, d(2025, 1, 1))]
    got = {(r.language, r.metric): r for r in quantiles.language_percentiles(spark.createDataFrame(data, schema), k=128).collect()}
    assert set(got) == {("go", "complexity"), ("unknown", "complexity"), ("unknown", "param_count")}
    go = got["go", "complexity"]
    assert go.n == 5000 and abs(go.p50 - 49.5) * 50 <= go.rank_error + 50 and abs(go.p99 - 98.5) * 50 <= go.rank_error + 50
    assert (got["unknown", "param_count"].n, got["unknown", "param_count"].p50) == (2, 1.0) and got["unknown", "complexity"].n == 1
    assert quantiles.language_percentiles(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_collapsing_in_sorted_batches(size):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = [("a", None, 5), ("a", 1, 700), ("b", 2, 1), (None, None, 63), (None, 3, 64), ("z", 1, 130)]
    columns = {"x": [], "y": [], "weight": [], "vals": [], "err": []}
    want = {}
    for x, y, n in rows:
        values = rng.integers(0, 1000, n).astype(float)
        want[x, y] = values
        for v in values:
            for name, cell in zip(columns, (x, y, 1, [v], 0.0)):
                columns[name].append(cell)
    types = {"x": pa.string(), "y": pa.int32(), "weight": pa.int64(), "vals": pa.list_(pa.float64()), "err": pa.float64()}
    batch = pa.record_batch([pa.array(columns[c], t) for c, t in types.items()], names=list(types))
    pieces = [batch.slice(i, size) for i in range(0, batch.num_rows, size)]
    got = {}
    for out in quantiles._collapsed(iter(pieces), ["x", "y"], 64):
        for r in out.to_pylist():
            got.setdefault((r["x"], r["y"]), []).append(r)
    assert set(got) == set(want)
    for key, values in want.items():
        assert sum(r["weight"] * len(r["vals"]) for r in got[key]) == len(values)
        if len(values) < 64:
            assert sorted(got[key][0]["vals"]) == sorted(values) and got[key][0]["err"] == 0


def test_file_percentiles_are_exact_for_small_groups(spark):
    from datetime import datetime as d

    rnd = random.Random(3)
    schema = "fact_id long, language string, file_path string, complexity int, param_count int, scanned_at timestamp"
    data = [(i, rnd.choice(["go", "Go ", None]), rnd.choice(["hot"] * 8 + [f"f{j}" for j in range(20)] + [None, ""]), rnd.randrange(50), rnd.choice([None, 1, 2]), d(2025, 1, 1 + i % 28)) for i in range(900)]
    got = {(r.language, r.file_path, r.metric): r for r in quantiles.file_percentiles(spark.createDataFrame(data, schema)).collect()}
    groups = {}
    for _, lang, path, cx, pc, _ in data:
        for metric, v in (("complexity", cx), ("param_count", pc)):
            if v is not None:
                groups.setdefault(((lang or "unknown").strip().lower(), path, metric), []).append(v)
    assert set(got) == set(groups)
    for key, values in groups.items():
        values.sort()
        r = got[key]
        assert (r.n, r.rank_error) == (len(values), 0)
        for q, p in ((0.5, r.p50), (0.9, r.p90), (0.95, r.p95), (0.99, r.p99)):
            assert p == values[max(1, -int(-(q * len(values) - 1e-9) // 1)) - 1]
