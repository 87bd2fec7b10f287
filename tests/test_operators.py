"""Missing values, large counts, skew, retries and texts as models write them."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import exprs as X
from tandem.operators import inference as I
from tandem.operators import joins as J
from tandem.operators import predict as P
from tandem.operators import ranking as R
from tandem.sources import readers as RD
from tandem.sources import sinks as SK
from tandem.streaming import ingest as ST


def one(df):
    return df.collect()[0]


def brute_interval(rows, reps, seed, shares=(0.025, 0.975)):
    """rows (cluster, num, den) -> estimate and quantiles of the weighted ratios."""
    clusters = list(dict.fromkeys(c for c, _, _ in rows))
    w = dict(zip(clusters, I.poisson_weights(seed, clusters, reps), strict=True))
    num, den = sum(w[c] * n for c, n, _ in rows), sum(w[c] * d for c, _, d in rows)
    v = (num / np.where(den == 0, np.nan, den))[den != 0]
    return sum(n for _, n, _ in rows) / sum(d for _, _, d in rows), *np.quantile(v, shares)


def test_intervals_with_null_groups_and_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(None if g == 2 else f"g{g}", None if c == 4 else f"c{c}", float(x)) for g, c, x in zip(rng.integers(0, 3, 200), rng.integers(0, 9, 200), rng.normal(size=200), strict=True)]
    df = spark.createDataFrame(rows, "g string, c string, x double")
    got = {r.g: r for r in I.bootstrap_ci(df, ["g"], "c", F.col("x"), F.lit(1), 100, 7).collect()}
    low = {r.g: r for r in I.one_sided_lcb(df, ["g"], "c", F.col("x"), F.lit(1), 100, 7).collect()}
    multi = {r.g: r for r in I.bootstrap_multi(df, ["g"], "c", {"m": (F.col("x"), F.lit(1))}, 100, 7).collect()}
    diff = {r.g: r for r in I.bootstrap_difference(df.withColumn("s", (F.col("x") > 0).cast("int")), ["g"], "s", "c", F.col("x"), F.lit(1), 100, 7).collect()}
    assert set(got) == set(low) == set(multi) == set(diff) == {None, "g0", "g1"}
    for g, r in got.items():
        own = [(c, x, 1) for k, c, x in rows if k == g]
        want = brute_interval(own, 100, 7)
        assert (r.estimate, r.ci_lower, r.ci_upper) == pytest.approx(want) and (r.n, r.clusters) == (len(own), len({c for c, _, _ in own}))
        assert (multi[g].estimate, multi[g].ci_lower, multi[g].ci_upper) == pytest.approx(want)
        assert low[g].lcb == pytest.approx(brute_interval(own, 100, 7, (0.05,))[1])
        assert diff[g].estimate == pytest.approx(np.mean([x for _, x, _ in own if x > 0]) - np.mean([x for _, x, _ in own if x <= 0]))


def test_vectors_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(I, "VECTOR_BYTES", 1000)
    df = spark.range(3000).select((F.col("id") % 40).alias("g"), (F.col("id") % 97).alias("c"), F.col("id").cast("double").alias("x"))
    got = {r.g: r for r in I.bootstrap_ci(df, ["g"], "c", F.col("x"), F.lit(1), 30, 1).collect()}
    assert len(got) == 40
    for g in (0, 17):
        want = brute_interval([(str(i % 97), float(i), 1) for i in range(3000) if i % 40 == g], 30, 1)
        assert (got[g].estimate, got[g].ci_lower, got[g].ci_upper) == pytest.approx(want)


def test_curves_and_correlations_of_the_null_group(spark):
    rows = [(None if i % 2 else "a", i, float(i % 7), i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, unit_id long, s double, y boolean").withColumn("y", F.col("y").cast("int"))
    assert {r.g for r in R.model_risk_coverage(df, ["g"], "s", "y", [0.5]).collect()} == {None, "a"}
    rho = {r.g: r for r in R.spearman(df, ["g"], "s", "y").collect()}
    assert set(rho) == {None, "a"} and rho[None].n == 30


def brute_floor(c, t, p, hit):
    pmf = lambda n: [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    a, b = pmf(c), pmf(t)
    return sum(a[i] * b[j] for i in range(c + 1) for j in range(t + 1) if hit(j / t - i / c))


def test_floors_equal_all_pairs_of_outcomes(spark):
    cells = [(c, t, p) for c in (1, 2, 3, 7, 20) for t in (1, 4, 9, 16) for p in (0.0, 0.2, 1 / 3, 0.5, 1.0)]
    rows = R.null_floors(spark.createDataFrame(cells, "c int, t int, p double"), {"floor": (0.0, True), "severe": (-0.5, False)}).collect()
    assert len(rows) == len(cells)
    for r in rows:
        assert r.floor == pytest.approx(brute_floor(r.c, r.t, r.p, lambda d: d < -1e-12), abs=1e-9)
        assert r.severe == pytest.approx(brute_floor(r.c, r.t, r.p, lambda d: d <= -0.5 + 1e-12), abs=1e-9)


def test_floors_of_a_hundred_thousand_runs(spark):
    r = one(R.null_floor(spark.createDataFrame([(100_000, 100_000, 0.3)], "c int, t int, p double")))
    ties = sum(math.exp(2 * (math.lgamma(100_001) - math.lgamma(k + 1) - math.lgamma(100_001 - k) + k * math.log(0.3) + (100_000 - k) * math.log(0.7))) for k in range(29_000, 31_000))
    assert r.floor == pytest.approx((1 - ties) / 2, abs=1e-6)


def test_tail_risk_with_weights(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), int(t), float(p), float(e), float(w)) for c, t, p, e, w in zip(rng.integers(1, 6, 80), rng.integers(1, 6, 80), rng.choice([0.1, 0.5, 0.9], 80), rng.choice([-1, -0.5, -0.2, 0, 0.4], 80), rng.random(80), strict=True)]
    r = one(R.tail_risk(spark.createDataFrame(rows, "c int, t int, p double, effect double, w double"), []))
    mean = lambda f: sum(x[4] * f(*x[:4]) for x in rows) / sum(x[4] for x in rows)
    harm, floor = mean(lambda c, t, p, e: e < 0), mean(lambda c, t, p, e: brute_floor(c, t, p, lambda d: d < -1e-12))
    severe, bottom = mean(lambda c, t, p, e: e <= -0.5), mean(lambda c, t, p, e: brute_floor(c, t, p, lambda d: d <= -0.5 + 1e-12))
    assert (r.share_negative, r.null_floor, r.excess) == pytest.approx((harm, floor, max(0, harm - floor)))
    assert (r.share_severe, r.severe_floor, r.severe_excess) == pytest.approx((severe, bottom, max(0, severe - bottom)))


@pytest.mark.parametrize("accuracy", [10, 100, 2000])
def test_quantiles_by_narrowing(spark, accuracy):
    rng = np.random.default_rng(6)
    values = {None: rng.normal(size=4001), "ties": rng.integers(0, 5, 3000).astype(float), "two": np.array([1.0, 2.0]), "one": np.array([7.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs], "g string, x double").repartition(6)
    wanted = {f"q{i}": ("cont" if i % 2 else "disc", s) for i, s in enumerate([0.0, 0.0, 0.01, 0.25, 0.5, 0.5, 0.95, 0.999, 1.0, 1.0])}
    got = {r.g: r for r in R.order_statistics(df, ["g"], "x", accuracy, **wanted).collect()}
    for g, xs in values.items():
        for name, (kind, share) in wanted.items():
            want = np.quantile(xs, share) if kind == "cont" else np.sort(xs)[max(1, math.ceil(len(xs) * share - 1e-9)) - 1]
            assert got[g][name] == pytest.approx(want), (g, name)


def test_standardised_by_other_folds_at_a_large_mean(spark):
    rng = np.random.default_rng(8)
    x, fold = 1e9 + rng.normal(0, 1e-1, 500), rng.integers(0, 4, 500)
    df = spark.createDataFrame([(i, None if f == 3 else int(f), float(v)) for i, (f, v) in enumerate(zip(fold, x, strict=True))], "i int, f int, x double")
    for r in P.standardize(df, "f", ["x"], 4).collect():
        other = x[fold != fold[r.i]]
        assert r.x_z == pytest.approx((x[r.i] - other.mean()) / other.std(), rel=1e-4, abs=1e-4)
    assert one(P.standardize(df.where("f = 1").limit(1), "f", ["x"], 4)).x_z is None


def test_fits_are_the_same_at_a_large_mean(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-x))).astype(int)
    fits = []
    for shift in (0.0, 1e8):
        df = spark.createDataFrame([("k", int(v), 1 - int(v), float(a + shift), [True]) for a, v in zip(x, y, strict=True)], "_key string, _pos long, _neg long, a double, _masks array<boolean>")
        fits.append(I.masked_logistic_fits(df, ["a"], [("k", 0, ["a"])])[0])
    assert fits[0]["b"] == pytest.approx(fits[1]["b"], rel=1e-5) and fits[1]["m"][0] == pytest.approx(1e8 + x.mean())


def test_rows_of_the_fits_do_not_grow_with_splits(spark, monkeypatch):
    written = []
    monkeypatch.setattr(P, "cut", lambda df, cut=P.cut: (out := cut(df), written.append((set(out.columns), out.count())))[0])
    rng = np.random.default_rng(1)
    units = spark.createDataFrame([(i, f"c{i % 20}", float(e), 1.0, float(i % 5)) for i, e in enumerate(rng.normal(size=60))], "unit_id long, cluster_id string, effect double, w double, f double")
    pairs = spark.createDataFrame([(i % 60, f"c{i % 20}", int(rng.random() < 0.4), int(rng.random() < 0.4), float(i % 5)) for i in range(600)], "unit_id long, cluster_id string, danger int, benefit int, f double")
    for splits in (2, 6):
        P.nested_policy_selection(pairs, units, {"fixed": (F.lit(0), F.col("f"))}, {"M": ["f"]}, splits, 2, (0.1,))
    counts = [n for columns, n in written if "_pos" in columns]
    assert len(counts) == 2 and counts[0] == counts[1] <= 2 * 60


def test_white_space_of_any_kind(spark):
    rows = [("true\n", "42\n", "42"), ("\tYES\r\n", "\t42", "42"), (" 1　", " 4,2 \n", "42\r\n")]
    df = spark.createDataFrame(rows, "b string, a string, truth string")
    assert [tuple(r) for r in df.select(X.as_bool("b"), X.parse_bool_strict("b"), X.grade_exact("a", "truth"), X.normalize_answer("a")).collect()] == [(True, True, "string_match", "42")] * 3
    n = spark.createDataFrame([("\n7.5\t",), ("\n",), (" -3\r\n",)], "a string")
    assert [tuple(r) for r in n.select(X.as_float("a"), X.as_int("a", 0)).collect()] == [(7.5, 7), (None, 0), (-3.0, -3)]


def test_balanced_answers(spark):
    cases = {
        r"\boxed{a{b}c}": "a{b}c", r"x \boxed{1} \boxed{\frac{1}{2}} y}}": r"\frac{1}{2}", r"\boxed{}": "", r"\boxed{{}}": "{}", r"\boxed{open {x}": None, "none": None, r"\boxed{é😀{ü}}": "é😀{ü}",
        r"\boxed{" + "{" * 5000 + "x" + "}" * 5001: "{" * 5000 + "x" + "}" * 5000, r"\boxed{" + "{" * 3000: None, "}" + r"\boxed{z}": "z",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "a string")
    plan = df.select(X.extract_answer_balanced("a").alias("got"), "a")
    assert "Python" not in plan._jdf.queryExecution().toString()
    assert {r.a: r.got for r in plan.collect()} == cases | {None: None}


def test_replies_are_unwrapped(spark):
    cases = {
        json.dumps({"continuation": "So.\n\\frac{1}{2} é"}): "So.\n\\frac{1}{2} é", ' {"output": 5, "content": "kept"} ': "kept", '{"n": {"answer": "inner"}}': '{"n": {"answer": "inner"}}', '{"answer": "a", "continuation": "c"}': "c",
        '{"continuation": "One.\\nTwo \\u00e9. Thr': "One.\nTwo é.", '{"continuation":"A \\"quoted\\" end. \\alpha and $x': 'A "quoted" end.', '{"continuation": "no end $x + \\\\sqrt{2': "no end", '{"continuation": "plain tail': "plain tail",
        '{"continuation": "Bad \\q escape.": 1': 'Bad \\q escape.": 1', "{not json}": "{not json}", "plain. $x \\": "plain.", '{"continuation": "\\ud83d\\ude00 yes. no': "😀 yes.", '{"continuation": "x\\\\"}': "x\\",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "a string")
    assert {r.a: r.got for r in df.select("a", X.repair_text("a", unwrap=True).alias("got")).collect()} == cases | {None: None}


def test_shards_keep_every_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": null, "v": 1}\n\n{"id": 2, "v": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"v": 3}\n')
    rows = RD.read_jsonl_shards(spark, [f"{tmp_path}/*.jsonl", f"{tmp_path}/a.jsonl"], "id BIGINT, v INT").select("id", "v", "shard").distinct().collect()
    assert sorted((r.v, r.id, r.shard) for r in rows) == [(1, None, "a.jsonl"), (2, 2, "a.jsonl"), (3, None, "b.jsonl")]
    (tmp_path / "b.jsonl").write_text('{"v": 3}\n{"v": oops\n')
    with pytest.raises(Exception, match="malformed line"):
        RD.read_jsonl_shards(spark, [f"{tmp_path}/*.jsonl"], "id BIGINT, v INT").select("v").collect()
    kept = RD.read_jsonl_shards(spark, [f"{tmp_path}/*.jsonl"], "id BIGINT, v INT", strict=False)
    assert [r._corrupt_record for r in kept.collect() if r._corrupt_record] == ['{"v": oops'] and kept.count() == 4


def keys(spark, path, schema):
    return sorted((r.k for r in SK.read_sink(spark, path, schema).collect()), key=repr)


def test_appends_are_exactly_once(spark, tmp_path, monkeypatch):
    schema, path = "k int, v int", str(tmp_path / "sink")
    rows = lambda *ks: spark.createDataFrame([(k, v) for v, k in enumerate(ks)], schema)
    assert keys(spark, path, schema) == []
    assert SK.append_pending(rows(1, 2, 2, None, None), path, "k", "a") == 3
    assert SK.append_pending(rows(1, 9), path, "k", "a") == 3  # a retried batch
    add = SK.CommitLog.add
    with monkeypatch.context() as m:
        m.setattr(SK.CommitLog, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            SK.append_pending(rows(3, 4), path, "k", "b")
    assert keys(spark, path, schema) == [1, 2, None]  # files without a record are not read
    other = []

    def raced(log, number, record):
        if not other:  # another writer comes first
            other.append(SK.append_pending(rows(4, None, 5), path, "k", "c"))
        return add(log, number, record)

    with monkeypatch.context() as m:
        m.setattr(SK.CommitLog, "add", lambda log, n, r: raced(log, n, r) if r["batch"] == "b" else add(log, n, r))
        assert SK.append_pending(rows(3, 4), path, "k", "b") == 6
    assert keys(spark, path, schema) == [1, 2, 3, 4, 5, None]
    assert [r["batch"] for r in SK.CommitLog(spark, path).read()] == ["a", "c", "b"]


def test_streams_into_a_sink_survive_a_failed_trigger(spark, tmp_path, monkeypatch):
    src, sink, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    schema = "k STRING, ts TIMESTAMP, v INT"
    (src / "1.json").write_text('{"k": "a", "ts": "2024-01-01T00:00:01Z", "v": 2}\n{"k": "a", "ts": "2024-01-01T00:00:00Z", "v": 1}\n{"v": 5}\n')
    real = SK.append_pending
    monkeypatch.setattr(ST, "append_pending", lambda *a: (real(*a), 1 / 0))  # dies after the commit, before the checkpoint
    with pytest.raises(Exception, match="division"):
        ST.ingest_runs_once(spark, str(src), schema, sink, cp, "k", ["ts"]).awaitTermination()
    monkeypatch.setattr(ST, "append_pending", real)
    (src / "2.json").write_text('{"k": "a", "ts": "2023-01-01T00:00:02Z", "v": 3}\n{"k": "b", "ts": "2024-01-01T00:00:03Z", "v": 4}\n')
    ST.ingest_runs_once(spark, str(src), schema, sink, cp, "k", ["ts"]).awaitTermination()
    assert sorted((r.k or "", r.v) for r in SK.read_sink(spark, sink, schema).collect()) == [("", 5), ("a", 1), ("b", 4)]


def test_triads_of_a_unit_with_many_runs(spark):
    n = 30_000  # 9e8 pairs if they were built
    rows = spark.range(3 * n).select(F.lit(1).alias("unit_id"), F.element_at(F.array(F.lit("control"), F.lit("target_delete"), F.lit("placebo_delete")), (F.col("id") % 3 + 1).cast("int")).alias("condition"), F.floor(F.col("id") / 3).alias("run_id"), (F.col("id") % 2).cast("int").alias("outcome"))
    r = one(J.discordant_triads(rows))
    assert r.target_outcome != r.placebo_outcome and r.direction == ("target_correct" if r.target_outcome else "placebo_correct")


def test_triads_draw_all_pairs_alike(spark):
    # two pairs of one direction, one of the other: each is drawn for a third of the units
    runs = [(u, c, r, y) for u in range(3000) for c, r, y in (("control", 1, 0), ("control", 2, 1), ("target_delete", 1, 1), ("target_delete", 2, 0), ("target_delete", 3, 1), ("placebo_delete", 1, 0), ("placebo_delete", 2, 0), ("placebo_delete", 3, 1))]
    got = {}
    for r in J.discordant_triads(spark.createDataFrame(runs, "unit_id int, condition string, run_id int, outcome int")).collect():
        got[r.target_run, r.placebo_run] = got.get((r.target_run, r.placebo_run), 0) + 1
        assert r.control_outcome == r.target_run - 1
    assert set(got) == {(1, 1), (1, 2), (2, 3)} and all(850 < v < 1150 for v in got.values())  # run 3 has no control


def test_fallback_of_unmatched_and_repeated_texts(spark):
    wanted = spark.createDataFrame([(1, "p", "x", 0), (2, "p", "x", 1), (3, "p", "y", 5), (4, "q", "x", 0), (5, "p", None, 0)], "unit_id int, problem string, text string, declared_index int")
    records = spark.createDataFrame([(7, "p", ["x", "x"]), (3, "p", ["z", "y", "x"]), (9, "p", ["x"])], "record_id int, problem string, steps array<string>")
    got = {r.unit_id: tuple(r)[1:] for r in J.fallback_match(wanted, records).collect()}
    assert got == {1: (7, 0, False), 2: (7, 1, False), 3: (3, 1, True), 4: (None, None, None), 5: (None, None, None)}
    with pytest.raises(Exception, match="unmatched unit"):
        J.fallback_match(wanted, records, strict=True).collect()


def test_probes_need_runs_and_floors_follow_acceptance(spark):
    rows = [(u, c, r, y, f"c{u}") for u, t in ((1, (1, 0, 0, 0)), (2, (0, 0, 0, 0)), (3, (1, 1))) for r in range(1, len(t) + 1) for c, y in (("control", 1), ("target_delete", t[r - 1]))]
    got = {r.policy: r for r in P.probe_and_rollback(spark.createDataFrame(rows, "unit_id int, condition string, run_id int, outcome int, cluster_id string"), {"all": F.lit(True)}, reps=50).collect()}
    floor = brute_floor(3, 3, 0.5, lambda d: d < -1e-12)
    assert got["naive"].candidates == 2 and got["naive"].net == -1.0 and got["naive"].null_floor == pytest.approx(floor) and got["naive"].accept_rate == 1.0
    assert got["rollback"].accept_rate == 0.5 and got["rollback"].net == -0.5 and got["rollback"].null_floor == pytest.approx(floor / 2) and got["rollback"].excess == pytest.approx(0.5 - floor / 2)
