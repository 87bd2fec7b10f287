"""Hand-written edge cases and properties."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import exprs as X
from tandem.operators import aggregates as A
from tandem.operators import audit as C
from tandem.operators import inference as I
from tandem.operators import joins as J
from tandem.operators import predict as P
from tandem.operators import ranking as R
from tandem.operators import sampling as S
from tandem.sources import readers as RD
from tandem.streaming import ingest as ST


def one(df):
    return df.collect()[0]


def runs(spark, rows):
    return spark.createDataFrame(rows, "unit_id long, condition string, run_id long, outcome int, cost double, cluster_id string, status string")


def test_answers(spark):
    cases = {
        r"so \boxed{\frac{1}{2}} holds": "(1)/(2)", "0.50": ".50", "1,000": "1000", "3.0": "3", "-12.00": "-12", "": "", r"\boxed{\sqrt{3}}": "sqrt(3)", r"\sqrt2 \pi": "sqrt(2)pi", r"\infty": "oo",
        r"3 \cdot 4 \times x": "3*4*x", r"90^\circ": "90", r"90^{\circ}": "90", r"\dfrac{a+b}{c}": "(a+b)/(c)", r"\tfrac{1}{2}": r"\frac{1}{2}", r"$5\%$.": "5", r"7\text{ cm}": "7", r"\left(1,\,2\right)": "(12)", "X": "x", "00.5": "00.5",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, want string")
    assert [(r.a, r.got) for r in df.select("a", "want", X.normalize_answer("a").alias("got")).collect() if r.got != cases[r.a]] == []
    g = spark.createDataFrame([(r"\frac{a+b}{c}", "a+b/c"), (r"\frac{a}{b}", r"\dfrac{a}{b}"), (" ", "1"), (None, "1"), ("2.", "2.0")], "a string, b string")
    assert [r[0] for r in g.select(X.grade_exact("a", "b")).collect()] == ["mismatch", "string_match", "no_answer", "no_answer", "string_match"]
    assert one(spark.createDataFrame([(r"x \boxed{a{b}c} y",)], "a string").select(X.extract_answer_balanced("a")))[0] == "a{b}c"


def test_statuses(spark):
    cases = [("Logical-Break", "x", "logical_break"), ("logical break", "x", "logical_break"), ("unable to continue", "x", "cannot_continue"), ("a break", "", "logical_break"), ("Completed.", "", "completed"), ("odd", "x", "completed"), ("odd", " ", "cannot_continue"), (None, None, "cannot_continue")]
    df = spark.createDataFrame(cases, "s string, a string, want string")
    assert [tuple(r) for r in df.select("s", "a", X.normalize_status("s", "a")).collect()] == cases


def test_text_repair(spark):
    cases = {
        "\x0crac{1}{2} and \x08eta, \theta, \x0bec": r"\frac{1}{2} and \beta, \theta, \vec", r"a \/geq b \/neq c": r"a \geq b \neq c", r"x \text{} \text{ }\text{}y": r"x \;y", r"x \text{}\text{}y": r"x \text{}\text{}y",
        "x" + r"\,\, \," * 3 + "y": r"x\,y", "One. Two is $x": "One. Two is $x", "One. Two is $\\frac{1": "One.", "no end, $\\sqrt{2": "no end", "It is \\$5. So $a \\": "It is \\$5.", "Even $x$ \\frac{1": "Even $x$ \\frac{1",
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert [(r.a, r.got) for r in df.select("a", X.repair_text("a").alias("got")).collect() if r.got != cases[r.a]] == []


def test_order_statistics_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x)) for g in (None, "a", "b") for x in rng.integers(0, 40, 97 if g else 50)] + [("c", None), ("d", 5.0)]
    got = {r.g: r for r in R.order_statistics(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", med=("cont", 0.5), q=("cont", 0.3), top=("disc", 0.95)).collect()}
    for g in (None, "a", "b", "d"):
        x = np.sort([v for k, v in rows if k == g and v is not None])
        assert got[g].med == np.quantile(x, 0.5) and got[g].q == pytest.approx(np.quantile(x, 0.3)) and got[g].top == x[int(np.ceil(0.95 * len(x))) - 1]
    assert "c" not in got


def test_null_floor_of_large_counts(spark):
    r = one(R.null_floor(spark.createDataFrame([(21, 21, 0.5), ], "c int, t int, p double")))
    want = sum(math.comb(21, i) * math.comb(21, j) for i in range(22) for j in range(i)) / 2**42
    assert r.floor == pytest.approx(want)
    ends = {(x.c, x.p): x.floor for x in R.null_floor(spark.createDataFrame([(500, 40, 0.3), (4, 4, 0.0), (4, 4, 1.0)], "c int, t int, p double")).collect()}
    assert 0.4 < ends[500, 0.3] < 0.6 and ends[4, 0.0] == 0 and ends[4, 1.0] == 0


def test_folds_fill_the_emptiest(spark):
    for sizes, k in (({1: 100, 7: 3, 50: 1}, 5), ({3: 10}, 4), ({9: 1, 2: 1}, 3), ({}, 2)):
        load = [0] * k
        want = {}
        for s in sorted(sizes, reverse=True):
            for _ in range(sizes[s]):
                f = load.index(min(load))
                load[f] += s
                want[s, f] = want.get((s, f), 0) + 1
        assert {(s, f): b - a + 1 for s, f, a, b in S.fold_shares(sizes, k)} == want


def test_strict_bool_rejects(spark):
    df = spark.createDataFrame([("maybe",)], "a string").select(X.parse_bool_strict("a"))
    with pytest.raises(Exception, match="not a boolean"):
        df.collect()


def test_rates_without_denominator(spark):
    p = J.pair_runs(runs(spark, [(1, "control", 1, 0, 1.0, "c", "completed"), (1, "target_delete", 1, 1, 1.0, "c", "completed"), (2, "control", 1, 1, 1.0, "c", "completed"), (2, "target_delete", 1, 1, 1.0, "c", "completed")]))
    t = {r.unit_id: r for r in A.unit_transitions(p).collect()}
    assert t[1].danger_rate is None and t[1].recovery_rate == 1.0 and t[2].recovery_rate is None and t[2].danger_rate == 0.0


def test_unit_without_placebo(spark):
    e = one(A.unit_effects(runs(spark, [(1, "control", 1, 0, 1.0, "c", "x"), (1, "target_delete", 1, 1, 1.0, "c", "x")])))
    assert e.target_effect == 1.0 and e.placebo_effect is None and e.semantic_effect is None


def test_duplicate_key_is_an_error(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="repeats key"):
        J.unique_inner_join(a, a.select("k").distinct(), ["k"])


def test_agreement_of_identical_and_constant_raters(spark):
    df = spark.createDataFrame([(i, r, v) for i in range(10) for r, v in (("a", i % 2), ("b", i % 2), ("c", 1), ("d", 1))], "item_id int, rater string, label int")
    k = {(r.rater_a, r.rater_b): r for r in A.rater_agreement(A.rater_pairs(df), ["rater_a", "rater_b"], [0, 1]).collect()}
    assert k["a", "b"].kappa == pytest.approx(1.0) and k["c", "d"].kappa is None and k["c", "d"].agreement == 1.0


def test_agreement_from_a_known_confusion(spark):
    # 60 pairs, three labels; kappa and AC1 by hand
    cells = {(0, 0): 12, (0, 1): 5, (0, 2): 3, (1, 0): 4, (1, 1): 15, (1, 2): 2, (2, 0): 3, (2, 1): 6, (2, 2): 10}
    pairs = [("a", "b", x, y) for (x, y), n in cells.items() for _ in range(n)]
    r = one(A.rater_agreement(spark.createDataFrame(pairs, "rater_a string, rater_b string, label_a int, label_b int"), ["rater_a", "rater_b"], [0, 1, 2]))
    n = sum(cells.values())
    po = sum(v for (x, y), v in cells.items() if x == y) / n
    pa = [sum(v for (x, _), v in cells.items() if x == k) / n for k in range(3)]
    pb = [sum(v for (_, y), v in cells.items() if y == k) / n for k in range(3)]
    pe = sum(a * b for a, b in zip(pa, pb, strict=True))
    g = sum((a + b) / 2 * (1 - (a + b) / 2) for a, b in zip(pa, pb, strict=True)) / 2
    assert r.kappa == pytest.approx((po - pe) / (1 - pe)) and r.ac1 == pytest.approx((po - g) / (1 - g))


def test_interval_contains_estimate_and_unit_weights_change_nothing(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(i), f"c{i % 23}", float(x)) for i, x in enumerate(rng.normal(size=300))], "unit_id long, cluster_id string, x double")
    a = one(I.bootstrap_ci(df, [], "cluster_id", F.col("x"), F.lit(1.0), 200))
    b = one(I.bootstrap_ci(df.withColumn("w", F.lit(1.0)), [], "cluster_id", F.col("x") * F.col("w"), F.col("w"), 200))
    assert a.ci_lower <= a.estimate <= a.ci_upper
    assert (a.estimate, a.ci_lower, a.ci_upper) == pytest.approx((b.estimate, b.ci_lower, b.ci_upper))


def test_one_cluster_has_no_bound(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", 0.5)], "cluster_id string, x double")
    assert one(I.one_sided_lcb(df, [], "cluster_id", F.col("x"), F.lit(1.0), 50)).lcb == -1.0
    assert one(I.cluster_robust_lcb(df, [], "cluster_id", F.col("x"), F.lit(1.0))).lcb == -1.0


def test_auc_ties_reversal_and_one_class(spark):
    rows = [("s", i, float(v), y) for i, (v, y) in enumerate([(1, 0), (1, 1), (2, 0), (3, 1), (3, 1), (0, 0)])] + [("t", 9, 1.0, 1)]
    df = spark.createDataFrame(rows, "scorer string, unit_id int, score double, y int")
    a = {r.scorer: r.auroc for r in R.roc_auc(df, ["scorer"]).collect()}
    b = {r.scorer: r.auroc for r in R.roc_auc(df.withColumn("score", -F.col("score")), ["scorer"]).collect()}
    assert a["s"] == pytest.approx(1 - b["s"]) and a["t"] is None
    assert a["s"] == pytest.approx((0.5 + 1 + 3 + 3) / 9)


def test_calibration_edges(spark):
    df = spark.createDataFrame([("m", 1.0, 1), ("m", 0.1, 0), ("m", 0.0, 0)], "model string, p double, y int")
    r = one(R.calibration(df, ["model"], "p", "y"))
    assert r.brier == pytest.approx(0.01 / 3) and r.ece == pytest.approx(0.1 / 3) and r.specificity == 1.0


def test_certified_prefixes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [("p", int(i), f"c{rng.integers(12)}", float(rng.normal()), float(rng.random()), float(rng.random() + 0.5)) for i in range(120)]
    df = spark.createDataFrame(rows, "policy string, unit_id long, cluster_id string, effect double, policy_score double, w double").withColumn("tier", F.lit(0.0))
    got = {r.k: r for r in R.certified_prefixes(df, step=1).collect()}
    ordered = sorted(rows, key=lambda r: -r[4])
    for k in (1, 2, 17, 60, 120):
        part, clusters = ordered[:k], {}
        for r in part:
            a, b = clusters.get(r[2], (0.0, 0.0))
            clusters[r[2]] = (a + r[5] * r[3], b + r[5])
        sa, sb, m = sum(a for a, _ in clusters.values()), sum(b for _, b in clusters.values()), len(clusters)
        t = sa / sb
        lcb = -1.0 if m < 2 else t - 1.645 * np.sqrt(m / (m - 1) * sum((a - t * b) ** 2 for a, b in clusters.values())) / sb
        assert got[k].estimate == pytest.approx(t) and got[k].lcb == pytest.approx(lcb, abs=1e-9) and got[k].clusters == m


def test_length_match_borders(spark):
    t = spark.createDataFrame([(1, ["x" * 10, "y" * 8, "z" * 12, "w" * 13, "v" * 7], 5, 0), (2, ["alone"], 1, 0)], "unit_id long, steps array<string>, n_steps long, target_index long")
    found = J.match_by_length_ratio(t, k=9).collect()
    assert sorted(r.placebo_step_index for r in found) == [1, 2] and {r.unit_id for r in found} == {1}


def test_grouped_folds_balance(spark):
    df = spark.createDataFrame([(f"g{g}",) for g in range(40) for _ in range(g % 7 + 1)], "cluster_id string")
    f = S.grouped_kfold(df, "cluster_id", 5).groupBy("fold").agg(F.sum("group_size").alias("n")).collect()
    assert len(f) == 5 and max(r.n for r in f) - min(r.n for r in f) <= 2


def test_quota_fills_from_leftovers(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b", 1) for i in range(30)], "unit_id long, bin string, ok int")
    r = S.quota_sample(df, "bin", ["a", "b"], 10, "ok").collect()
    assert len(r) == 10 and sum(x.bin == "a" for x in r) == 3 and sum(x.picked_by == "fill" for x in r) == 2


def test_empty_tables(spark):
    none = runs(spark, [])
    assert A.unit_effects(none).count() == 0 and J.pair_runs(none).count() == 0
    assert R.roc_auc(spark.createDataFrame([], "scorer string, unit_id int, score double, y int"), ["scorer"]).count() == 0
    assert one(C.expect(none, [("rows", "n", 0)])).status == "PASS"


def test_csv_with_mark_quotes_and_line_feeds(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿id,text\r\n1,\"two\nlines \"\"quoted\"\"\"\r\n2,\r\n".encode())
    rows = RD.read_csv_strings(spark, str(path)).collect()
    assert rows[0].asDict() == {"id": "1", "text": 'two\nlines "quoted"'} and rows[1].text is None


def test_json_lines_blank_and_malformed(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1}\n\n{"id": 2}\n')
    assert RD.read_jsonl(spark, str(path), "id BIGINT").count() == 2
    path.write_text('{"id": 1}\n{"id": oops\n')
    with pytest.raises(Exception, match="malformed line"):
        RD.read_jsonl(spark, str(path), "id BIGINT").collect()


def test_keyed_documents_reject_duplicates(spark):
    docs = spark.createDataFrame([(json.dumps({"metadata": {"n": 1}, "annotations": {"a": {"x": 1}}}),)] * 2, "text string")
    assert one(RD.summed_metadata(docs, "text")).n == 2
    with pytest.raises(Exception, match="duplicate id"):
        RD.keyed_documents(docs, "text", "x: INT").collect()


def test_stream_keeps_first_and_resumes(spark, tmp_path):
    src, sink, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    schema = "task STRING, ts TIMESTAMP, v INT"
    (src / "1.json").write_text('{"task": "a", "ts": "2024-01-01T00:00:00Z", "v": 1}\n{"task": "a", "ts": "2024-01-01T00:00:01Z", "v": 2}\n')
    ST.ingest_runs_stream(spark, str(src), schema, sink, cp, "task", "ts").awaitTermination()
    (src / "2.json").write_text('{"task": "a", "ts": "2024-01-01T00:00:02Z", "v": 3}\n{"task": "b", "ts": "2024-01-01T00:00:03Z", "v": 4}\n')
    ST.ingest_runs_stream(spark, str(src), schema, sink, cp, "task", "ts").awaitTermination()
    rows = spark.read.parquet(sink).collect()
    assert sorted(r.task for r in rows) == ["a", "b"]


def test_verdict_before_generation(spark, tmp_path):
    g, v = tmp_path / "g", tmp_path / "v"
    g.mkdir(), v.mkdir()
    (v / "1.json").write_text('{"task": "a", "vt": "2024-01-01T00:00:00Z", "correct": true}\n')
    (g / "1.json").write_text('{"task": "a", "ts": "2024-01-01T01:00:00Z", "answer": "x"}\n')
    gs = spark.readStream.schema("task STRING, ts TIMESTAMP, answer STRING").json(str(g))
    vs = spark.readStream.schema("task STRING, vt TIMESTAMP, correct BOOLEAN").json(str(v))
    out = str(tmp_path / "out")
    ST.verdict_join_streams(gs, vs, "task", "answer", "ts", "vt").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(out)
    assert [(r.task, r.verdict) for r in out.collect()] == [("a", True)]


def newton(x, y, l2=1.0, balanced=True):
    """Independent fit: intercept and slopes by plain Newton steps."""
    x, y = np.column_stack([np.ones(len(x)), x]), np.asarray(y, float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    b, ridge = np.zeros(x.shape[1]), l2 * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (w * (y - p)) - ridge @ b)
    return b


def scaled(x, by):
    sd = by.std(0)
    return (x - by.mean(0)) / np.where(sd <= 1e-6, 1, sd)


def test_out_of_fold_predictions_equal_single_fits(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(3, 2, 240), rng.integers(0, 2, 240), np.full(240, 7.0)])
    y = (rng.random(240) < 1 / (1 + np.exp(-(x[:, 0] - 3 + x[:, 1])))).astype(int)
    fold, task = rng.integers(0, 3, 240), rng.integers(0, 2, 240)
    df = spark.createDataFrame([(i, f"t{task[i]}", int(fold[i]), int(y[i]), *map(float, x[i])) for i in range(240)], "unit_id int, task string, fold int, y int, a double, b double, c double")
    models = {"one": ["a"], "all": ["a", "b", "c"]}
    got = {(r.model, r.unit_id): r.p for r in P.cross_validated_predictions(df, ["task"], "y", models, "fold", 3).collect()}
    assert len(got) == 480
    for name, cols in models.items():
        at = ["abc".index(c) for c in cols]
        for t in (0, 1):
            for f in range(3):
                learn, held = (task == t) & (fold != f), np.flatnonzero((task == t) & (fold == f))
                b = newton(scaled(x[learn][:, at], x[learn][:, at]), y[learn])
                p = 1 / (1 + np.exp(-(b[0] + scaled(x[held][:, at], x[learn][:, at]) @ b[1:])))
                assert np.allclose([got[name, i] for i in held], p, atol=1e-6)


def test_nested_policies_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    n, splits, inner = 160, 3, 2
    f, cluster = rng.normal(0, 1, n), rng.integers(0, 40, n)
    effect, w = np.round(f * 0.3 + rng.normal(0, 0.2, n), 3), rng.choice([0.5, 1.0, 2.0], n)
    units = spark.createDataFrame([(i, f"c{cluster[i]}", float(effect[i]), float(w[i]), float(f[i])) for i in range(n)], "unit_id long, cluster_id string, effect double, w double, f double")
    runs_ = [(i, f"c{cluster[i]}", int(rng.random() < 0.5 - effect[i] / 2), int(rng.random() < 0.5 + effect[i] / 2), float(f[i])) for i in range(n) for _ in range(3)]
    pairs = spark.createDataFrame(runs_, "unit_id long, cluster_id string, danger int, benefit int, f double")
    got = {(r.regime, r.policy, r.budget): r for r in P.nested_policy_selection(pairs, units, {"fixed": (F.lit(0), F.col("f"))}, {"M": ["f"]}, splits, inner, (0.02, 0.3)).collect()}
    deal = {(r.cluster_id, r.s): (r.cal, r.own) for r in units.select("cluster_id").distinct().crossJoin(spark.range(splits).select(F.col("id").cast("int").alias("s"))).select("cluster_id", "s", (F.expr("pmod(xxhash64(cluster_id, s, 20260722), 2)") == 0).alias("cal"), F.expr(f"pmod(xxhash64(cluster_id, s, 20260723), {inner})").alias("own")).collect()}
    h = [r.h for r in units.orderBy("unit_id").select(X.stable_hash("unit_id", 20260722).alias("h")).collect()]
    rf, found = np.array([r[4] for r in runs_]), {}
    for s in range(splits):
        cal = np.array([deal[f"c{c}", s][0] for c in cluster])
        own = np.array([deal[f"c{c}", s][1] for c in cluster])
        of = np.array([r[0] for r in runs_])
        score = np.zeros(n)
        for k in (-1, *range(inner)):
            learn = cal[of] & (own[of] != k)
            ask = ~cal if k == -1 else cal & (own == k)
            for c, sign in ((2, -1), (3, 1)):
                b = newton(scaled(rf[learn], rf[learn])[:, None], [r[c] for r, u in zip(runs_, learn, strict=True) if u])
                score[ask] += sign / (1 + np.exp(-(b[0] + b[1] * scaled(f[ask], rf[learn]))))
        for policy, value in (("fixed", f), ("model M", score)):
            for regime, weight in (("balanced", np.ones(n)), ("natural", w)):
                order = lambda side, v=value: sorted(np.flatnonzero(side), key=lambda i: (-v[i], h[i], i))
                a, t = order(cal), order(~cal)
                for budget in (0.02, 0.3):
                    best = 0
                    for k in range(10, len(a) + 1, 10):
                        sums = {}
                        for i in a[:k]:
                            sums.setdefault(cluster[i], np.zeros(2))
                            sums[cluster[i]] += (weight[i] * effect[i], weight[i])
                        m = np.array(list(sums.values()))
                        theta = m[:, 0].sum() / m[:, 1].sum()
                        lcb = theta - 1.645 * np.sqrt(len(m) / (len(m) - 1) * ((m[:, 0] - theta * m[:, 1]) ** 2).sum()) / m[:, 1].sum() if len(m) > 1 else -1
                        best = k if lcb >= -budget else best
                    top = t[: int(best / len(a) * len(t) + 0.5)]
                    net = (weight[top] * effect[top]).sum() / weight[top].sum() if top else None
                    found.setdefault((regime, policy, budget), []).append((best / len(a), net))
    assert set(found) == set(got)
    for key, rows_ in found.items():
        nets = [x for _, x in rows_ if x is not None]
        assert got[key].splits == splits and got[key].median_coverage == pytest.approx(np.median([c for c, _ in rows_])), key
        assert (got[key].median_test_effect is None and not nets) or got[key].median_test_effect == pytest.approx(np.median(nets)), key
