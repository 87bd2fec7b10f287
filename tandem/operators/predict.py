"""Predictors: features, fold-local scaling, out-of-fold predictions and policies chosen on held-out parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.exprs import stable_hash, wilson_upper
from tandem.functions.keys import null_safe_join
from tandem.functions.storage import cut
from tandem.operators.inference import bootstrap_ci, masked_logistic_fits, one_sided_lcb, probability
from tandem.operators.prefixes import cluster_states, order_blocks, prefix_bounds, prefix_sums_at, view_totals
from tandem.operators.ranking import average_precision, bounds_of, null_floor, roc_auc, running_sums, spearman


def feature_columns(flags: dict[str, Column], interactions: list[tuple[str, str]], lengths: dict[str, Column]) -> dict[str, Column]:
    """Indicators, products of two of them, and log1p of lengths."""
    out = {n: c.cast("int") for n, c in flags.items()}
    out |= {f"{a}_{b}": (flags[a] & flags[b]).cast("int") for a, b in interactions}
    return out | {n: F.log1p(c) for n, c in lengths.items()}


def standardize(df: DataFrame, fold: str, cols: list[str], k: int) -> DataFrame:
    """`col`_z by mean and population sd of all other folds (k of them, few); an sd up to 1e-6 counts as 1. NULL where there is no other fold.

    Folds are reduced to counts, means and squared distances from their means; those of the other folds are merged
    around the fold's own mean, so that large means cost no digits.
    """
    per = df.groupBy(fold).agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))))
    other = per.select(F.col(fold).alias("_f"), *(F.col(f"{n}_{c}").alias(f"o{n}_{c}") for c in cols for n in "nmv"))
    both = per.crossJoin(F.broadcast(other)).where(~F.col(fold).eqNullSafe(F.col("_f")))  # k rows each
    away = lambda c: F.col(f"om_{c}") - F.coalesce(f"m_{c}", F.lit(0.0))
    sums = both.groupBy(fold).agg(
        *(F.first(f"m_{c}").alias(f"m_{c}") for c in cols), *(F.sum(f"on_{c}").alias(f"n_{c}") for c in cols), *(F.sum(F.col(f"on_{c}") * away(c)).alias(f"s_{c}") for c in cols),
        *(F.sum(F.col(f"on_{c}") * (F.col(f"ov_{c}") + away(c) * away(c))).alias(f"q_{c}") for c in cols),
    )
    stats = []
    for c in cols:
        n, s, q = (F.col(f"{x}_{c}") for x in "nsq")
        off = F.try_divide(s, n)
        sd = F.sqrt(F.greatest(F.try_divide(q, n) - off * off, F.lit(0.0)))
        stats += [(F.coalesce(f"m_{c}", F.lit(0.0)) + off).alias(f"_m_{c}"), F.when(sd <= 1e-6, 1.0).otherwise(sd).alias(f"_d_{c}")]
    found = sums.select(F.col(fold).alias("_f"), *stats)
    out = df.join(F.broadcast(found), F.col(fold).eqNullSafe(F.col("_f")), "left")  # k rows
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}") for c in cols}).drop("_f", *(f"_{x}_{c}" for c in cols for x in "md"))


def combine_scores(scores: DataFrame, n_scorers: int, signs: dict | None = None) -> DataFrame:
    """Mean score, range and sample sd over scorers, for units that all of them cover; `signs` turns scorers the same way."""
    sign = F.lit(1.0)
    for scorer, s in (signs or {}).items():
        sign = F.when(F.col("scorer") == scorer, F.lit(s)).otherwise(sign)
    v = F.col("score") * sign
    out = scores.where("score is not null").groupBy("unit_id").agg(F.avg(v).alias("mean_score"), (F.max(v) - F.min(v)).alias("spread"), F.stddev_samp(v).alias("disagreement"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == n_scorers).drop("_n")


def group_key(by: list[str]) -> Column:
    """The values of `by` as one text; NULL is a value."""
    return F.to_json(F.struct(*(F.col(b) for b in by), F.lit(0).alias("_")), {"ignoreNullFields": "false"})


def fit_table(spark, kinds: str, keys: list[tuple], fits: list[dict]) -> DataFrame:
    data = [(*k, f["b"], f["m"], f["s"]) for k, f in zip(keys, fits, strict=True)]
    return spark.createDataFrame(data, f"{kinds}, fit_b array<double>, fit_m array<double>, fit_s array<double>")


def cross_validated_predictions(df: DataFrame, by: list[str], y: str, models: dict[str, list[str]], fold: str, k: int = 5, l2: float = 1.0, keep: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """Out-of-fold probabilities: by, model, fold, keep, y, p. Features are scaled by the fit's own rows; rows with NULLs in them are left out.

    All fits (group x model x fold) share one copy of the rows, reduced to counts per group, fold and features; in
    which fits' training parts a row lies is an array. `fold` runs from 0 to k - 1; groups must be few.
    """
    xs = list(dict.fromkeys(c for cols in models.values() for c in cols))
    whole = df.dropna(subset=[y, fold, *xs]).select(*dict.fromkeys([*by, y, fold, *keep, *xs])).withColumn("_key", group_key(by))
    whole = cut(whole)  # read for the fits and for the predictions
    train = cut(whole.groupBy("_key", F.col(fold).cast("int").alias("_own"), *(F.col(x).cast("double").alias(x) for x in xs)).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.sum(1 - F.col(y).cast("long")).alias("_neg")))
    groups = sorted(r[0] for r in train.select("_key").distinct().collect())
    named = [(g, f, m) for g in groups for f in range(k) for m in models]
    masked = train.withColumn("_masks", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("_own")))
    fits = masked_logistic_fits(masked, xs, [(g, f, models[m]) for g, f, m in named], l2)
    table = fit_table(df.sparkSession, "_key string, _own int, model string", named, fits)
    held = whole.withColumn("_own", F.col(fold).cast("int")).join(F.broadcast(table), ["_key", "_own"])  # a row per fit
    return held.select(*by, "model", F.col("_own").alias("fold"), *keep, F.col(y).cast("int").alias("y"), probability(xs).alias("p"))


def fold_metrics(predictions: DataFrame, by: list[str], deltas: list[tuple[str, str]], reps: int = 1000, seed: int = 20260722, unit: str = "unit_id") -> DataFrame:
    """by, model, metric, n (folds), estimate, ci_lower, ci_upper: AUPRC, AUROC and Brier score as means over folds with fold-bootstrap intervals, and paired AUPRC differences `left-right`."""
    keys = [*by, "model", "fold"]
    scored = cut(predictions.withColumnRenamed("p", "score"))
    ap = average_precision(scored, keys, "score", "y", unit).select(*keys, F.lit("auprc").alias("metric"), F.col("average_precision").alias("v"))
    auc = roc_auc(scored, keys, "score", "y").select(*keys, F.lit("auroc").alias("metric"), F.col("auroc").alias("v"))
    brier = scored.groupBy(*keys).agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("v")).select(*keys, F.lit("brier").alias("metric"), "v")
    rows = cut(ap.unionByName(auc).unionByName(brier).where("v is not null"))  # folds x models x metrics rows
    parts = [rows]
    for left, right in deltas:
        a, b = (rows.where((F.col("metric") == "auprc") & (F.col("model") == m)).select(*by, "fold", F.col("v").alias(n)) for m, n in ((left, "a"), (right, "b")))
        parts.append(a.join(F.broadcast(b), [*by, "fold"]).select(*by, F.lit(f"{left}-{right}").alias("model"), "fold", F.lit("delta_auprc").alias("metric"), (F.col("a") - F.col("b")).alias("v")))
    return bootstrap_ci(reduce(DataFrame.unionByName, parts), [*by, "model", "metric"], "fold", F.col("v"), F.lit(1), reps, seed).drop("clusters")


def signal_audit(scores: DataFrame, effects: DataFrame, min_units: int = 50) -> DataFrame:
    """Per scorer: units, AUROC and average precision against a harmed unit, and rank correlation with the effect; scorers under `min_units` left out."""
    both = scores.where("score is not null").join(effects.select("unit_id", "target_effect", (F.col("target_effect") < 0).cast("int").alias("harmed")).where("target_effect is not null"), "unit_id")
    size = both.groupBy("scorer").agg(F.count(F.lit(1)).alias("units")).where(F.col("units") >= min_units)
    auc = roc_auc(both, ["scorer"], "score", "harmed").select("scorer", "auroc")
    ap = average_precision(both, ["scorer"], "score", "harmed").select("scorer", "average_precision")
    rho = spearman(both, ["scorer"], "score", "target_effect").select("scorer", "spearman")
    return size.join(auc.hint("merge"), "scorer").join(ap.hint("merge"), "scorer").join(rho.hint("merge"), "scorer")


def benchmark_evaluate(predictions: DataFrame, hidden: DataFrame, key: str = "unit_id") -> DataFrame:
    """Average precision and base rate of danger and benefit on the hidden part; `missing` counts hidden units without a prediction."""
    both = hidden.join(predictions.select(key, "p_danger", "p_benefit"), key, "left")
    parts = []
    for task in ("danger", "benefit"):
        rows = both.where(F.col(f"p_{task}").isNotNull()).withColumn("task", F.lit(task))
        parts.append(average_precision(rows, ["task"], f"p_{task}", task, key))
    missing = both.agg(F.sum(F.col("p_danger").isNull().cast("long")).alias("missing"))
    return parts[0].unionByName(parts[1]).crossJoin(missing)  # one row


def wilson_calibrated_policy(rows: DataFrame, by: list[str], split: str, score: str, danger: str, budgets: list[float], coverages: list[float], z: float = 1.645, unit: str = "unit_id") -> DataFrame:
    """Per group, the largest coverage whose Wilson bound on the calibration half is within the budget, and what it gives on the test half."""
    keys = [*by, split]
    g = running_sums(rows.select(*keys, unit, score, F.col(danger).cast("long").alias("_d")), keys, [score, unit], {"d": "_d"})
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("coverage", F.explode(F.array(*map(F.lit, coverages)))).withColumn("rank", F.floor(F.col("n") * F.col("coverage")))
    at = cut(null_safe_join(n, g, [*keys, "rank"]).select(*keys, "coverage", F.col("rank").alias("k"), (F.col("d") / F.col("rank")).alias("rate")))  # a row per group, half and coverage
    cal = at.where(F.col(split) == "calibration").withColumn("upper", wilson_upper("rate", "k", z)).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    chosen = cal.where("upper <= budget").groupBy(*by, "budget").agg(F.max(F.struct("coverage", "upper")).alias("c")).select(*by, "budget", "c.*")
    test = at.where(F.col(split) == "test").select(*by, "coverage", F.col("k").alias("test_k"), F.col("rate").alias("test_rate"))
    return null_safe_join(chosen, test, [*by, "coverage"])


def score_policies(scores: DataFrame, units: DataFrame, least: float, most_spread: float) -> DataFrame:
    """Selected units of a low mean score, abstaining where scorers disagree by more than `most_spread`: selected, abstained, mean effect, danger share."""
    both = units.join(scores, "unit_id")
    low, agree = F.col("mean_score") <= least, F.col("spread") <= most_spread
    pick = low & agree
    return both.agg(F.count(F.lit(1)).alias("units"), F.sum(pick.cast("long")).alias("selected"), F.sum((low & ~agree).cast("long")).alias("abstained"), F.avg(F.when(pick, F.col("effect"))).alias("mean_effect"), F.avg(F.when(pick, (F.col("effect") < 0).cast("double"))).alias("danger_share"))


def score_curves(scores: DataFrame, units: DataFrame, n_scorers: int, most_spread: float = 0.3, step: int = 20, seed: int = 20260722) -> DataFrame:
    """policy, k, coverage, net_change, danger_rate, benefit_rate: taking the k units of the lowest score, at every `step`-th k.

    One policy per scorer, over the units that it scores; and `ensemble`, by mean score over the units that all scorers
    cover and on which they do not differ by more than `most_spread`, abstaining elsewhere. Coverage and net change
    refer to all units; ties go by a hash of the unit. scores: unit_id, scorer, score; units: unit_id, effect, runs,
    danger, benefit.
    """
    each = scores.where("score is not null").select("unit_id", F.concat(F.lit("score "), "scorer").alias("policy"), F.col("score").cast("double").alias("policy_score"))
    agreed = combine_scores(scores, n_scorers).where(F.col("spread") <= most_spread).select("unit_id", F.lit("ensemble").alias("policy"), F.col("mean_score").alias("policy_score"))
    rows = units.select("unit_id", "effect", "runs", "danger", "benefit").join(each.unionByName(agreed).hint("merge"), "unit_id")
    sums = {"_e": "effect", "_r": "runs", "_d": "danger", "_b": "benefit"}
    at = running_sums(rows.withColumn("_h", stable_hash("unit_id", seed)), ["policy"], ["policy_score", "_h", "unit_id"], sums).where(F.col("rank") % step == 0)
    total = units.agg(F.count(F.lit(1)).alias("_n"))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("_r"))
    return at.crossJoin(F.broadcast(total)).select("policy", F.col("rank").alias("k"), (F.col("rank") / F.col("_n")).alias("coverage"), (F.col("_e") / F.col("_n")).alias("net_change"), share("_d").alias("danger_rate"), share("_b").alias("benefit_rate"))  # one row


def probe_and_rollback(runs: DataFrame, sets: dict[str, Column], cluster: str = "cluster_id", probe_run: int = 1, least: int = 3, reps: int = 1000, seed: int = 20260722) -> DataFrame:
    """candidate_set, policy, candidates, accept_rate, net, net_lcb, harmed_share, null_floor, excess: the target's probe run decides per unit, the later runs evaluate.

    `naive` accepts always; `rollback` keeps a unit whose probe failed as it was, without effect or chance of harm. Units
    count that have a probe and at least `least` other runs under both conditions. The floor is the share of harmed
    units that chance makes at a common rate; net_lcb is the 5 % quantile under cluster resampling. `sets` names
    predicates over unit_id, the cluster and any column of `runs` that is constant in a unit.
    """
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("outcome")))
    extra = [c for c in runs.columns if c not in ("unit_id", "run_id", "condition", "outcome")]
    per_run = runs.where(F.col("condition").isin("control", "target_delete")).groupBy("unit_id", "run_id").agg(of("control").alias("_c"), of("target_delete").alias("_t"), *(F.first(c, ignorenulls=True).alias(c) for c in extra))
    judged = (F.col("run_id") != probe_run) & F.col("_c").isNotNull() & F.col("_t").isNotNull()
    per = per_run.groupBy("unit_id").agg(
        F.max(F.when(F.col("run_id") == probe_run, F.col("_t"))).alias("probe"), F.count(F.when(judged, 1)).alias("c"), F.sum(F.when(judged, F.col("_c"))).alias("_sc"), F.sum(F.when(judged, F.col("_t"))).alias("_st"),
        *(F.first(c, ignorenulls=True).alias(c) for c in extra),
    ).where(F.col("probe").isNotNull() & (F.col("c") >= least))
    per = per.withColumns({"t": F.col("c"), "p": (F.col("_sc") + F.col("_st")) / (2 * F.col("c")), "_d": F.col("_st") / F.col("c") - F.col("_sc") / F.col("c")})
    both = null_floor(per)
    ok = F.col("probe") == 1
    ways = [F.struct(F.lit("naive").alias("policy"), F.lit(1.0).alias("_a"), F.col("_d").alias("delta"), F.col("floor").alias("_f")), F.struct(F.lit("rollback").alias("policy"), ok.cast("double").alias("_a"), F.when(ok, F.col("_d")).otherwise(0.0).alias("delta"), F.when(ok, F.col("floor")).otherwise(0.0).alias("_f"))]
    named = F.explode(F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in sets.items()))))
    rows = cut(both.withColumn("candidate_set", named).select("candidate_set", "unit_id", cluster, F.explode(F.array(*ways)).alias("x")).select("candidate_set", "unit_id", cluster, "x.*"))
    keys = ["candidate_set", "policy"]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), F.avg("_a").alias("accept_rate"), F.avg("delta").alias("net"), F.avg((F.col("delta") < 0).cast("double")).alias("harmed_share"), F.avg("_f").alias("null_floor"))
    low = one_sided_lcb(rows, keys, cluster, F.col("delta"), F.lit(1), reps, seed).select(*keys, F.col("lcb").alias("net_lcb"))
    return null_safe_join(out, low, keys).withColumn("excess", F.greatest(F.lit(0.0), F.col("harmed_share") - F.col("null_floor")))


def split_half_null(runs: DataFrame) -> DataFrame:
    """Control runs 1-2 against 3-4, of units that have all four: the differences that noise alone makes, the share of harm that a common rate predicts, and the excess over it."""
    at = lambda *ids: F.avg(F.when(F.col("run_id").isin(*ids), F.col("outcome")))
    per = runs.where("condition = 'control' and run_id between 1 and 4").groupBy("unit_id").agg(F.count_distinct("run_id").alias("_n"), at(1, 2).alias("a"), at(3, 4).alias("b"), at(1, 2, 3, 4).alias("p")).where("_n = 4")
    rows = null_floor(per.withColumns({"c": F.lit(2).cast("long"), "t": F.lit(2).cast("long")}))
    d = F.col("b") - F.col("a")
    out = rows.agg(F.count(F.lit(1)).alias("units"), F.avg(d).alias("mean_difference"), F.avg((d < 0).cast("double")).alias("share_negative"), F.avg((d <= -0.5).cast("double")).alias("share_half_down"), F.avg("floor").alias("null_floor"))
    return out.withColumn("excess", F.greatest(F.lit(0.0), F.col("share_negative") - F.col("null_floor")))


def nested_policy_selection(pairs: DataFrame, units: DataFrame, static: dict[str, tuple[Column, Column]], models: dict[str, list[str]], splits: int = 20, inner: int = 5, budgets: tuple[float, ...] = (0.01, 0.05), cluster: str = "cluster_id", seed: int = 20260722, step: int = 10) -> DataFrame:
    """Policies certified on one half of the clusters and tried on the other, over `splits` outer splits.

    Models predict danger and benefit of a unit from runs of the calibration half: its own units by `inner` folds, the
    test half by a fit on all of them; the score is P(benefit) - P(danger). On the calibration half the largest prefix
    whose cluster-robust bound is within the budget gives a coverage, which is applied to the test half. Splits,
    folds, models and tasks are fitted over one copy of the runs. Units are ordered once per static policy for all splits
    (a half is whole clusters, a view of the blocks) and once per split, half and model; both weightings share it.

    pairs: unit_id, `cluster`, danger, benefit, control_outcome and the features of its unit; units: unit_id, `cluster`,
    effect, w (natural weight) and the features. One row per regime, policy and budget: splits with any coverage,
    median, least and greatest coverage, median test effect per selected unit and median share of harmed units.
    """
    xs = list(dict.fromkeys(c for cols in models.values() for c in cols))
    part = lambda s: F.pmod(F.xxhash64(F.col(cluster), s, F.lit(seed)), F.lit(2)) == 0
    fold = lambda s: F.pmod(F.xxhash64(F.col(cluster), s, F.lit(seed + 1)), F.lit(inner)).cast("int")
    over = lambda df: df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumns({"cal": part(F.col("split")), "own": fold(F.col("split"))})
    # one copy of the runs for all splits, folds, models and tasks: counts per cluster and features, with the training parts that they lie in as an array; part -1 is the whole calibration half
    task = F.explode(F.array(*(F.struct(F.lit(t).alias("_key"), F.col(t).cast("long").alias("_y")) for t in ("danger", "benefit"))))
    flat = pairs.dropna(subset=xs).select(cluster, *(F.col(x).cast("double").alias(x) for x in xs), task.alias("t")).select(cluster, *xs, "t.*").where("_y is not null")
    counts = cut(flat.groupBy("_key", cluster, *xs).agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg")))
    parts = F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), lambda s: F.transform(F.sequence(F.lit(-1), F.lit(inner - 1)), lambda f: part(s) & (f != fold(s))))
    named = [(s, f, m, t) for s in range(splits) for f in range(-1, inner) for m in models for t in ("danger", "benefit")]
    fits = masked_logistic_fits(counts.withColumn("_masks", F.flatten(parts)), xs, [(t, s * (inner + 1) + f + 1, models[m]) for s, f, m, t in named])
    names, regimes, halves = [*static, *(f"model {m}" for m in models)], {"balanced": None, "natural": "w"}, 2 * splits
    # an ordering's number: its policy, then 0 where it is the same in all splits, else 1 + its view. A view is the calibration or, `splits` further on, the test half of a split: whole clusters
    ordering = lambda policy, view: (policy * (halves + 1) + view).cast("int")
    units = cut(units.select("unit_id", cluster, "effect", F.col("w").cast("double").alias("w"), *(F.col(x).cast("double").alias(x) for x in xs), *(c.cast("double").alias(f"_{k}{i}") for i, rule in enumerate(static.values()) for k, c in zip("ts", rule, strict=True))))
    asked = over(units).withColumn("fit", F.when(F.col("cal"), F.col("own")).otherwise(F.lit(-1)))
    both = fit_table(units.sparkSession, "split int, fit int, model string, task string", named, fits).groupBy("split", "fit", "model").pivot("task", ["danger", "benefit"]).agg(F.first(F.struct("fit_b", "fit_m", "fit_s")))
    p = asked.join(F.broadcast(both), ["split", "fit"])  # a row per fit
    score = probability(xs, "benefit.") - probability(xs, "danger.")
    number = F.array_position(F.array(*map(F.lit, names)), F.concat(F.lit("model "), "model")) - 1
    view = F.col("split") + F.when(F.col("cal"), 0).otherwise(splits)
    learned = p.select(ordering(number, 1 + view).alias("_g"), "unit_id", cluster, "effect", "w", F.lit(0.0).alias("tier"), score.alias("policy_score"))
    rules = F.explode(F.array(*(F.struct(ordering(F.lit(i), F.lit(0)).alias("_g"), F.col(f"_t{i}").alias("tier"), F.col(f"_s{i}").alias("policy_score")) for i in range(len(static))))) if static else None
    rows = learned
    if static:
        rows = units.select("unit_id", cluster, "effect", "w", rules.alias("r")).select("r._g", "unit_id", cluster, "effect", "w", "r.tier", "r.policy_score").unionByName(learned)
    rows = rows.withColumn("_h", F.unhex(stable_hash("unit_id", seed)))
    blocks = order_blocks(rows, "_g", ["tier", "-policy_score", "_h", "unit_id"], cluster, "effect", list(regimes.values()))
    of_split = F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), lambda s: (s + F.when(part(s), 0).otherwise(splits)).cast("int"))
    own_view = F.col("_g") % (halves + 1) - 1
    states = cluster_states(blocks, "_g", cluster, len(regimes), F.when(own_view < 0, of_split).otherwise(F.array(own_view.cast("int"))))
    totals = view_totals(states, "_g", len(regimes))
    calibrating = own_view < splits
    bounds = bounds_of(prefix_bounds(blocks.where(calibrating), states.where(calibrating), totals.where(F.col("view") < splits), "_g", len(regimes), step), list(regimes))
    bounds = bounds.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    chosen = bounds.groupBy("_g", "view", "regime", "budget").agg(F.max("total").alias("n_cal"), F.max(F.when((F.col("lcb") >= -F.col("budget")) & (F.col("k") % step == 0), F.col("k"))).alias("k"))
    chosen = chosen.withColumns({"_g": F.when(own_view < 0, F.col("_g")).otherwise(F.col("_g") + splits).cast("int"), "view": (F.col("view") + splits).cast("int")})  # the test half of the same split
    chosen = cut(chosen)  # a row per split, policy, weighting and budget
    n_test = totals.groupBy("_g", "view").agg(F.max("total").alias("n_test"))
    chosen = chosen.join(n_test.hint("merge"), ["_g", "view"], "left").withColumn("coverage", F.coalesce(F.col("k") / F.col("n_cal"), F.lit(0.0)))
    chosen = cut(chosen.withColumn("k", F.round(F.col("coverage") * F.coalesce("n_test", F.lit(0))).cast("long")))
    at = prefix_sums_at(blocks, states, totals, chosen, "_g", len(regimes))
    of_regime = lambda x: reduce(lambda else_, i: F.when(F.col("regime") == list(regimes)[i], F.col(f"{x}{i}")).otherwise(else_), range(len(regimes)), F.lit(None).cast("double"))
    at = at.withColumns({"net": of_regime("sa") / of_regime("sb"), "share": of_regime("sh") / of_regime("sb"), "policy": F.get(F.array(*map(F.lit, names)), F.floor(F.col("_g") / (halves + 1)).cast("int"))})
    return at.groupBy("regime", "policy", "budget").agg(
        F.count(F.lit(1)).alias("splits"), F.sum((F.col("coverage") > 0).cast("int")).alias("splits_with_coverage"), F.percentile("coverage", F.lit(0.5)).alias("median_coverage"), F.min("coverage").alias("least_coverage"),
        F.max("coverage").alias("greatest_coverage"), F.percentile("net", F.lit(0.5)).alias("median_test_effect"), F.percentile("share", F.lit(0.5)).alias("median_test_harmed"),
    )
