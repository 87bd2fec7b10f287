"""Aggregates over run, unit and label tables. Sums of integers first, divisions last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.storage import cut
from tandem.operators.ranking import order_statistics, with_groups

CONDITIONS = ("control", "target_delete", "placebo_delete")


def _when(test: Column, value: Column | int = 1) -> Column:
    return F.when(test, value if isinstance(value, Column) else F.lit(value))


def count_if(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).cast("long")


def share_of(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def unit_effects(runs: DataFrame, key: str = "unit_id", carry: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """Per unit: rate and count of each condition, the three effects, and whether the unit lost or gained on average. One shuffle on the unit."""
    of = lambda c: F.col("condition") == c
    names = {"control": "control", "target_delete": "target", "placebo_delete": "placebo"}
    aggs = [F.min(c).alias(c) for c in carry]
    for c, n in names.items():
        aggs += [F.avg(_when(of(c), F.col("outcome"))).alias(f"{n}_rate"), count_if(of(c)).alias(f"{n}_runs")]
    out = runs.groupBy(key).agg(*aggs)
    diff = lambda a, b: F.col(f"{a}_rate") - F.col(f"{b}_rate")
    out = out.withColumns({"target_effect": diff("target", "control"), "placebo_effect": diff("placebo", "control"), "semantic_effect": diff("target", "placebo")})
    return out.withColumns({"danger_unit": (F.col("target_effect") < 0).cast("int"), "benefit_unit": (F.col("target_effect") > 0).cast("int")})


def unit_transitions(pairs: DataFrame, key: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """Counts of the four transitions, net gain, danger and recovery rate, mean cost change; from `pair_runs`."""
    c, t = F.col("control_outcome"), F.col("target_outcome")
    out = pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), count_if((c == 0) & (t == 1)).alias("wrong_to_correct"), count_if((c == 1) & (t == 0)).alias("correct_to_wrong"),
        count_if((c == 1) & (t == 1)).alias("still_correct"), count_if((c == 0) & (t == 0)).alias("still_wrong"), F.avg(F.col("target_cost") - F.col("control_cost")).alias("mean_cost_delta"),
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(a) + F.col(b), F.lit(0)))
    return out.withColumns({
        "net_gain": F.col("wrong_to_correct") - F.col("correct_to_wrong"),
        "danger_rate": rate("correct_to_wrong", "still_correct"), "recovery_rate": rate("wrong_to_correct", "still_wrong"),
    })


def collect_cells(runs: DataFrame, key: str = "unit_id") -> DataFrame:
    """Per unit: outcomes in run order per condition (an empty list without runs of it), and a map of status counts. Bounded by the runs of one unit."""
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col("condition") == c, F.struct("run_id", "outcome")))), lambda x: x["outcome"])
    cells = runs.groupBy(key).agg(listed("control").alias("control_labels"), listed("target_delete").alias("target_labels"))
    counts = runs.groupBy(key, "status").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("status_counts"))
    return cells.join(counts, key)


def dimension_rows(df: DataFrame, dimensions: dict[str, Column | str], overall: str | None = "overall") -> DataFrame:
    """Each row once per dimension, as (dimension, group): overlapping groups in one pass. Rows with a NULL group leave that dimension."""
    cells = [F.struct(F.lit(d).alias("dimension"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("group")) for d, c in dimensions.items()]
    if overall:
        cells.insert(0, F.struct(F.lit(overall).alias("dimension"), F.lit("all").alias("group")))
    return df.withColumn("cell", F.explode(F.array(*cells))).select("*", "cell.dimension", "cell.group").drop("cell").where(F.col("group").isNotNull())


def multi_dimension_summary(df: DataFrame, dimensions: dict[str, Column | str], aggs: list[Column]) -> DataFrame:
    return dimension_rows(df, dimensions).groupBy("dimension", "group").agg(*aggs)


def numeric_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample sd (0 below two values), median, quartiles by linear interpolation, nearest-rank P95; NULLs left out."""
    v, df = F.col(value), cut(df.select(*by, value))
    sums = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"))
    return with_groups(sums, order_statistics(df, by, value, median=("cont", 0.5), q1=("cont", 0.25), q3=("cont", 0.75), p95=("disc", 0.95), written=True), by)


def condition_stats(runs: DataFrame) -> DataFrame:
    """Per condition and run, and per condition (run NULL): n, correct, accuracy in percent, cost total, mean, median and P95, status counts."""
    statuses = ("completed", "cannot_continue", "logical_break")
    runs = cut(runs.select("condition", F.col("run_id").cast("long").alias("run_id"), "outcome", "cost", "status"))  # ranks of runs are dear
    both = runs.withColumn("run", F.explode(F.array(F.col("run_id"), F.lit(None).cast("long"))))
    sums = both.groupBy("condition", "run").agg(
        F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("correct"), (F.sum("outcome") * 100 / F.count(F.lit(1))).alias("accuracy"),
        F.sum("cost").alias("cost_total"), F.avg("cost").alias("cost_mean"), *(count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses),
    )
    return with_groups(sums, order_statistics(both, ["condition", "run"], "cost", cost_median=("cont", 0.5), cost_p95=("disc", 0.95), written=True), ["condition", "run"])


def cost_savings(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Cost saved by the target: net, share, mean and median; pairs that cost less, the same, more; statuses newly broken or recovered."""
    pairs = cut(pairs.select(*dict.fromkeys([*by, "control_cost", "target_cost", "control_status", "target_status"])))
    saved, done = F.col("control_cost") - F.col("target_cost"), "completed"
    sums = pairs.groupBy(*by).agg(
        F.sum(saved).alias("net_saved"), (F.sum(saved) * 100 / F.sum("control_cost")).alias("percent_saved"), F.avg(saved).alias("mean_saved"),
        count_if(saved > 0).alias("fewer"), count_if(saved == 0).alias("same"), count_if(saved < 0).alias("more"),
        count_if((F.col("control_status") == done) & (F.col("target_status") != done)).alias("newly_broken"),
        count_if((F.col("control_status") != done) & (F.col("target_status") == done)).alias("recovered"),
    )
    return with_groups(sums, order_statistics(pairs, by, saved, median_saved=("cont", 0.5), written=True), by)


def retained_cohort(pairs: DataFrame) -> DataFrame:
    """Pairs that are not wrong on both sides."""
    return pairs.where((F.col("control_outcome") == 1) | (F.col("target_outcome") == 1))


def ratio_metrics(pairs: DataFrame, by: list[str], cluster: str = "cluster_id") -> DataFrame:
    """Accuracy change, harm rate, recovery rate and cost change as ratios of sums, in two steps: per cluster, then over clusters."""
    per = cluster_sums(pairs, by, cluster)
    s = {c: F.sum(c) for c in ("n", "cc", "tc", "cw", "wc", "c_cost", "t_cost")}
    d = lambda a, b: F.try_divide(a.cast("double"), F.nullif(b, F.lit(0).cast("double")))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clusters"), s["n"].alias("pairs"), d(s["tc"] - s["cc"], s["n"].cast("double")).alias("accuracy_change"),
        d(s["cw"], s["cc"].cast("double")).alias("harm_rate"), d(s["wc"], (s["n"] - s["cc"]).cast("double")).alias("recovery_rate"), d(s["t_cost"] - s["c_cost"], s["c_cost"]).alias("cost_change"),
    )


def cluster_sums(pairs: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """Sufficient sums of each cluster: everything resampling needs."""
    return pairs.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"), F.sum("control_outcome").alias("cc"), F.sum("target_outcome").alias("tc"), F.sum("danger").alias("cw"), F.sum("benefit").alias("wc"), F.sum("control_cost").alias("c_cost"), F.sum("target_cost").alias("t_cost"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every pair of levels, zero cells kept, shares of all and of the row, expected count.

    Only tables of levels are crossed: for columns of few levels each (their product is the size of the result), not for free text.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    grid = cells.select("a").distinct().crossJoin(cells.select("b").distinct())  # levels, not rows
    full = grid.join(cells, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    row, col, all_ = Window.partitionBy("a"), Window.partitionBy("b"), Window.partitionBy(F.lit(1))
    return full.withColumns({"row_total": F.sum("n").over(row), "col_total": F.sum("n").over(col), "total": F.sum("n").over(all_)}).withColumns(
        {"share": F.col("n") / F.col("total"), "row_share": F.col("n") / F.col("row_total"), "expected": F.col("row_total") * F.col("col_total") / F.col("total")}
    )


def chi_square(cells: DataFrame) -> DataFrame:
    """Independence chi-square, degrees of freedom and Cramer's V of a contingency table."""
    d = F.col("n") - F.col("expected")
    out = cells.agg(F.sum(d * d / F.col("expected")).alias("chi_square"), F.first("total").alias("total"), F.countDistinct("a").alias("rows"), F.countDistinct("b").alias("cols"))
    least = F.least("rows", "cols") - 1
    return out.select("chi_square", ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("df"), F.sqrt(F.try_divide(F.col("chi_square"), F.col("total") * least)).alias("cramers_v"), "total")


def confusion_matrix(df: DataFrame, predicted: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn of two 0/1 columns and the rates made of them."""
    p, t = F.col(predicted) == 1, F.col(truth) == 1
    out = df.groupBy(*(by or [])).agg(count_if(p & t).alias("tp"), count_if(~p & ~t).alias("tn"), count_if(p & ~t).alias("fp"), count_if(~p & t).alias("fn"))
    d = lambda a, b: F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return out.withColumns({"agreement": d(tp + tn, tp + tn + fp + fn), "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn), "fpr": d(fp, fp + tn), "fnr": d(fn, fn + tp)})


def rater_pairs(ratings: DataFrame, item: str = "item_id", rater: str = "rater", label: str = "label") -> DataFrame:
    """Every two raters' labels of an item: rater_a < rater_b."""
    a = ratings.select(item, F.col(rater).alias("rater_a"), F.col(label).alias("label_a"))
    b = ratings.select(item, F.col(rater).alias("rater_b"), F.col(label).alias("label_b"))
    return a.join(b, item).where(F.col("rater_a") < F.col("rater_b"))


def rater_agreement(pairs: DataFrame, by: list[str], categories: list, exclude: list | None = None) -> DataFrame:
    """Raw agreement, Cohen's kappa and Gwet's AC1 over a fixed category list. kappa is NULL where both raters are constant."""
    kept = [c for c in categories if c not in (exclude or [])]
    rows = pairs.where(F.col("label_a").isin(kept) & F.col("label_b").isin(kept))
    share = lambda c, v: F.avg(F.when(F.col(c) == v, 1.0).otherwise(0.0))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share_of(F.col("label_a") == F.col("label_b")).alias("agreement"), *(share(f"label_{s}", v).alias(f"{s}{i}") for s in "ab" for i, v in enumerate(kept)))
    chance = sum((F.col(f"a{i}") * F.col(f"b{i}") for i in range(len(kept))), F.lit(0.0))
    mean = [(F.col(f"a{i}") + F.col(f"b{i}")) / 2 for i in range(len(kept))]
    gwet = sum((m * (1 - m) for m in mean), F.lit(0.0)) / max(1, len(kept) - 1)
    corrected = lambda e: F.try_divide(F.col("agreement") - e, F.nullif(1 - e, F.lit(0.0)))
    return out.select(*by, "n", "agreement", corrected(chance).alias("kappa"), corrected(gwet).alias("ac1"))


def rater_confusion(pairs: DataFrame, levels: list) -> DataFrame:
    """Square table of two raters' labels, zero filled: one row per label of the first, one column per label of the second."""
    return pairs.groupBy("rater_a", "rater_b", "label_a").pivot("label_b", levels).agg(F.count(F.lit(1))).na.fill(0)


def consensus_and_disagreements(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items both raters label alike, and the others with both labels."""
    same = F.col("label_a") == F.col("label_b")
    return pairs.where(same).withColumnRenamed("label_a", "label").drop("label_b"), pairs.where(~same)


def label_validity(effects: DataFrame, labels: DataFrame, key: str, reference: str) -> DataFrame:
    """Per consensus label: units, mean effect, danger and benefit shares, and the share that equals the data's own label."""
    both = effects.join(labels, key)
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("units"), F.avg("target_effect").alias("mean_effect"), share_of(F.col("target_effect") < 0).alias("danger_share"), share_of(F.col("target_effect") > 0).alias("benefit_share"), share_of(F.col("label") == F.col(reference)).alias("reference_share"))


def label_distribution(df: DataFrame, scopes: dict[str, Column | str], label: str, strict: list, lenient: list) -> DataFrame:
    """Per scope and group: n, strict and lenient rates of a label."""
    return multi_dimension_summary(df, scopes, [F.count(F.lit(1)).alias("n"), count_if(F.col(label).isin(strict)).alias("strict_n"), share_of(F.col(label).isin(strict)).alias("strict_rate"), share_of(F.col(label).isin(lenient)).alias("lenient_rate")])


def grouped_bias(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Per key: n, agreement, both positive rates, and their difference in percentage points."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share_of(F.col(a) == F.col(b)).alias("agreement"), rate(a).alias("rate_a"), rate(b).alias("rate_b"), ((rate(a) - rate(b)) * 100).alias("bias_pp"))


def label_change_summary(df: DataFrame, by: list[str], old: str, new: str) -> DataFrame:
    """Agreement and directional flips between two passes of a 0/1 label."""
    o, n = F.col(old), F.col(new)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_if(o == n).alias("unchanged"), count_if((o == 0) & (n == 1)).alias("up"), count_if((o == 1) & (n == 0)).alias("down"), share_of(o == n).alias("agreement"))


def frame_counts(df: DataFrame, frame: str, level: str, cluster: str) -> DataFrame:
    """Level counts and shares inside each frame, and the clusters they come from."""
    out = df.groupBy(frame, level).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(cluster).alias("clusters"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(frame)))


def prevalence_weights(natural: DataFrame, cohort: DataFrame, by: list[str]) -> DataFrame:
    """Natural share over cohort share, for one stratum column or several jointly."""
    share = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias(name))
    return share(natural, "natural_share").join(share(cohort, "cohort_share"), by).withColumn("weight", F.col("natural_share") / F.col("cohort_share"))


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of weighted values over the weights of rows that have a value."""
    v, w = F.col(value), F.col(weight)
    return F.try_divide(F.sum(v * w), F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0)))


def smd(df: DataFrame, group: str, value: str, form: str = "pooled") -> DataFrame:
    """Standardised difference of two groups (group is 1 or 0): 'pooled' variance by degrees of freedom, 'average' of variances, or 'binary' by the pooled share."""
    v, g = F.col(value).cast("double"), F.col(group) == 1
    s = df.where(v.isNotNull()).agg(*(f(F.when(c, v)).alias(f"{n}{k}") for k, c in ((1, g), (0, ~g)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))), F.avg(v).alias("p"))
    d = F.col("m1") - F.col("m0")
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    var = {"pooled": pooled, "average": (F.col("v1") + F.col("v0")) / 2, "binary": F.col("p") * (1 - F.col("p"))}[form]
    return s.select(F.col("n1").alias("n_1"), F.col("n0").alias("n_0"), F.col("m1").alias("mean_1"), F.col("m0").alias("mean_0"), d.alias("difference"), F.try_divide(d, F.nullif(F.sqrt(var), F.lit(0.0))).alias("smd"))


def balance_table(df: DataFrame, group: str, numeric: list[str], categorical: list[str], threshold: float = 0.1) -> DataFrame:
    """Balance of all covariates in one long pass: numeric ones by pooled SMD, levels of the others by binary SMD, with the greatest of each variable flagged."""
    cells = [F.struct(F.lit(c).alias("variable"), F.lit("").alias("level"), F.col(c).cast("double").alias("value")) for c in numeric]
    rows = df.select(group, F.explode(F.array(*cells)).alias("x")).select(group, "x.*") if numeric else None
    levels = df.select(group, F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in categorical))).alias("x")).select(group, "x.*") if categorical else None
    parts = []
    g = F.col(group) == 1
    if rows is not None:
        s = rows.where("value is not null").groupBy("variable", "level").agg(*(f(F.when(c, F.col("value"))).alias(f"{n}{k}") for k, c in ((1, g), (0, ~g)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
        var = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
        parts.append(s.select("variable", "level", "n1", "n0", "m1", "m0", var.alias("var")))
    if levels is not None:
        per = levels.groupBy("variable", "level").agg(count_if(g).alias("k1"), count_if(~g).alias("k0"))
        w = Window.partitionBy("variable")
        per = per.withColumns({"n1": F.sum("k1").over(w), "n0": F.sum("k0").over(w)})
        p = (F.col("k1") + F.col("k0")) / (F.col("n1") + F.col("n0"))
        parts.append(per.select("variable", "level", "n1", "n0", (F.col("k1") / F.col("n1")).alias("m1"), (F.col("k0") / F.col("n0")).alias("m0"), (p * (1 - p)).alias("var")))
    both = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
    d = F.col("m1") - F.col("m0")
    out = both.select("variable", "level", F.col("n1").alias("n_1"), F.col("n0").alias("n_0"), F.col("m1").alias("mean_1"), F.col("m0").alias("mean_0"), F.try_divide(d, F.nullif(F.sqrt("var"), F.lit(0.0))).alias("smd"))
    worst = F.max(F.abs("smd")).over(Window.partitionBy("variable"))
    return out.withColumns({"max_abs_smd": worst, "imbalanced": F.coalesce(worst > threshold, F.lit(False))})


def group_balance_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and sd of each group, and the SMD (average of variances) of every two groups."""
    s = df.groupBy(F.col(group).cast("string").alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    a, b = (s.select(*(F.col(c).alias(f"{c}_{k}") for c in ("g", "n", "mean", "var"))) for k in "ab")
    both = a.crossJoin(b).where("g_a < g_b")  # one row per group
    return both.select("g_a", "g_b", "n_a", "n_b", "mean_a", "mean_b", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.nullif(F.sqrt((F.col("var_a") + F.col("var_b")) / 2), F.lit(0.0))).alias("smd"))


def first_by(df: DataFrame, by: list[str], order: list[Column | str], take: list[str], where: Column | None = None) -> DataFrame:
    """The row with the least order key of each group, without sorting the group."""
    key = F.struct(*(F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)))
    value = F.struct(*take)
    return df.where(where if where is not None else F.lit(True)).groupBy(*by).agg(F.min_by(value, key).alias("best")).select(*by, "best.*")


def exclusion_bias(df: DataFrame, retained: DataFrame, key: list[str], means: list[str], shares: dict[str, Column]) -> DataFrame:
    """Retained against excluded rows: n, means and shares."""
    marked = df.join(retained.select(*key).distinct().withColumn("kept", F.lit(True)), key, "left")
    return marked.groupBy(F.when(F.col("kept"), "retained").otherwise("excluded").alias("status")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(f"mean_{m}") for m in means), *(share_of(c).alias(n) for n, c in shares.items()))


def disambiguate(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Repeated keys get a suffix from the second occurrence on: key#2, key#3."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("unique_key", F.when(n > 1, F.concat(F.col(key).cast("string"), F.lit("#"), n.cast("string"))).otherwise(F.col(key).cast("string")))


def paired_mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Continuity-corrected chi-square on discordant pairs; NULL without any."""
    out = pairs.groupBy(*by).agg(F.sum("danger").alias("b"), F.sum("benefit").alias("c"))
    d = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)).cast("double")
    return out.withColumn("chi_square", F.try_divide(d * d, F.nullif((F.col("b") + F.col("c")).cast("double"), F.lit(0.0))))


def case_rule_verification(transitions: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per unit and rule with whether the recomputed transitions satisfy it."""
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("family"), c.alias("holds")) for n, c in rules.items())))
    return transitions.select("*", cells.alias("rule")).select("*", "rule.family", "rule.holds").drop("rule")
