"""Effect workflows: compositions of joins, aggregates and resampling that users call directly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.aggregates import dimension_rows, prevalence_weights, unit_effects, unit_transitions, weighted_mean
from tandem.operators.inference import bootstrap_ci, bootstrap_difference
from tandem.operators.joins import own_control_join, pair_runs


def assemble_unit_table(units: DataFrame, runs: DataFrame) -> DataFrame:
    """The unit table: attributes, effects, transitions and placebo coverage."""
    effects = unit_effects(runs, carry=())
    transitions = unit_transitions(pair_runs(runs))
    return units.join(effects, "unit_id").join(transitions.drop("n"), "unit_id").withColumn("placebo_eligible", F.col("placebo_runs") > 0)


def long_effects(effects: DataFrame, estimands: list[str], carry: list[str]) -> DataFrame:
    """unit effects as rows (estimand, value) without NULLs."""
    cells = F.explode(F.array(*(F.struct(F.lit(e).alias("estimand"), F.col(e).alias("value")) for e in estimands)))
    return effects.select(*carry, cells.alias("x")).select(*carry, "x.*").where("value is not null")


def effect_summary(effects: DataFrame, dimensions: dict[str, Column | str], estimands: list[str], cluster: str = "cluster_id", reps: int = 200, seed: int = 20260722, min_n: int = 10) -> DataFrame:
    """Per group and estimand: units, estimate and interval in percentage points; groups under `min_n` units left out."""
    attributes = sorted({c for c in dimensions.values() if isinstance(c, str)})
    rows = dimension_rows(long_effects(effects, estimands, [cluster, *attributes]), dimensions)
    out = bootstrap_ci(rows, ["dimension", "group", "estimand"], cluster, F.col("value"), F.lit(1.0), reps, seed)
    pp = lambda c: (F.col(c) * 100).alias(f"{c}_pp")
    return out.where(F.col("n") >= min_n).select("dimension", "group", "estimand", F.col("n").alias("units"), pp("estimate"), pp("ci_lower"), pp("ci_upper"))


def did_effects(runs: DataFrame) -> DataFrame:
    """Per unit: target effect, placebo effect against its own control (mean over cut-offs) and against the shared control, and both semantic effects."""
    own = own_control_join(runs).groupBy("unit_id").agg(F.avg("effect").alias("placebo_own_effect"), F.count(F.lit(1)).alias("cut_offs"))
    base = unit_effects(runs).select("unit_id", "cluster_id", "target_effect", F.col("placebo_effect").alias("placebo_legacy_effect"))
    both = base.join(own, "unit_id")
    return both.withColumns({"did_semantic_effect": F.col("target_effect") - F.col("placebo_own_effect"), "legacy_semantic_effect": F.col("target_effect") - F.col("placebo_legacy_effect")})


def condition_contrasts(runs: DataFrame, contrasts: dict[str, tuple[str, str]], carry: str = "cluster_id") -> DataFrame:
    """Per unit, differences of condition rates: {name: (condition, against)}."""
    names = sorted({c for pair in contrasts.values() for c in pair})
    rates = runs.groupBy("unit_id").agg(F.min(carry).alias(carry), *(F.avg(F.when(F.col("condition") == c, F.col("outcome"))).alias(f"rate_{c}") for c in names))
    return rates.select("unit_id", carry, *((F.col(f"rate_{a}") - F.col(f"rate_{b}")).alias(n) for n, (a, b) in contrasts.items()))


def cross_source_interaction(a: DataFrame, b: DataFrame, group: str, level: str, value: str) -> DataFrame:
    """Mean of a value per source on shared units, their difference, and how it differs between `level` and the rest."""
    both = a.select("unit_id", group, F.col(value).alias("va")).join(b.select("unit_id", F.col(value).alias("vb")), "unit_id").where("va is not null and vb is not null")
    in_ = F.col(group) == level
    m = lambda c, t: F.avg(F.when(t, F.col(c)))
    d = F.col("vb") - F.col("va")
    return both.agg(F.count(F.lit(1)).alias("units"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.avg(d).alias("difference"), (F.avg(F.when(in_, d)) - F.avg(F.when(~in_, d))).alias("interaction"), m("va", in_).alias("mean_a_level"), m("vb", in_).alias("mean_b_level"))


def mode_toggle_contrast(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same units under two modes: control rates, target effects, non-zero shares, and sign agreement."""
    side = lambda r, n: unit_effects(r).select("unit_id", F.col("control_rate").alias(f"control_{n}"), F.col("target_effect").alias(f"effect_{n}"))
    both = side(a, "a").join(side(b, "b"), "unit_id").where("effect_a is not null and effect_b is not null")
    live = (F.col("effect_a") != 0) & (F.col("effect_b") != 0)
    return both.agg(
        F.count(F.lit(1)).alias("units"), *(F.avg(f"control_{n}").alias(f"control_{n}") for n in "ab"), *(F.avg(f"effect_{n}").alias(f"effect_{n}") for n in "ab"),
        *(F.avg((F.col(f"effect_{n}") != 0).cast("double")).alias(f"nonzero_{n}") for n in "ab"), F.avg(F.when(live, (F.signum("effect_a") == F.signum("effect_b")).cast("double"))).alias("sign_agreement"),
    )


def regrade_sensitivity(runs: DataFrame, regraded: str) -> DataFrame:
    """Verdict agreement and mean effects under two graders of the same runs."""
    first = unit_effects(runs).agg(F.avg("target_effect").alias("effect_first"), F.avg("semantic_effect").alias("semantic_first"))
    second = unit_effects(runs.withColumn("outcome", F.col(regraded))).agg(F.avg("target_effect").alias("effect_second"), F.avg("semantic_effect").alias("semantic_second"))
    agree = runs.agg(F.count(F.lit(1)).alias("runs"), F.avg((F.col("outcome") == F.col(regraded)).cast("double")).alias("agreement"))
    one = agree.crossJoin(first).crossJoin(second)  # single rows
    return one.withColumns({"effect_change": F.abs(F.col("effect_second") - F.col("effect_first")), "semantic_change": F.abs(F.col("semantic_second") - F.col("semantic_first"))})


def label_substitution_sensitivity(runs: DataFrame, audited: DataFrame, key: list[str]) -> DataFrame:
    """Rates per condition before and after audited labels replace the automatic ones (key, label), in percentage points."""
    both = runs.join(audited.select(*key, "label"), key, "left").withColumn("revised", F.coalesce("label", "outcome"))
    return both.groupBy("condition").agg(F.count(F.lit(1)).alias("runs"), F.count("label").alias("audited"), F.avg("outcome").alias("rate_before"), F.avg("revised").alias("rate_after"), ((F.avg("revised") - F.avg("outcome")) * 100).alias("change_pp"))


def label_set_robustness(effects: DataFrame, label_columns: list[str], cluster_columns: list[str], value: str, reps: int = 200, seed: int = 20260722) -> DataFrame:
    """The same estimate per label under several label passes and cluster units, in one long table."""
    cells = [F.struct(F.lit(p).alias("label_pass"), F.col(p).cast("string").alias("label"), F.lit(c).alias("cluster_unit"), F.col(c).cast("string").alias("cluster")) for p in label_columns for c in cluster_columns]
    rows = effects.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.explode(F.array(*cells)).alias("x")).select("value", "x.*").where("label is not null")
    return bootstrap_ci(rows, ["label_pass", "label", "cluster_unit"], "cluster", F.col("value"), F.lit(1.0), reps, seed)


def group_by_position_interaction(effects: DataFrame, group: str, level: str, position: str, value: str) -> DataFrame:
    """Per position: mean inside the level, outside it, and their contrast; plus the differences of contrasts to the first position."""
    in_ = F.col(group) == level
    per = effects.where(F.col(value).isNotNull()).groupBy(F.col(position).alias("position")).agg(F.count(F.lit(1)).alias("units"), F.avg(F.when(in_, F.col(value))).alias("inside"), F.avg(F.when(~in_, F.col(value))).alias("outside"))
    per = per.withColumn("contrast", F.col("inside") - F.col("outside"))
    first = per.agg(F.min_by("contrast", "position").alias("first_contrast"))
    return per.crossJoin(first).withColumn("difference_to_first", F.col("contrast") - F.col("first_contrast")).drop("first_contrast")  # one row


def selection_effect_differences(units: DataFrame, eligible: str, statistics: dict[str, tuple[Column, Column]], reps: int = 200, seed: int = 20260722) -> DataFrame:
    """Eligible minus skipped units for ratio statistics {name: (numerator, denominator)} with intervals."""
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), a.cast("double").alias("num"), b.cast("double").alias("den")) for n, (a, b) in statistics.items())))
    rows = units.select("unit_id", F.col(eligible).cast("int").alias("side"), cells.alias("x")).select("unit_id", "side", "x.*").where("num is not null and den is not null")
    return bootstrap_difference(rows, ["statistic"], "side", "unit_id", F.col("num"), F.col("den"), reps, seed)


def prevalence_reweighted_effects(effects: DataFrame, natural: DataFrame, by: list[str], value: str) -> DataFrame:
    """The mean effect as the cohort has it and under natural weights of the strata."""
    weights = prevalence_weights(natural, effects, by).select(*by, "weight")
    both = effects.join(weights, by)
    return both.agg(F.count(F.lit(1)).alias("units"), F.avg(value).alias("balanced_effect"), weighted_mean(value, "weight").alias("natural_effect"), F.sum("weight").alias("total_weight"))


def discordance_rates(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Joint and conditional danger and benefit rates over matched runs."""
    d = lambda a, b: F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
    n, cc = F.count(F.lit(1)), F.sum("control_outcome")
    return pairs.groupBy(*by).agg(n.alias("pairs"), d(F.sum("danger"), n).alias("joint_danger"), d(F.sum("danger"), cc).alias("danger_given_correct"), d(F.sum("benefit"), n).alias("joint_benefit"), d(F.sum("benefit"), n - cc).alias("benefit_given_wrong"))


def figure_source(summary: DataFrame, wanted: list[tuple[str, str]], points: DataFrame) -> DataFrame:
    """Named groups of a summary in a given order, over the points they summarise; a missing group is an error."""
    spark = summary.sparkSession
    order = spark.createDataFrame([(i, d, g) for i, (d, g) in enumerate(wanted)], "nth int, dimension string, group string")
    rows = order.join(summary.hint("merge"), ["dimension", "group"], "left")
    checked = rows.withColumn("estimate", F.when(F.col("n").isNull(), F.raise_error(F.concat_ws(" ", F.lit("missing group"), "dimension", "group")).cast("double")).otherwise(F.col("estimate")))
    bars = checked.select(F.lit("group").alias("layer"), "nth", "group", F.col("estimate").alias("y"), F.lit(0.0).alias("x"))
    dots = points.join(F.broadcast(order.select("nth", "group")), "group").select(F.lit("unit").alias("layer"), "nth", "group", "y", "x")
    return bars.unionByName(dots)
