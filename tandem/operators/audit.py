"""Integrity rules, golden comparisons and audit gates. Each rule is one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.aggregates import share_of
from tandem.operators.ranking import order_statistics


def _row(df: DataFrame, name: str, observed: Column, expected: float | Column) -> DataFrame:
    e = expected if isinstance(expected, Column) else F.lit(float(expected))
    return df.agg(observed.cast("double").alias("observed")).select(F.lit(name).alias("check"), "observed", e.cast("double").alias("expected"))


def expect(df: DataFrame, rules: list[tuple], tolerance: float = 1e-9) -> DataFrame:
    """check, observed, expected, status of rules:

    ("rows", name, n), ("unique", name, key columns), ("members", name, group, n),
    ("constant", name, group, column), ("share", name, condition, expected), ("none", name, condition).
    """
    parts = []
    for kind, name, *args in rules:
        if kind == "rows":
            parts.append(_row(df, name, F.count(F.lit(1)), args[0]))
        elif kind == "unique":
            parts.append(_row(df.groupBy(*args[0]).agg(F.count(F.lit(1)).alias("n")), name, F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)), 0))
        elif kind == "members":
            parts.append(_row(df.groupBy(args[0]).agg(F.count(F.lit(1)).alias("n")), name, F.coalesce(F.sum((F.col("n") != args[1]).cast("int")), F.lit(0)), 0))
        elif kind == "constant":
            parts.append(_row(df.groupBy(args[0]).agg((F.min(args[1]) != F.max(args[1])).alias("bad")), name, F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)), 0))
        elif kind == "share":
            parts.append(_row(df, name, share_of(args[0]), args[1]))
        elif kind == "none":
            parts.append(_row(df.where(args[0]), name, F.count(F.lit(1)), 0))
        else:
            raise ValueError(f"no such rule: {kind}")
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("status", F.when(F.abs(F.col("observed") - F.col("expected")) <= tolerance, "PASS").otherwise("FAIL"))


def consistency_report(effects: DataFrame, summary: DataFrame) -> DataFrame:
    """Named PASS or FAIL: target minus placebo equals the semantic effect, effects lie in [-1, 1], every estimate lies in its interval."""
    gap = F.abs(F.col("target_effect") - F.col("placebo_effect") - F.col("semantic_effect")) > 1.5e-6
    first = expect(effects, [("none", "identity", gap), ("none", "range", F.abs("target_effect") > 1)])
    inside = (F.col("estimate") < F.col("ci_lower")) | (F.col("estimate") > F.col("ci_upper"))
    return first.unionByName(expect(summary, [("none", "estimate_in_interval", inside)]))


def golden_compare(actual: DataFrame, expected: DataFrame, key: list[str], values: list[str], tolerance: float) -> DataFrame:
    """Keyed comparison: one row per key and value, missing keys on either side fail."""
    long = lambda df, n: df.select(*key, F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias(n)) for v in values))).alias("x")).select(*key, "x.*")
    both = long(actual, "actual").join(long(expected, "expected").hint("merge"), [*key, "value"], "full_outer")
    same = F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.col("actual").isNull() & F.col("expected").isNull())
    return both.withColumn("status", F.when(same, "PASS").otherwise("FAIL"))


def audit_gate(audited: DataFrame, by: str, human: str, judge: str, hard: float = 0.9, unconditional: float = 0.97, bias_limit: float = 0.05) -> DataFrame:
    """Agreement, worst bias of a condition, and the verdict of the gate."""
    per = audited.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(human) == F.col(judge)).cast("int")).alias("same"), (F.avg(judge) - F.avg(human)).alias("bias"))
    one = per.agg(F.sum("n").alias("audited"), (F.sum("same") / F.sum("n")).alias("agreement"), F.max(F.abs("bias")).alias("worst_bias"))
    verdict = F.when((F.col("agreement") < hard) | (F.col("worst_bias") > bias_limit), "HARD_STOP").when(F.col("agreement") >= unconditional, "UNCONDITIONAL_PASS").otherwise("PASS_WITH_SENSITIVITY")
    return one.withColumn("gate", verdict)


def pair_transition_audit(audited: DataFrame, unit: list[str], role: str, human: str, judge: str) -> DataFrame:
    """Complete control-target cases whose transition differs between judge and human: both codes, and whether they agree."""
    pick = lambda r, c: F.max(F.when(F.col(role) == r, F.col(c)))
    wide = audited.groupBy(*unit).agg(*(pick(r, c).alias(f"{r}_{n}") for r in ("control", "target_delete") for c, n in ((human, "human"), (judge, "judge")))).dropna()
    code = lambda n: F.concat(*(F.when(F.col(f"{r}_{n}") == 1, "C").otherwise("W") for r in ("control", "target_delete")))
    return wide.select(*unit, code("human").alias("human_transition"), code("judge").alias("judge_transition"), (code("human") == code("judge")).alias("agrees"))


def select_disagreements(audited: DataFrame, human: str, judge: str, blinded: list[str]) -> DataFrame:
    return audited.where(F.col(human) != F.col(judge)).select(*blinded)


def abnormal_flags(runs: DataFrame, answer: str, cost: str) -> DataFrame:
    """Reasons that make a run worth a look (array), and the first as its category; long means above the third quartile by nearest rank."""
    q = order_statistics(runs, [], cost, q=("disc", 0.75))
    rows = runs.crossJoin(F.broadcast(q))  # one row
    reasons = F.array_compact(F.array(
        F.when(F.col("status") != "completed", F.concat(F.lit("status:"), "status")), F.when(F.trim(F.coalesce(F.col(answer), F.lit(""))) == "", "missing_answer"), F.when(F.col(cost) > F.col("q"), "long"),
    ))
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0).withColumn("category", F.element_at("reasons", 1)).drop("q")
