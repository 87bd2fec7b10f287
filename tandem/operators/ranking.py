"""Global ranks, running sums, curves and ranking metrics.

Nothing here runs a window over a whole table. `running_sums` range-partitions on the
sort key, sums inside partitions and adds the totals of earlier ones; equal keys of a
metric are grouped first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.exprs import stable_hash
from tandem.functions.keys import null_safe_join
from tandem.functions.storage import cut
from tandem.operators.inference import bootstrap_ci, lcb_of
from tandem.operators.prefixes import cluster_states, order_blocks, prefix_bounds, view_totals


BROADCAST_GROUPS = 50_000


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column | str], totals: bool = False) -> DataFrame:
    """`df` with rank (from 1) and inclusive running sums inside each `by` group; with `totals`, each sum's total over the group as `<name>_total`.

    `order` names columns, '-' in front for descending, and must be total. The rows are dealt out once, by ranges;
    tasks sum inside their sorted partition, and the result is written, because range bounds are sampled. Offsets are
    one row per group and partition, so a common group is no common key.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    sums = {"rank": F.lit(1).cast("long")} | sums
    own = [n for n in df.columns if n not in sums]
    inner = [f"_x_{n}" for n in sums]
    rows = df.select(*own, *(F.col(n).alias(f"_k_{n}") for n in df.columns if n in sums), *(col(c).alias(x) for x, c in zip(inner, sums.values(), strict=True)))
    kept = [n if n in own else f"_k_{n}" for n in df.columns]
    kinds = rows.select(*(F.sum(x).alias(x) for x in inner)).schema
    rows = rows.withColumns({x: F.col(x).cast(kinds[x].dataType) for x in inner})
    named = {n: k for n, k in zip(df.columns, kept, strict=True)}
    keys = [F.desc(named[o[1:]]) if o.startswith("-") else F.asc(named[o]) for o in order]
    groups = [named[b] for b in by]
    ranged = rows.repartitionByRange(*groups, *keys).withColumn("_p", F.spark_partition_id()).sortWithinPartitions(*groups, *keys)
    local = cut(ranged.mapInArrow(summing(groups, inner), ranged.schema))
    last = local.groupBy(*groups, "_p").agg(*(F.max_by(x, "_x_rank").alias(x) for x in inner))
    before, whole = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = cut(last.select(*groups, "_p", *(F.sum(x).over(before).alias(f"_f{x}") for x in inner), *(F.sum(x).over(whole).alias(f"_t{x}") for x in inner if totals)))
    join = null_safe_broadcast if offsets.count() <= BROADCAST_GROUPS else null_safe_join
    out = join(local, offsets, [*groups, "_p"])
    return out.select(*(F.col(k).alias(n) for n, k in named.items()), *(F.coalesce(F.col(x) + F.col(f"_f{x}"), x, f"_f{x}").alias(n) for n, x in zip(sums, inner, strict=True)), *(F.col(f"_t{x}").alias(f"{n}_total") for n, x in zip(sums, inner, strict=True) if totals))


def summing(by: list[str], columns: list[str]):
    """A function of Arrow batches that are sorted by `by`: each of `columns` becomes its running sum inside its group; NULLs add nothing, before the first value the sum is NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}  # the group at the end of the batch before, and its sums
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = last is None
            for b in by:
                c = batch.column(b)
                earlier = pa.concat_arrays([last[b], c.slice(0, len(c) - 1)]) if last else pa.concat_arrays([c.slice(0, 1), c.slice(0, len(c) - 1)])
                same = pc.or_(pc.fill_null(pc.equal(c, earlier), False), pc.and_(pc.is_null(c), pc.is_null(earlier)))
                if pa.types.is_floating(c.type):
                    same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(c), pc.is_nan(earlier)), False))
                new |= ~same.to_numpy(zero_copy_only=False)
            group = np.cumsum(new)
            last = {b: pa.concat_arrays([batch.column(b).slice(batch.num_rows - 1)]) for b in by}
            out = {n: batch.column(n) for n in batch.schema.names}
            for x in columns:
                c = out[x]
                v, there = pc.fill_null(c, 0).to_numpy(), pc.is_valid(c).to_numpy(zero_copy_only=False)
                sums, seen = _cumulated(v, there, group)
                if x in held and not new[0]:
                    at = group == group[0]
                    sums[at] += held[x][0]
                    seen[at] += held[x][1]
                held[x] = (sums[-1], seen[-1])
                out[x] = pa.array(sums, c.type, mask=seen == 0)
            yield pa.record_batch(list(out.values()), names=list(out))

    return run


def _cumulated(v: np.ndarray, there: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and counts of values inside runs of equal `group`."""
    sums, seen = v.copy(), there.astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(v)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        np.cumsum(sums[lo:hi], out=sums[lo:hi])
        np.cumsum(seen[lo:hi], out=seen[lo:hi])
    return sums, seen


def order_statistics(df: DataFrame, by: list[str], value: str | Column, accuracy: int = 2000, written: bool = False, **wanted: tuple[str, float]) -> DataFrame:
    """Exact quantiles per group, by narrowing: a mergeable sketch gives two values around each wanted rank, one pass counts what lies below and keeps what lies between, and only that is ranked.

    `wanted` names results as ("cont", share), linear between ranks, or ("disc", share), the nearest rank. NULLs left
    out; a NULL group is a group. `written` says that `df` is cheap to read again; else its rows are written first. The sketch's ranks are wrong by at most rows / `accuracy`, so at most some 4 /
    `accuracy` of a group's distinct values are written per result.
    """
    rows = df.select(*by, (F.col(value) if isinstance(value, str) else value).alias("_v")).where("_v is not null")
    rows = rows if written else cut(rows)  # read three times
    near = [min(1.0, max(0.0, s + d)) for _, s in wanted.values() for d in (-2 / accuracy, 2 / accuracy)]
    bounds = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", near, accuracy).alias("_b"), F.min("_v").alias("_min"), F.max("_v").alias("_max")))
    few = bounds.count() <= BROADCAST_GROUPS
    limits = bounds.select(*by, *(F.when(F.lit(near[2 * i + side]) == side, F.col(("_min", "_max")[side])).otherwise(F.col("_b")[2 * i + side]).alias(f"_{'lh'[side]}{i}") for i in range(len(wanted)) for side in (0, 1)))
    held = null_safe_broadcast(rows, limits, by) if few else null_safe_join(rows, limits, by)
    inside = F.explode(F.array_compact(F.array(*(F.when((F.col("_v") >= F.col(f"_l{i}")) & (F.col("_v") <= F.col(f"_h{i}")), F.lit(n)) for i, n in enumerate(wanted)))))
    narrow = held.select(*by, "_v", inside.alias("_name")).groupBy(*by, "_name", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(narrow, [*by, "_name"], ["_v"], {"to": "_c"})
    less, more = (lambda i: F.col("_v") < F.col(f"_l{i}")), (lambda i: F.col("_v") > F.col(f"_h{i}"))
    around = held.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *(F.count(F.when(less(i), 1)).alias(f"_under_{n}") for i, n in enumerate(wanted)),
        *(F.max(F.when(less(i), F.col("_v"))).alias(f"_prev_{n}") for i, n in enumerate(wanted)), *(F.min(F.when(more(i), F.col("_v"))).alias(f"_next_{n}") for i, n in enumerate(wanted)),
    )
    n = F.col("_n")
    ranks, taken = {}, []
    for name, (kind, share) in wanted.items():
        place = (n - 1) * F.lit(float(share))
        ranks[name] = {"lo": F.greatest(F.lit(1), F.ceil(n * F.lit(float(share)) - 1e-9))} if kind == "disc" else {"lo": F.floor(place) + 1, "hi": F.least(F.floor(place) + 2, n), "part": place - F.floor(place)}
        own, to = F.col("_name") == name, F.col("to") + F.col(f"_under_{name}")
        taken += [F.max(F.when(own & (to >= r) & (to - F.col("_c") < r), F.col("_v"))).alias(f"_{k}_{name}") for k, r in ranks[name].items() if k != "part"]
        taken.append(F.sum(F.when(own, F.col("_c")).otherwise(0)).alias(f"_in_{name}"))
    found = null_safe_join(null_safe_join(ranked, around, by).groupBy(*by).agg(*taken), around, by)

    def at(name: str, side: str) -> Column:
        """The value of a rank: among those kept, or the neighbour below or above them."""
        rank, under = ranks[name][side], F.col(f"_under_{name}")
        near = F.when(rank == under, F.col(f"_prev_{name}")).when(rank == under + F.col(f"_in_{name}") + 1, F.col(f"_next_{name}"))
        return F.coalesce(F.col(f"_{side}_{name}"), near)

    def result(name: str, kind: str) -> Column:
        low = at(name, "lo")
        return (low if kind == "disc" else low.cast("double") + (at(name, "hi").cast("double") - low.cast("double")) * ranks[name]["part"]).alias(name)

    return found.select(*by, *(result(name, kind) for name, (kind, _) in wanted.items()))


def null_safe_broadcast(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """`rows` with their group's columns, NULL equal to NULL; `groups` has been counted."""
    named = groups.select(*(F.col(b).alias(f"_g_{b}") for b in by), *(c for c in groups.columns if c not in by))
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    return (rows.join(F.broadcast(named), on) if by else rows.crossJoin(F.broadcast(named))).drop(*(f"_g_{b}" for b in by))


def with_groups(summary: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """`summary` with the columns of `more`, both one row per group; NULL is a group."""
    return null_safe_join(summary, more, by, "left")


def deterministic_rank(df: DataFrame, by: list[str], tier: Column, score: Column, unit: str, seed: int = 20260722) -> DataFrame:
    """rank inside each policy: by tier, then the greatest score, then a stable hash of the unit."""
    return running_sums(df.withColumns({"_tier": tier, "_score": score, "_hash": stable_hash(unit, seed)}), by, ["_tier", "-_score", "_hash", unit], {}).drop("_tier", "_score", "_hash")


def policy_rows(units: DataFrame, policies: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Units once per policy, with the policy's tier and score: the grouping key of every curve."""
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), t.cast("double").alias("tier"), s.cast("double").alias("policy_score")) for n, (t, s) in policies.items())))
    return units.select("*", cells.alias("x")).select("*", "x.*").drop("x")


def rank_tertiles(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """Tertile 0, 1, 2 of floor(n * (rank - 1) / rows)."""
    ranked = running_sums(df, [], order, {})
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(total)).withColumn("tertile", F.floor((F.col("rank") - 1) * n / F.col("_n")).cast("int")).drop("_n", "rank")  # one row


def top_k_per_family(df: DataFrame, families: dict[str, tuple[Column, list[Column]]], k: int, unit: str, seed: int = 20260722) -> DataFrame:
    """The first k rows of each family (predicate, ordering), with their rank; at most k rows of a family leave a task."""
    parts = []
    for name, (test, order) in families.items():
        top = df.where(test).withColumn("_h", stable_hash(unit, seed)).orderBy(*order, "_h", unit).limit(k)
        parts.append(top.withColumn("family", F.lit(name)).withColumn("family_rank", F.row_number().over(Window.partitionBy("family").orderBy(*order, "_h", unit))).drop("_h"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_scores(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """Per distinct score: positives and negatives."""
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Area under the ROC curve with average ranks for ties; NULL with one class only."""
    g = running_sums(distinct_scores(df, by, score, y), by, [score], {"neg_to": "neg"})
    won = F.col("pos") * (F.col("neg_to") - F.col("neg") / 2)
    out = g.groupBy(*by).agg(F.sum(won).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*by, F.col("p").alias("positives"), F.col("n").alias("negatives"), F.try_divide(F.col("won"), F.nullif((F.col("p") * F.col("n")).cast("double"), F.lit(0.0))).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], score: str = "score", y: str = "y", tie: str = "unit_id") -> DataFrame:
    """Mean precision at the positives, by descending score; ties go by the `tie` column. NULL without positives."""
    g = running_sums(df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(*by, tie, score, F.col(y).cast("long").alias("_y")), by, ["-" + score, tie], {"tp": "_y"})
    hit = F.when(F.col("_y") == 1, F.col("tp") / F.col("rank"))
    return g.groupBy(*by).agg(F.avg(hit).alias("average_precision"), F.avg("_y").alias("base_rate"))


def calibration(df: DataFrame, by: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Brier score, expected calibration error over equal bins (1.0 in the last), and specificity at 0.5."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("se"), F.sum(F.when((F.col(y) == 0) & (F.col(p) < 0.5), 1).otherwise(0)).alias("tn"), F.sum((F.col(y) == 0).cast("int")).alias("neg"))
    return per.groupBy(*by).agg((F.sum("se") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"), F.try_divide(F.sum("tn").cast("double"), F.nullif(F.sum("neg"), F.lit(0))).alias("specificity"))


def coverage_at_precision(df: DataFrame, by: list[str], least: float, score: str = "score", y: str = "y", tie: str = "unit_id") -> DataFrame:
    """Largest share of rows, by descending score, whose running precision is at least `least`; 0 if none."""
    g = running_sums(df.select(*by, tie, score, F.col(y).cast("long").alias("_y")), by, ["-" + score, tie], {"tp": "_y"})
    ok = F.when(F.col("tp") / F.col("rank") >= least, F.col("rank"))
    return g.groupBy(*by).agg((F.coalesce(F.max(ok), F.lit(0)) / F.count(F.lit(1))).alias("coverage"))


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Average rank of each distinct value."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    g = running_sums(g, by, [value], {"_to": "_n"})
    return g.select(*by, value, (F.col("_to") - (F.col("_n") - 1) / 2).alias(f"{value}_rank"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = null_safe_join(null_safe_join(rows, average_ranks(rows, by, x), [*by, x]), average_ranks(rows, by, y), [*by, y])
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(f"{x}_rank", f"{y}_rank").alias("spearman"))


def ks_statistic(df: DataFrame, side: str, value: str) -> DataFrame:
    """Greatest difference of the two empirical distribution functions."""
    g = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.sum((F.col(side) == 1).cast("long")).alias("a"), F.sum((F.col(side) == 0).cast("long")).alias("b"))
    g = running_sums(g, [], ["_v"], {"a_to": "a", "b_to": "b"})
    total = g.agg(F.sum("a").alias("n_1"), F.sum("b").alias("n_0"))
    return g.crossJoin(F.broadcast(total)).groupBy("n_1", "n_0").agg(F.max(F.abs(F.col("a_to") / F.col("n_1") - F.col("b_to") / F.col("n_0"))).alias("ks"))  # one row


def grid_of(n: Column, step: int) -> Column:
    """Whether a rank lies on the grid: multiples of `step`, and the last."""
    return (F.col("rank") % step == 0) | (F.col("rank") == n)


def risk_coverage_curve(ranked: DataFrame, step: int = 10) -> DataFrame:
    """Per policy and coverage k: net change, mean effect, run danger and benefit rates, danger among correct runs, unit danger rate.

    Input: policy, tier, policy_score, unit_id, effect, runs, danger, benefit, control_correct.
    """
    sums = {"effect_sum": "effect", "run_sum": "runs", "danger_sum": "danger", "benefit_sum": "benefit", "correct_sum": "control_correct", "danger_units": F.when(F.col("effect") < 0, 1).otherwise(0)}
    g = running_sums(ranked.withColumn("_h", stable_hash("unit_id", 20260722)), ["policy"], ["tier", "-policy_score", "_h", "unit_id"], sums)
    total = ranked.groupBy("policy").agg(F.count(F.lit(1)).alias("n"))
    g = g.join(F.broadcast(total), "policy").where(grid_of(F.col("n"), step))  # one row per policy
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b), F.lit(0)))
    return g.select(
        "policy", F.col("rank").alias("k"), (F.col("rank") / F.col("n")).alias("coverage"), (F.col("effect_sum") / F.col("n")).alias("net_change"), (F.col("effect_sum") / F.col("rank")).alias("mean_effect"),
        d("danger_sum", "run_sum").alias("danger_rate"), d("benefit_sum", "run_sum").alias("benefit_rate"), d("danger_sum", "correct_sum").alias("danger_given_correct"), d("danger_units", "rank").alias("unit_danger_rate"),
    )


def operating_points(ranked: DataFrame, natural: Column, coverages: list[float], cluster: str = "cluster_id", reps: int = 1000, seed: int = 20260722) -> DataFrame:
    """policy, point, k, n, clusters, estimate, ci_lower, ci_upper: net change of the whole cohort when the first k units are taken, with its bootstrap interval.

    Points are the policy's natural set, as many units as `natural` holds for, and fixed coverages. Input as for
    `risk_coverage_curve`, with the cluster.
    """
    rows = ranked.withColumn("_h", stable_hash("unit_id", 20260722)).withColumn("_natural", F.when(natural, 1).otherwise(0))
    g = running_sums(rows, ["policy"], ["tier", "-policy_score", "_h", "unit_id"], {"_set": "_natural"}, totals=True)
    at = [F.struct(F.lit("natural").alias("point"), F.col("_set_total").cast("long").alias("k"))]
    at += [F.struct(F.lit(f"{c:g}").alias("point"), F.greatest(F.lit(1), F.round(F.col("rank_total") * F.lit(float(c)))).cast("long").alias("k")) for c in coverages]
    taken = g.select("policy", cluster, "effect", "rank", F.explode(F.array(*at)).alias("x")).select("policy", cluster, "effect", "rank", "x.*")
    num = F.when(F.col("rank") <= F.col("k"), F.col("effect")).otherwise(0.0)
    return bootstrap_ci(taken, ["policy", "point", "k"], cluster, num, F.lit(1), reps, seed)


def random_policy_expectation(units: DataFrame, grid: list[float]) -> DataFrame:
    """Closed-form curve of a uniform choice at given coverages."""
    t = units.agg(F.count(F.lit(1)).alias("n"), F.avg("effect").alias("mean_effect"), F.sum("danger").alias("d"), F.sum("runs").alias("r"))
    c = F.explode(F.array(*map(F.lit, grid)))
    return t.select(c.alias("coverage"), "mean_effect", "d", "r").select("coverage", (F.col("coverage") * F.col("mean_effect")).alias("net_change"), "mean_effect", (F.col("d") / F.col("r")).alias("danger_rate"))


def model_risk_coverage(df: DataFrame, by: list[str], score: str, y: str, coverages: list[float], ascending: bool = True, tie: str = "unit_id") -> DataFrame:
    """Rate of `y` among the selected share, lowest (or highest) scores first."""
    g = running_sums(df.select(*by, tie, score, F.col(y).cast("long").alias("_y")), by, [score if ascending else "-" + score, tie], {"ys": "_y"})
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("coverage", F.explode(F.array(*map(F.lit, coverages)))).withColumn("k", F.greatest(F.lit(1), F.round(F.col("n") * F.col("coverage"))).cast("long"))
    # the rank is part of the key, so that a common group is no common key
    return null_safe_join(g, total.withColumn("rank", F.col("k")), [*by, "rank"]).select(*by, "coverage", "k", (F.col("ys") / F.col("k")).alias("rate"))


def max_prefix_under_budget(curve: DataFrame, rate: str, budgets: list[float]) -> DataFrame:
    """Per policy and budget, the largest k whose rate is within it, with the curve's values there; k 0 if none."""
    b = curve.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    best = b.groupBy("policy", "budget").agg(F.max(F.when(F.col(rate) <= F.col("budget"), F.struct("k", "net_change", rate))).alias("x"))
    return best.select("policy", "budget", F.coalesce("x.k", F.lit(0)).alias("k"), F.coalesce("x.net_change", F.lit(0.0)).alias("net_change"), F.col(f"x.{rate}").alias("rate"))


def certified_prefixes(ranked: DataFrame, cluster: str = "cluster_id", step: int = 10, weights: dict[str, str] | None = None) -> DataFrame:
    """The cluster-robust lower bound of the weighted mean effect for every prefix of every policy, over one copy of the ordered rows.

    `weights` {regime: column} bounds one ranking under several weightings, with `regime` in the result.
    """
    named = weights or {"": "w"}
    rows = ranked.where("policy is not null").withColumn("_h", F.unhex(stable_hash("unit_id", 20260722)))
    blocks = order_blocks(rows, "policy", ["tier", "-policy_score", "_h", "unit_id"], cluster, "effect", list(named.values()))
    states = cluster_states(blocks, "policy", cluster, len(named), F.array(F.lit(0)))
    bounds = bounds_of(prefix_bounds(blocks, states, view_totals(states, "policy", len(named)), "policy", len(named), step), list(named))
    return bounds.select("policy", "k", "clusters", *(["regime"] if weights else []), "estimate", "lcb")


def bounds_of(sums: DataFrame, regimes: list[str]) -> DataFrame:
    """Rows of `prefix_bounds` once per regime, with clusters, estimate and lcb."""
    of = lambda i: (F.try_divide(F.col(f"sa{i}"), F.nullif(F.col(f"sb{i}"), F.lit(0.0))).alias("estimate"), lcb_of("m", *(f"{x}{i}" for x in ("sa", "sb", "saa", "sab", "sbb"))).alias("lcb"))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("regime"), *of(i)) for i, r in enumerate(regimes))))
    return sums.select(sums.columns[0], "view", "k", "total", F.col("m").alias("clusters"), each.alias("x")).select(sums.columns[0], "view", "k", "total", "clusters", "x.*")


def lcb_certified_prefix(ranked: DataFrame, budgets: list[float], cluster: str = "cluster_id", step: int = 10) -> DataFrame:
    """Per policy and harm budget, the largest prefix whose lower bound is at least -budget."""
    p = certified_prefixes(ranked, cluster, step).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    best = p.groupBy("policy", "budget").agg(F.max(F.when(F.col("lcb") >= -F.col("budget"), F.struct("k", "estimate", "lcb"))).alias("x"))
    return best.select("policy", "budget", F.coalesce("x.k", F.lit(0)).alias("k"), F.col("x.estimate").alias("estimate"), F.col("x.lcb").alias("lcb"))


def log_factorial(n: Column) -> Column:
    """ln n!: exact logarithms up to 15, Stirling's series beyond (error below 1e-13)."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n < 16, F.get(F.array(*(F.lit(math.lgamma(k + 1)) for k in range(16))), n.cast("int"))).otherwise(series)


def binomial_mass(n: Column, p: Column, k: Column) -> Column:
    """P(k of n) for a chance p; 0 * ln 0 is 0."""
    times = lambda m, q: F.when(m == 0, F.lit(0.0)).otherwise(m * F.log(q))
    inside = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + times(k, p) + times(n - k, 1 - p))
    return F.when(p <= 0, (k == 0).cast("double")).when(p >= 1, (k == n).cast("double")).otherwise(inside)


def null_floors(cells: DataFrame, thresholds: dict[str, tuple[float, bool]]) -> DataFrame:
    """Adds to rows with c, t, p a column per threshold (limit, strict): P(delta < limit), or <= if not strict, where delta = j/t - i/c for two independent binomials j of t and i of c with a common p.

    For each outcome i the j that count are all up to a border, so the distribution function of j is read there: c + t
    rows per distinct (c, t, p), however large the counts. Masses and their running sums are written once per distinct
    (count, p).
    """
    keys = cut(cells.select(F.col("c").cast("long").alias("c"), F.col("t").cast("long").alias("t"), F.col("p").cast("double").alias("p")).where("c > 0 and t > 0 and p is not null").distinct())
    counts = keys.select(F.col("c").alias("m"), "p").unionByName(keys.select(F.col("t").alias("m"), "p")).distinct()
    masses = counts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m")))).withColumn("mass", binomial_mass(F.col("m"), F.col("p"), F.col("k")))
    masses = cut(masses.withColumn("up_to", F.sum("mass").over(Window.partitionBy("m", "p").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))))
    delta = lambda j: j / F.col("t") - F.col("i") / F.col("c")

    def border(limit: float, strict: bool) -> Column:
        """The greatest j that counts, or -1."""
        hit = (lambda j: delta(j) < limit - 1e-12) if strict else (lambda j: delta(j) <= limit + 1e-12)
        near = F.floor(F.col("t") * (F.col("i") / F.col("c") + limit)).cast("long")
        return F.greatest(F.lit(-1), F.least(F.col("t"), F.when(hit(near + 1), near + 1).when(hit(near), near).otherwise(near - 1)))

    grid = keys.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c"))))
    asked = grid.withColumn("x", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), border(*x).alias("j")) for n, x in thresholds.items())))).select("c", "t", "p", "i", "x.*")
    own = masses.select(F.col("m").alias("c"), "p", F.col("k").alias("i"), "mass")
    other = masses.select(F.col("m").alias("t"), "p", F.col("k").alias("j"), "up_to")
    both = asked.join(own.hint("merge"), ["c", "p", "i"]).join(other.hint("merge"), ["t", "p", "j"], "left")
    floors = both.groupBy("c", "t", "p").agg(*(F.sum(F.when(F.col("name") == n, F.col("mass") * F.coalesce("up_to", F.lit(0.0))).otherwise(0.0)).alias(n) for n in thresholds))
    return cells.join(floors.hint("merge"), ["c", "t", "p"])


def null_floor(cells: DataFrame, threshold: float = 0.0, strict: bool = True) -> DataFrame:
    """P(delta < threshold), or <= if not strict, for two independent binomials with a common p: adds `floor` to rows with c, t, p."""
    return null_floors(cells, {"floor": (threshold, strict)})


def tail_risk(cells: DataFrame, by: list[str], severe: float = -0.5) -> DataFrame:
    """by, units, and for harm (effect < 0) and severe harm (effect <= `severe`) the observed share, the share that chance alone makes, and the excess over it, held at 0.

    cells: by, c, t, p (runs of both sides and their common rate), effect, w (weight).
    """
    rows = null_floors(cells, {"_floor": (0.0, True), "_severe": (severe, False)})
    mean = lambda x: F.try_divide(F.sum(F.col("w") * x), F.sum("w"))
    of = {"share_negative": (F.col("effect") < 0).cast("double"), "null_floor": F.col("_floor"), "share_severe": (F.col("effect") <= severe).cast("double"), "severe_floor": F.col("_severe")}
    out = rows.where("effect is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("units"), *(mean(x).alias(n) for n, x in of.items()))
    over = lambda a, b: F.greatest(F.lit(0.0), F.col(a) - F.col(b))
    return out.withColumns({"excess": over("share_negative", "null_floor"), "severe_excess": over("share_severe", "severe_floor")})
