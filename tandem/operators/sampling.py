"""Deterministic sampling, splitting and assignment: order by a stable hash, then count off.

Where only the first k rows of a stratum count, the filter stands right on the window's
rank, so that every task keeps its own first k before rows are shuffled. Where all rows
are ranked, `running_sums` does it without a stratum in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.exprs import blind_id, hash_mod, stable_hash


def hash_order(unit: str, seed: int) -> list[Column]:
    return [stable_hash(unit, seed), F.col(unit)]


def nth_in(df: DataFrame, by: list[str], unit: str, seed: int, first: list[Column] | None = None) -> Column:
    """Position in its stratum, by `first` and then hash."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*(first or []), *hash_order(unit, seed)))


def balanced_cohort(df: DataFrame, strata: list[str], fingerprint: Column, quota: int, unit: str = "unit_id", seed: int = 20260722) -> DataFrame:
    """One unit per content fingerprint (least hash), then at most `quota` per stratum, with a display order."""
    lone = df.withColumn("_f", fingerprint).withColumn("_n", F.row_number().over(Window.partitionBy("_f").orderBy(*hash_order(unit, seed)))).where("_n = 1")
    picked = lone.withColumn("stratum_order", nth_in(lone, strata, unit, seed + 1)).where(F.col("stratum_order") <= quota)
    return picked.drop("_f", "_n")


def quota_of(n_bins: int, size: int) -> list[int]:
    """`size` over bins; the remainder goes to the first ones."""
    return [size // n_bins + (i < size % n_bins) for i in range(n_bins)]


def quota_sample(df: DataFrame, bin_: str, bins: list[str], size: int, eligible: str, unit: str = "unit_id", seed: int = 20260722, by: str | None = None) -> DataFrame:
    """Per bin its quota, eligible units first, by hash; what bins leave open is filled from all leftovers. With `by`, for each of its values."""
    quota = F.create_map(*(x for b, q in zip(bins, quota_of(len(bins), size), strict=True) for x in (F.lit(b), F.lit(q))))
    group = [by] if by else []
    rows = df.where(F.col(bin_).isin(bins)).withColumn("_first", F.when(F.col(eligible) == 1, 0).otherwise(1))
    rows = rows.withColumn("_nth", nth_in(rows, [*group, bin_], unit, seed, [F.col("_first")])).withColumn("_in", F.col("_nth") <= F.element_at(quota, F.col(bin_)))
    # at most `size` rows of each bin can be needed: its quota and then leftovers
    rows = rows.where(F.col("_nth") <= size)
    order = F.row_number().over(Window.partitionBy(*(group or [F.lit(1)])).orderBy(F.when(F.col("_in"), 0).otherwise(1), "_first", *hash_order(unit, seed)))
    return rows.withColumn("pick_order", order).where(F.col("pick_order") <= size).withColumn("picked_by", F.when(F.col("_in"), "quota").otherwise("fill")).drop("_first", "_nth", "_in")


def disjoint_groups(rules: dict[str, Column], otherwise: str | None = None) -> Column:
    """The first rule that holds."""
    out = reduce(lambda acc, r: acc.when(r[1], r[0]), list(rules.items())[1:], F.when(next(iter(rules.values())), next(iter(rules))))
    return out.otherwise(otherwise) if otherwise else out


def capped_quota_sample(df: DataFrame, key: str, cap: int, bin_: str, bins: list[str], size: int, eligible: str, unit: str = "unit_id", seed: int = 20260722) -> DataFrame:
    """At most `cap` units of a problem key (least hashes), then a quota sample."""
    capped = df.withColumn("_k", nth_in(df, [key], unit, seed)).where(F.col("_k") <= cap).drop("_k")
    return quota_sample(capped, bin_, bins, size, eligible, unit, seed)


def round_robin_balanced(df: DataFrame, stratum: str, size: int, output: str, unit: str = "unit_id", seed: int = 20260722) -> DataFrame:
    """One output per stratum and round; each unit's first output comes before any second one."""
    rows = df.withColumn("_rep", F.row_number().over(Window.partitionBy(unit).orderBy(*hash_order(output, seed))))
    rows = rows.withColumn("round", F.row_number().over(Window.partitionBy(stratum).orderBy(F.when(F.col("_rep") == 1, 0).otherwise(1), *hash_order(output, seed))))
    rows = rows.where(F.col("round") <= size)  # no stratum can give more
    top = rows.withColumn("_s", stable_hash(stratum, seed)).orderBy("round", "_s", *hash_order(output, seed)).limit(size)
    return top.drop("_rep", "_s")


def priority_audit_sample(df: DataFrame, strata: list[tuple[str, Column, int]], balance: str, output: str, unit: str = "unit_id", seed: int = 20260722) -> DataFrame:
    """Strata in order of priority, each from what earlier ones left: a row belongs to the first stratum that holds; `size` of each, balanced."""
    name = disjoint_groups({n: c for n, c, _ in strata})
    rows = df.withColumn("audit_stratum", name).where(F.col("audit_stratum").isNotNull())
    parts = [round_robin_balanced(rows.where(F.col("audit_stratum") == n), balance, size, output, unit, seed) for n, _, size in strata]
    return reduce(DataFrame.unionByName, parts)


def proportional_sample(df: DataFrame, group: str, n: int, unit: str = "unit_id", seed: int = 20260722) -> DataFrame:
    """round(n * share) units of each group, by hash."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    quota = sizes.withColumn("quota", F.round(F.col("_n") * n / F.sum("_n").over(Window.partitionBy(F.lit(1)))).cast("long")).drop("_n")
    rows = df.join(quota, group)
    return rows.withColumn("pick_order", nth_in(rows, [group], unit, seed)).where(F.col("pick_order") <= n).where("pick_order <= quota")  # no group's quota is above n


def ranked_in(df: DataFrame, by: list[str], unit: str, seed: int) -> DataFrame:
    """`df` with rank and rank_total in each stratum, by hash: range-sorted, no stratum in one task."""
    from tandem.operators.ranking import running_sums

    return running_sums(df.withColumn("_h", stable_hash(unit, seed)), by, ["_h", unit], {}, totals=True).drop("_h")


def assign_raters(df: DataFrame, stratum: str, raters: list[str], unit: str = "unit_id", seed: int = 20260722) -> DataFrame:
    """Two halves of each stratum with two raters each: (unit, half, rater). Four raters: first two for half 1, which gets an odd unit."""
    half = F.when(2 * F.col("rank") <= F.col("rank_total") + 1, 1).otherwise(2)
    pairs = F.when(F.col("half") == 1, F.array(F.lit(raters[0]), F.lit(raters[1]))).otherwise(F.array(F.lit(raters[2]), F.lit(raters[3])))
    return ranked_in(df, [stratum], unit, seed).withColumn("half", half).withColumn("rater", F.explode(pairs)).drop("rank", "rank_total")


def deal_equally(df: DataFrame, group: str, raters: list[str], unit: str = "unit_id", seed: int = 20260722) -> DataFrame:
    """Units of each group dealt in turn, so that every rater gets an equal share of each."""
    turn = (F.pmod(F.col("rank") - 1, F.lit(len(raters))) + 1).cast("int")
    return ranked_in(df, [group], unit, seed).withColumn("rater", F.element_at(F.array(*map(F.lit, raters)), turn)).drop("rank", "rank_total")


def blind_order(df: DataFrame, hidden: list[str], unit: str = "unit_id", seed: int = 20260722, dual_share: float = 0.2) -> DataFrame:
    """Hash order with blind ids, hidden columns dropped, and a subset marked for dual coding. The order is a hash prefix, so no global sort is needed."""
    h = stable_hash(unit, seed)
    out = df.withColumns({"blind_id": blind_id(unit, seed), "blind_key": h, "dual_coded": hash_mod(h, 1000) < int(dual_share * 1000)})
    return out.drop(*hidden)


def fold_shares(sizes: dict[int, int], k: int) -> list[tuple[int, int, int, int]]:
    """(size, fold, first, last): which of the groups of each size, counted from 1, go to which fold.

    Larger groups first, each to the emptiest fold (the first of them on ties); of equal groups only the number per
    fold matters, so it is found by arithmetic: m groups of size s fill the m lowest of the levels load + j * s.
    """
    load, out = [0] * k, []
    for size in sorted(sizes, reverse=True):
        m = sizes[size]
        lo, hi = min(load), max(load) + size * (m // k + 2)
        below = lambda level, s=size: sum(max(0, -(-(level - x) // s)) for x in load)  # levels under `level`
        while lo < hi:  # the highest level with at most m levels under it
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if below(mid) <= m else (lo, mid - 1)
        take = [max(0, -(-(lo - x) // size)) for x in load]
        for f in range(k):
            if sum(take) < m and load[f] + take[f] * size == lo:
                take[f] += 1
        first = 1
        for f in range(k):
            if take[f]:
                out.append((size, f, first, first + take[f] - 1))
            first += take[f]
            load[f] += take[f] * size
    return out


def grouped_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 20260722) -> DataFrame:
    """group, group_size, fold: greedy over the histogram of group sizes, whatever the number of groups; groups of one size are dealt in hash order."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    histogram = {r["group_size"]: r["n"] for r in sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n")).collect()}  # n rows have fewer than sqrt(2 * n) different sizes
    plan = df.sparkSession.createDataFrame(fold_shares(histogram, k), "group_size long, fold int, first long, last long")
    ranked = ranked_in(sizes, ["group_size"], group, seed)
    return ranked.join(F.broadcast(plan), "group_size").where(F.col("rank").between(F.col("first"), F.col("last"))).select(group, "group_size", "fold")


def hash_split(df: DataFrame, key: str, mod: int, cut: int, seed: int | str, name: str = "split", parts: tuple[str, str] = ("calibration", "test")) -> DataFrame:
    return df.withColumn(name, F.when(hash_mod(stable_hash(key, seed), mod) < cut, parts[0]).otherwise(parts[1]))


def package_benchmark(df: DataFrame, key: str, public: list[str], hidden: list[str], seed: int = 20260722) -> dict[str, DataFrame]:
    """dev (everything), test_public (inputs) and test_hidden (key and answers) of one split by key."""
    marked = hash_split(df, key, 10, 7, seed, "part", ("dev", "test"))
    dev, test = marked.where("part = 'dev'").drop("part"), marked.where("part = 'test'").drop("part")
    return {"dev": dev, "test_public": test.select(*public), "test_hidden": test.select(*hidden)}


def union_strata(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("stratum", F.lit(n)) for n, df in parts.items()])


def intersect_covered(df: DataFrame, unit: str, member: str, n: int) -> DataFrame:
    """Units that all n members cover."""
    return df.groupBy(unit).agg(F.countDistinct(member).alias("_n")).where(F.col("_n") == n).select(unit)


def except_ids(df: DataFrame, chosen: DataFrame, unit: str) -> DataFrame:
    return df.select(unit).join(chosen.select(unit), unit, "left_anti").distinct()
