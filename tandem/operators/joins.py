"""Joins over run tables: proven keys, pairs, defaults, matches inside a unit, overrides.

Range and non-equal conditions always stand beside an equal key (the unit or the
problem), so none becomes a nested loop over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.exprs import hash_unit, position_bin, stable_hash


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_inner_join(left: DataFrame, right: DataFrame, key: list[str], prove: bool = True) -> DataFrame:
    """Inner join after a proof that `key` is unique on both sides (an error otherwise)."""
    if prove:
        for name, side in (("left", left), ("right", right)):
            if bad := repeated_keys(side, key).head(1):
                raise ValueError(f"{name} side repeats key {bad[0].asDict()}")
    return left.join(right, key)


def pair_runs(runs: DataFrame, control: str = "control", target: str = "target_delete", on: tuple[str, ...] = ("unit_id", "run_id"), carry: tuple[str, ...] = ("cluster_id",), values: tuple[str, ...] = ("outcome", "cost", "status")) -> DataFrame:
    """Runs of two conditions side by side: control_*, target_*, danger and benefit flags."""
    side = lambda c, name, more: runs.where(F.col("condition") == c).select(*on, *more, *(F.col(v).alias(f"{name}_{v}") for v in values))
    both = side(control, "control", carry).join(side(target, "target", ()), list(on))
    c, t = F.col("control_outcome") == 1, F.col("target_outcome") == 1
    return both.withColumns({"danger": (c & ~t).cast("int"), "benefit": (~c & t).cast("int")})


def left_join_default(df: DataFrame, lookup: DataFrame, key: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join; each looked-up column has its own value where nothing was found (a literal or a Column)."""
    out = df.join(lookup.select(*key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in defaults.items()})


def semi_join_covered(df: DataFrame, *others: DataFrame, key: list[str]) -> DataFrame:
    for other in others:
        df = df.join(other.select(*key), key, "left_semi")
    return df


def anti_join_missing(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    return df.join(other.select(*key), key, "left_anti")


def key_set_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    left, right = a.select(*key).distinct().withColumn("in_a", F.lit(True)), b.select(*key).distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, key, "full_outer").where(F.col("in_a").isNull() | F.col("in_b").isNull())
    return both.select(*key, F.when(F.col("in_a").isNull(), "only_b").otherwise("only_a").alias("side"))


def _steps(traj: DataFrame, carry: list[str]) -> DataFrame:
    return traj.select("unit_id", "target_index", "n_steps", *carry, F.posexplode("steps").alias("step_index", "step"))


def match_by_length_ratio(traj: DataFrame, lo: float = 0.8, hi: float = 1.2, k: int = 2, seed: int = 20260722) -> DataFrame:
    """Other steps of the same trajectory whose length is within [lo, hi] of the target step's; at most k of them, by seeded hash.

    Input: unit_id, steps (array), n_steps, target_index. The target's length rides along with each
    step, so one pass over the exploded steps does it. Lengths are compared as integers.
    """
    length = F.char_length(F.trim("step"))
    target = F.char_length(F.trim(F.get("steps", F.col("target_index").cast("int"))))
    steps = traj.select("unit_id", "target_index", target.alias("target_length"), F.posexplode("steps").alias("step_index", "step")).withColumn("length", length)
    fits = (F.col("step_index") != F.col("target_index")) & (F.col("length") > 0) & (F.col("length") * 100 >= F.col("target_length") * int(lo * 100 + 0.5)) & (F.col("length") * 100 <= F.col("target_length") * int(hi * 100 + 0.5))
    drawn = Window.partitionBy("unit_id").orderBy(stable_hash(F.concat_ws("|", "unit_id", "step_index"), seed), "step_index")
    every = Window.partitionBy("unit_id")
    found = steps.where(fits).withColumns({"placebo_order": F.row_number().over(drawn), "candidates": F.count(F.lit(1)).over(every)})
    return found.where(F.col("placebo_order") <= k).select(
        "unit_id", "placebo_order", F.col("step_index").cast("long").alias("placebo_step_index"), F.col("length").cast("long").alias("placebo_length"),
        F.col("target_length").cast("long").alias("target_length"), (F.col("length") / F.col("target_length")).alias("length_ratio"), "candidates",
    )


def match_nearest_position(traj: DataFrame, k: int = 2) -> DataFrame:
    """Other steps of the target's third of the trajectory, nearest first, then by index; the first k."""
    steps = _steps(traj, []).where(F.col("step_index") != F.col("target_index"))
    steps = steps.where(position_bin("step_index", "n_steps", True) == position_bin("target_index", "n_steps", True))
    near = Window.partitionBy("unit_id").orderBy(F.abs(F.col("step_index") - F.col("target_index")), "step_index")
    return steps.withColumn("match_order", F.row_number().over(near)).where(F.col("match_order") <= k).select("unit_id", "target_index", F.col("step_index").cast("long").alias("match_index"), "match_order")


def discordant_triads(runs: DataFrame, seed: int = 20260722) -> DataFrame:
    """One target-placebo pair with different outcomes per unit, drawn by hash, with the target's control run.

    The draw has two stages, so that no pairs are built: the direction with the chance of its number of pairs, then a
    target run (one that has a control run of the same number) and a placebo run of the other outcome, each the least
    by hash. That is a uniform draw from all pairs, in one aggregate per unit.
    """
    of = lambda c: runs.where(F.col("condition") == c).select("unit_id", "run_id", "outcome")
    controls = of("control").withColumnRenamed("outcome", "control_outcome")
    sides = of("target_delete").join(controls, ["unit_id", "run_id"]).withColumn("side", F.lit("target")).unionByName(of("placebo_delete").withColumns({"control_outcome": F.lit(None).cast(controls.schema["control_outcome"].dataType), "side": F.lit("placebo")}))
    drawn = F.struct(stable_hash(F.concat_ws("|", "side", "unit_id", "run_id"), seed).alias("h"), "run_id", "control_outcome")
    cells = {f"{side}_{y}": (F.col("side") == side) & (F.col("outcome") == y) for side in ("target", "placebo") for y in (0, 1)}
    per = sides.groupBy("unit_id").agg(*(F.count(F.when(test, 1)).alias(f"n_{c}") for c, test in cells.items()), *(F.min(F.when(test, drawn)).alias(c) for c, test in cells.items()))
    right, wrong = F.col("n_target_1") * F.col("n_placebo_0"), F.col("n_target_0") * F.col("n_placebo_1")
    won = hash_unit(seed, F.lit("direction"), "unit_id") * (right + wrong) < right
    pick = lambda a, b: F.when(won, F.col(a)).otherwise(F.col(b))
    found = per.where(right + wrong > 0).select("unit_id", won.alias("won"), pick("target_1", "target_0").alias("t"), pick("placebo_0", "placebo_1").alias("p"))
    y = F.col("won").cast("int")
    return found.select(
        "unit_id", F.col("t.run_id").alias("target_run"), F.col("p.run_id").alias("placebo_run"), F.col("t.control_outcome").alias("control_outcome"), y.alias("target_outcome"), (1 - y).alias("placebo_outcome"),
        F.when(F.col("won"), "target_correct").otherwise("placebo_correct").alias("direction"),
    )


def own_control_join(runs: DataFrame, placebo: str = "placebo_delete", own: str = "placebo_control", on: tuple[str, ...] = ("unit_id", "placebo_index")) -> DataFrame:
    """Placebo rates against the rates of runs kept through the same cut-off: per unit and placebo index."""
    rate = lambda c, name: runs.where(F.col("condition") == c).groupBy(*on).agg(F.avg("outcome").alias(f"{name}_rate"), F.count(F.lit(1)).alias(f"{name}_runs"))
    both = rate(placebo, "placebo").join(rate(own, "own_control"), list(on))
    return both.withColumn("effect", F.col("placebo_rate") - F.col("own_control_rate"))


def fallback_match(wanted: DataFrame, records: DataFrame, strict: bool = False) -> DataFrame:
    """For each wanted (unit_id, problem, text, declared_index): the record (record_id, problem, steps) with the text at that index, else the first with it anywhere.

    matched index, fallback flag; unmatched units have NULLs, or are an error if `strict`. The records' steps are an
    inverted index of two levels, each with one row per key: (problem, text, position) and (problem, text), the text as
    its sha256, with the first record. Wanted rows look up both by equality, so none meets more than two.
    """
    steps = records.select("problem", "record_id", F.posexplode("steps").alias("at", "step")).select("problem", F.sha2("step", 256).alias("text_key"), F.col("at").cast("long").alias("at"), "record_id")
    placed = steps.groupBy("problem", "text_key", "at").agg(F.min("record_id").alias("record_id"))
    exact = placed.select("problem", "text_key", F.col("at").alias("declared"), F.col("record_id").alias("exact_record"))
    anywhere = placed.groupBy("problem", "text_key").agg(F.min(F.struct("record_id", "at")).alias("other"))
    keyed = wanted.select("unit_id", "problem", F.sha2("text", 256).alias("text_key"), F.col("declared_index").cast("long").alias("declared"))
    both = keyed.join(exact.hint("merge"), ["problem", "text_key", "declared"], "left").join(anywhere.hint("merge"), ["problem", "text_key"], "left")
    hit = F.col("exact_record").isNotNull()
    record = F.coalesce("exact_record", "other.record_id")
    if strict:
        record = F.when(record.isNull(), F.raise_error(F.concat(F.lit("unmatched unit "), F.col("unit_id").cast("string"))).cast(records.schema["record_id"].dataType)).otherwise(record)
    return both.select("unit_id", record.alias("record_id"), F.when(hit, F.col("declared")).otherwise(F.col("other.at")).alias("matched_index"), F.when(record.isNotNull(), ~hit).alias("index_fallback_used"))


def prioritised_lookup(wanted: DataFrame, first: DataFrame, siblings: DataFrame) -> DataFrame:
    """answer from `first` (key, answer), else the first correct sibling's (key, sibling_order, answer), else missing, with its source."""
    sib = siblings.groupBy("key").agg(F.min_by("answer", "sibling_order").alias("sibling_answer"))
    both = wanted.join(first.withColumnRenamed("answer", "dataset_answer"), "key", "left").join(sib, "key", "left")
    source = F.when(F.col("dataset_answer").isNotNull(), "dataset").when(F.col("sibling_answer").isNotNull(), "sibling").otherwise("missing")
    return both.select("key", F.coalesce("dataset_answer", "sibling_answer").alias("answer"), source.alias("source"))


def index_lookup(units: DataFrame, records: DataFrame) -> DataFrame:
    """The step text at every listed index: units (unit_id, record_id, indices), records (record_id, steps). NULL out of range."""
    listed = units.select("unit_id", "record_id", F.posexplode("indices").alias("nth", "step_index"))
    return listed.join(records.hint("merge"), "record_id").select("unit_id", F.col("nth").cast("long").alias("nth"), F.col("step_index").cast("long").alias("step_index"), F.get("steps", F.col("step_index").cast("int")).alias("step"))


def provenance_match(wanted: DataFrame, completions: DataFrame) -> DataFrame:
    """role of each (problem, text): that of its last occurrence among completions (problem, text, role, order), or not_found."""
    last = completions.groupBy("problem", "text").agg(F.max_by("role", "order").alias("role"))
    return wanted.join(last.hint("merge"), ["problem", "text"], "left").withColumn("role", F.coalesce("role", F.lit("not_found")))


def override_merge(base: DataFrame, corrections: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Corrected values replace the listed fields (NULL corrects nothing); `corrected` marks rows that have a correction."""
    new = corrections.select(*key, *(F.col(f).alias(f"new_{f}") for f in fields), F.lit(True).alias("corrected"))
    out = base.join(new, key, "left")
    return out.withColumns({f: F.coalesce(f"new_{f}", f) for f in fields} | {"corrected": F.coalesce("corrected", F.lit(False))}).drop(*(f"new_{f}" for f in fields))


def two_rater_merge(a: DataFrame, b: DataFrame, key: list[str], label: str, content: list[str]) -> DataFrame:
    """Both raters' labels of the same items; label_agreement, and content_mismatch where they did not see the same."""
    right = b.select(*key, F.col(label).alias(f"{label}_b"), *(F.col(c).alias(f"{c}_b") for c in content))
    both = a.join(right, key)
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    return both.select(*key, F.col(label).alias(f"{label}_a"), f"{label}_b", F.col(label).eqNullSafe(F.col(f"{label}_b")).alias("label_agreement"), (~same).alias("content_mismatch"))


def sign_agreement(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Share of equal signs among units that are not zero in either."""
    both = a.select(*key, F.col(value).alias("x")).join(b.select(*key, F.col(value).alias("y")), key)
    both = both.where((F.col("x") != 0) & (F.col("y") != 0))
    return both.agg(F.count(F.lit(1)).alias("units"), F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("sign_agreement"))


def intervention_tasks(units: DataFrame, n_runs: int, conditions: tuple[str, ...] = ("control", "target_delete", "placebo_delete")) -> DataFrame:
    """One task per unit, run and condition: the last visible step, and the placebo step in turn.

    Input: unit_id, target_index, placebo_indices (array). Units without placebo steps get no placebo tasks.
    """
    tasks = units.select("unit_id", "target_index", "placebo_indices", F.explode(F.sequence(F.lit(1), F.lit(n_runs))).alias("run"))
    tasks = tasks.withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    n = F.size("placebo_indices")
    placebo = F.when(F.col("condition") == "placebo_delete", F.get("placebo_indices", F.when(n > 0, F.pmod(F.col("run") - 1, n)).otherwise(F.lit(0))))
    last = F.when(F.col("condition") == "control", F.col("target_index")).when(F.col("condition") == "target_delete", F.col("target_index") - 1).otherwise(placebo - 1)
    tasks = tasks.withColumns({"placebo_step_index": placebo.cast("long"), "prefix_last": last.cast("long")}).where((F.col("condition") != "placebo_delete") | (n > 0))
    return tasks.select(F.concat_ws("-", "unit_id", "condition", "run").alias("task_id"), "unit_id", F.col("run").cast("long").alias("run"), "condition", "prefix_last", "placebo_step_index")
