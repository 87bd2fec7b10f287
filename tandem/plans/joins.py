"""Queries of the joins and set operations."""

from pyspark.sql import functions as F

from tandem.functions.exprs import transition
from tandem.operators import aggregates as A
from tandem.operators import joins as J
from tandem.plans.registry import query
from tandem.plans.views import raters, runs, sql, table, trajectories, units


@query("jon_01_unique_inner_join", "SELECT o_orderkey, o_totalprice, c_name FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) o JOIN customer c ON o.o_custkey = c.c_custkey")
def proven(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    if J.repeated_keys(c, ["key"]).head(1):
        raise ValueError("customers repeat")
    return J.unique_inner_join(o, c, ["key"], prove=False).drop("key")


@query("jon_02_pair_runs", sql("SELECT unit_id, run_id, cluster_id, control AS control_outcome, target AS target_outcome, control_cost, target_cost, control_status, target_status, (control = 1 AND target = 0)::INT AS danger, (control = 0 AND target = 1)::INT AS benefit FROM pairs"))
def paired(spark, sf_dir):
    return J.pair_runs(runs(spark, sf_dir))


@query("exp_07_transition", sql("SELECT unit_id, run_id, CASE WHEN control = 0 AND target = 1 THEN 'wrong_to_correct' WHEN control = 1 AND target = 0 THEN 'correct_to_wrong' WHEN control = 1 THEN 'still_correct' ELSE 'still_wrong' END AS transition FROM pairs"))
def transitions(spark, sf_dir):
    return J.pair_runs(runs(spark, sf_dir)).select("unit_id", "run_id", transition("control_outcome", "target_outcome").alias("transition"))


@query("jon_03_left_join_default", sql("SELECT u.unit_id, coalesce(p.n, 0) AS n, coalesce(p.rate, (SELECT avg(outcome) FROM runs)) AS rate FROM units u LEFT JOIN (SELECT unit_id, count(*) AS n, avg(outcome) AS rate FROM runs WHERE condition = 'placebo_delete' GROUP BY unit_id) p USING (unit_id)"), "rate")
def defaults(spark, sf_dir):
    r = runs(spark, sf_dir)
    base = r.agg(F.avg("outcome").alias("base"))
    p = r.where("condition = 'placebo_delete'").groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.avg("outcome").alias("rate"))
    u = units(spark, sf_dir).select("unit_id").crossJoin(F.broadcast(base))  # one row
    return J.left_join_default(u, p, ["unit_id"], {"n": F.lit(0).cast("long"), "rate": F.col("base")}).select("unit_id", "n", "rate")


@query("jon_04_semi_join_covered", sql("SELECT unit_id, valence FROM units WHERE unit_id IN (SELECT unit_id FROM runs WHERE condition = 'placebo_delete') AND unit_id IN (SELECT unit_id FROM runs WHERE condition = 'placebo_control')"))
def covered(spark, sf_dir):
    r = runs(spark, sf_dir)
    return J.semi_join_covered(units(spark, sf_dir).select("unit_id", "valence"), r.where("condition = 'placebo_delete'"), r.where("condition = 'placebo_control'"), key=["unit_id"])


@query("jon_05_anti_join_missing", sql("SELECT unit_id, valence FROM units WHERE unit_id NOT IN (SELECT unit_id FROM runs WHERE condition = 'placebo_delete')"))
def missing(spark, sf_dir):
    return J.anti_join_missing(units(spark, sf_dir).select("unit_id", "valence"), runs(spark, sf_dir).where("condition = 'placebo_delete'"), ["unit_id"])


@query("jon_06_key_set_diff", sql("""SELECT coalesce(a.unit_id, b.unit_id) AS unit_id, CASE WHEN a.unit_id IS NULL THEN 'only_b' ELSE 'only_a' END AS side
FROM (SELECT DISTINCT unit_id FROM runs WHERE condition = 'placebo_delete') a FULL JOIN (SELECT DISTINCT unit_id FROM runs WHERE condition = 'placebo_control') b ON a.unit_id = b.unit_id WHERE a.unit_id IS NULL OR b.unit_id IS NULL"""))
def difference(spark, sf_dir):
    r = runs(spark, sf_dir)
    return J.key_set_diff(r.where("condition = 'placebo_delete'"), r.where("condition = 'placebo_control'"), ["unit_id"])


STEPS = "SELECT unit_id, target_index, n_steps, unnest(range(len(steps))) AS step_index, unnest(steps) AS step FROM traj"
SHA = "substr(sha256('20260722|' || {0}), 1, 16)"


@query("jon_07_match_by_length_ratio", sql(f"""
SELECT unit_id, placebo_order, step_index AS placebo_step_index, len AS placebo_length, target_length, len / target_length::DOUBLE AS length_ratio, candidates FROM (
  SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY {SHA.format("unit_id || '|' || step_index")}, step_index)::INT AS placebo_order, count(*) OVER (PARTITION BY unit_id) AS candidates
  FROM (SELECT s.unit_id, s.step_index, length(trim(s.step)) AS len, length(trim(t.steps[t.target_index + 1])) AS target_length, s.target_index FROM steps s JOIN traj t USING (unit_id))
  WHERE step_index <> target_index AND len > 0 AND len * 100 >= target_length * 80 AND len * 100 <= target_length * 120) WHERE placebo_order <= 2""", steps=STEPS), "length_ratio")
def by_length(spark, sf_dir):
    return J.match_by_length_ratio(trajectories(spark, sf_dir))


BAND = "CASE WHEN {i} / greatest(n_steps - 1, 1)::DOUBLE < 1/3.0 THEN 0 WHEN {i} / greatest(n_steps - 1, 1)::DOUBLE < 2/3.0 THEN 1 ELSE 2 END"


@query("jon_08_match_nearest_position", sql(f"""
SELECT unit_id, target_index, step_index AS match_index, match_order FROM (
  SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY abs(step_index - target_index), step_index)::INT AS match_order FROM steps
  WHERE step_index <> target_index AND (n_steps <= 1 OR {BAND.format(i='step_index')} = {BAND.format(i='target_index')})) WHERE match_order <= 2""", steps=STEPS))
def by_position(spark, sf_dir):
    return J.match_nearest_position(trajectories(spark, sf_dir))


SIDE = "min({{'h': {0}, 'run': run_id, 'c': control_outcome}}) FILTER (side = '{1}' AND outcome = {2})"


@query("jon_09_discordant_triads", sql(f"""
SELECT unit_id, CASE WHEN won THEN t1.run ELSE t0.run END AS target_run, CASE WHEN won THEN p0.run ELSE p1.run END AS placebo_run, CASE WHEN won THEN t1.c ELSE t0.c END AS control_outcome,
  won::INT AS target_outcome, 1 - won::INT AS placebo_outcome, CASE WHEN won THEN 'target_correct' ELSE 'placebo_correct' END AS direction FROM (
  SELECT *, ('0x' || substr(md5('20260722|direction|' || unit_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (nt1 * np0 + nt0 * np1) < nt1 * np0 AS won FROM (
    SELECT unit_id, {', '.join(f"count(*) FILTER (side = '{side}' AND outcome = {y}) AS n{side[0]}{y}, {SIDE.format(SHA.format("side || '|' || unit_id || '|' || run_id"), side, y)} AS {side[0]}{y}" for side in ('target', 'placebo') for y in (0, 1))}
    FROM (SELECT t.unit_id, t.run_id, t.outcome, c.outcome AS control_outcome, 'target' AS side FROM runs t JOIN runs c ON c.unit_id = t.unit_id AND c.run_id = t.run_id AND c.condition = 'control' AND t.condition = 'target_delete'
      UNION ALL SELECT unit_id, run_id, outcome, NULL, 'placebo' FROM runs WHERE condition = 'placebo_delete') GROUP BY 1) WHERE nt1 * np0 + nt0 * np1 > 0)"""))
def triads(spark, sf_dir):
    return J.discordant_triads(runs(spark, sf_dir))


@query("jon_10_own_control_join", sql("""
SELECT *, placebo_rate - own_control_rate AS effect FROM (SELECT unit_id, placebo_index, avg(outcome) AS placebo_rate, count(*) AS placebo_runs FROM runs WHERE condition = 'placebo_delete' GROUP BY ALL) p
JOIN (SELECT unit_id, placebo_index, avg(outcome) AS own_control_rate, count(*) AS own_control_runs FROM runs WHERE condition = 'placebo_control' GROUP BY ALL) o USING (unit_id, placebo_index)"""), "placebo_rate own_control_rate effect")
def own_controls(spark, sf_dir):
    return J.own_control_join(runs(spark, sf_dir))


@query("jon_11_fallback_match", sql("""
SELECT w.unit_id, record_id, matched_index, index_fallback_used FROM wanted w LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY CASE WHEN exact THEN 0 ELSE 1 END, record_id) AS nth FROM (
    SELECT w.unit_id, r.unit_id AS record_id, coalesce(r.steps[w.declared_index + 1] = w.text, false) AS exact, CASE WHEN r.steps[w.declared_index + 1] = w.text THEN w.declared_index ELSE list_position(r.steps, w.text) - 1 END::BIGINT AS matched_index,
      NOT coalesce(r.steps[w.declared_index + 1] = w.text, false) AS index_fallback_used
    FROM wanted w JOIN traj r ON w.problem = r.source || '|' || r.lang WHERE list_position(r.steps, w.text) IS NOT NULL)) f ON f.unit_id = w.unit_id AND nth = 1""",
    wanted="SELECT unit_id, source || '|' || lang AS problem, steps[target_index + 1] AS text, CASE WHEN unit_id % 3 = 0 THEN target_index + 1 ELSE target_index END AS declared_index FROM traj"))
def fallbacks(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    problem = F.concat_ws("|", "source", "lang")
    text = F.get("steps", F.col("target_index").cast("int"))
    wanted = t.select("unit_id", problem.alias("problem"), text.alias("text"), F.when(F.col("unit_id") % 3 == 0, F.col("target_index") + 1).otherwise(F.col("target_index")).alias("declared_index"))
    return J.fallback_match(wanted, t.select(F.col("unit_id").alias("record_id"), problem.alias("problem"), "steps"))


@query("jon_12_prioritised_lookup", """
SELECT o_custkey AS key, coalesce(d, s) AS answer, CASE WHEN d IS NOT NULL THEN 'dataset' WHEN s IS NOT NULL THEN 'sibling' ELSE 'missing' END AS source FROM (SELECT DISTINCT o_custkey FROM orders) w
LEFT JOIN (SELECT c_custkey, c_name AS d FROM customer WHERE c_custkey % 3 = 0) c ON c_custkey = o_custkey LEFT JOIN (SELECT o_custkey AS k, min_by(o_orderpriority, o_orderkey) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON k = o_custkey""")
def lookups(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return J.prioritised_lookup(
        o.select(F.col("o_custkey").alias("key")).distinct(), c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("answer")),
        o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("sibling_order"), F.col("o_orderpriority").alias("answer")),
    )


@query("jon_13_index_lookup", sql("SELECT unit_id, nth, i AS step_index, CASE WHEN i >= 0 THEN steps[i + 1] END AS step FROM (SELECT unit_id, steps, unnest([0, 1, 2])::BIGINT AS nth, unnest([target_index, target_index + 1, 0]) AS i FROM traj)"))
def indices(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    listed = t.select("unit_id", F.col("unit_id").alias("record_id"), F.array(F.col("target_index"), F.col("target_index") + 1, F.lit(0).cast("long")).alias("indices"))
    return J.index_lookup(listed, t.select(F.col("unit_id").alias("record_id"), "steps"))


@query("jon_14_provenance_match", sql("""
SELECT t.unit_id, coalesce(r.role, 'not_found') AS role FROM (SELECT unit_id, source, steps[target_index + 1] AS text FROM traj) t
LEFT JOIN (SELECT source, text, max_by(CASE WHEN step_index = target_index THEN 'chosen' ELSE 'alternative' END, unit_id * 100000 + step_index) AS role FROM (SELECT source, s.* , s.step AS text FROM steps s JOIN traj USING (unit_id)) WHERE unit_id % 4 <> 0 GROUP BY 1, 2) r USING (source, text)""", steps=STEPS))
def provenance(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    all_steps = t.where("unit_id % 4 <> 0").select(F.col("source").alias("problem"), "unit_id", "target_index", F.posexplode("steps").alias("i", "text"))
    role = F.when(F.col("i") == F.col("target_index"), "chosen").otherwise("alternative")
    wanted = t.select("unit_id", F.col("source").alias("problem"), F.get("steps", F.col("target_index").cast("int")).alias("text"))
    return J.provenance_match(wanted, all_steps.select("problem", "text", role.alias("role"), (F.col("unit_id") * 100000 + F.col("i")).alias("order"))).select("unit_id", "role")


@query("jon_15_override_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderkey % 5 = 0 AS corrected FROM orders")
def overridden(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    fixes = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "X").alias("o_orderstatus"))
    return J.override_merge(o, fixes, ["o_orderkey"], ["o_orderstatus"]).drop("o_totalprice")


@query("jon_16_two_rater_merge", sql("SELECT a.item_id, a.label AS label_a, b.label AS label_b, a.label = b.label AS label_agreement, false AS content_mismatch FROM raters a JOIN raters b ON a.item_id = b.item_id AND a.rater = 'r1' AND b.rater = 'r3'"))
def merged(spark, sf_dir):
    r = raters(spark, sf_dir).withColumn("text", F.concat(F.lit("item "), F.col("item_id").cast("string")))
    return J.two_rater_merge(r.where("rater = 'r1'"), r.where("rater = 'r3'"), ["item_id"], "label", ["text"])


@query("jon_17_sign_agreement", sql("SELECT count(*) AS units, avg((sign(target_effect) = sign(placebo_effect))::INT) AS sign_agreement FROM eff WHERE target_effect <> 0 AND placebo_effect <> 0"), "sign_agreement")
def signs(spark, sf_dir):
    e = A.unit_effects(runs(spark, sf_dir))
    return J.sign_agreement(e.select("unit_id", F.col("target_effect").alias("v")), e.select("unit_id", F.col("placebo_effect").alias("v")), ["unit_id"], "v")


@query("jon_18_assemble_master_tables", sql("""
SELECT u.unit_id, u.valence, u.type, u.position, e.control_rate, e.target_effect, e.semantic_effect, t.wc AS wrong_to_correct, t.cw AS correct_to_wrong, t.cw / nullif(t.cc, 0)::DOUBLE AS danger_rate, coalesce(p.n, 0) AS placebo_runs, p.n IS NOT NULL AS placebo_eligible
FROM units u JOIN eff e USING (unit_id) JOIN (SELECT unit_id, sum((control = 0 AND target = 1)::INT)::BIGINT AS wc, sum((control = 1 AND target = 0)::INT)::BIGINT AS cw, sum(control) AS cc FROM pairs GROUP BY 1) t USING (unit_id)
LEFT JOIN (SELECT unit_id, count(*) AS n FROM runs WHERE condition = 'placebo_delete' GROUP BY 1) p USING (unit_id)"""), "control_rate target_effect semantic_effect danger_rate")
def master(spark, sf_dir):
    from tandem.operators.effects import assemble_unit_table

    return assemble_unit_table(units(spark, sf_dir), runs(spark, sf_dir)).select("unit_id", "valence", "type", "position", "control_rate", "target_effect", "semantic_effect", "wrong_to_correct", "correct_to_wrong", "danger_rate", "placebo_runs", "placebo_eligible")


@query("jon_19_intervention_tasks", sql("""
SELECT unit_id || '-' || condition || '-' || run AS task_id, unit_id, run, condition, CASE condition WHEN 'control' THEN target_index WHEN 'target_delete' THEN target_index - 1 ELSE p - 1 END AS prefix_last, CASE WHEN condition = 'placebo_delete' THEN p END AS placebo_step_index
FROM (SELECT t.unit_id, target_index, run, condition, pl[(run - 1) % nullif(len(pl), 0) + 1] AS p, len(pl) AS n FROM (
  SELECT unit_id, target_index, list_filter(range(n_steps), lambda i: i <> target_index AND i < 3) AS pl FROM traj) t, range(1, 5) r(run), (VALUES ('control'), ('target_delete'), ('placebo_delete')) c(condition)) WHERE condition <> 'placebo_delete' OR n > 0"""))
def tasks(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    placebo = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n_steps") - 1), lambda i: (i != F.col("target_index")) & (i < 3))
    return J.intervention_tasks(t.select("unit_id", "target_index", placebo.alias("placebo_indices")), 4)


@query("set_01_union_strata", sql("SELECT unit_id, 'anchor' AS stratum FROM units WHERE cell = 'anchor' UNION ALL SELECT unit_id, 'late' FROM units WHERE position = 'late'"))
def union_strata(spark, sf_dir):
    from tandem.operators.sampling import union_strata as union

    u = units(spark, sf_dir).select("unit_id", "cell", "position")
    return union({"anchor": u.where("cell = 'anchor'").select("unit_id"), "late": u.where("position = 'late'").select("unit_id")})


@query("set_02_intersect_covered", sql("SELECT unit_id FROM runs WHERE condition = 'placebo_delete' INTERSECT SELECT unit_id FROM runs WHERE condition = 'c3_paraphrase' INTERSECT SELECT unit_id FROM runs WHERE condition = 'placebo_control'"))
def intersect(spark, sf_dir):
    from tandem.operators.sampling import intersect_covered

    wanted = ("placebo_delete", "c3_paraphrase", "placebo_control")
    return intersect_covered(runs(spark, sf_dir).where(F.col("condition").isin(*wanted)), "unit_id", "condition", len(wanted))


@query("set_03_except_ids", sql("SELECT unit_id FROM units EXCEPT SELECT unit_id FROM runs WHERE condition = 'placebo_delete'"))
def except_ids(spark, sf_dir):
    from tandem.operators.sampling import except_ids as minus

    return minus(units(spark, sf_dir), runs(spark, sf_dir).where("condition = 'placebo_delete'"), "unit_id")
