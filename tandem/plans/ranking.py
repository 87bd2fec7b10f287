"""Queries of ranks, curves, predictive metrics and policies."""

from pyspark.sql import functions as F

from tandem.functions import exprs as X
from tandem.operators import aggregates as A
from tandem.operators import predict as P
from tandem.operators import ranking as R
from tandem.operators import sampling as S
from tandem.operators.joins import pair_runs
from tandem.plans.aggregates import EU, effect_units
from tandem.plans.effects import CI, REPS, SEED, boot, drawn
from tandem.plans.registry import query
from tandem.plans.views import runs, scores, sql, table, units

H = "substr(sha256('20260722|' || {0}), 1, 16)"
POL = """SELECT u.unit_id, u.cluster_id, u.valence, e.target_effect AS effect, t.runs, t.danger, t.benefit, t.control_correct, policy,
  CASE policy WHEN 'valence_first' THEN valence ELSE 0 END::DOUBLE AS tier, CASE policy WHEN 'random' THEN 0 ELSE price END::DOUBLE AS policy_score, CASE valence WHEN -1 THEN 0.5 WHEN 0 THEN 1.0 ELSE 1.5 END::DOUBLE AS w
FROM units u JOIN eff e USING (unit_id) JOIN (SELECT unit_id, count(*) AS runs, sum((control=1 AND target=0)::INT)::BIGINT AS danger, sum((control=0 AND target=1)::INT)::BIGINT AS benefit, sum(control)::BIGINT AS control_correct FROM pairs GROUP BY 1) t USING (unit_id), (VALUES ('random'), ('valence_first'), ('price')) v(policy)"""
RANK = f"row_number() OVER (PARTITION BY policy ORDER BY tier, policy_score DESC, {H.format('unit_id')}, unit_id)"


def policy_units(spark, sf_dir):
    e = effect_units(spark, sf_dir)
    t = pair_runs(runs(spark, sf_dir)).groupBy("unit_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("danger").alias("danger"), F.sum("benefit").alias("benefit"), F.sum("control_outcome").alias("control_correct"))
    w = F.when(F.col("valence") == -1, 0.5).when(F.col("valence") == 0, 1.0).otherwise(1.5)
    return e.join(t, "unit_id").select("unit_id", "cluster_id", "valence", "price", F.col("target_effect").alias("effect"), "runs", "danger", "benefit", "control_correct", w.alias("w"))


def policies(spark, sf_dir):
    zero = F.lit(0.0)
    return R.policy_rows(policy_units(spark, sf_dir), {"random": (zero, zero), "valence_first": (F.col("valence"), F.col("price")), "price": (zero, F.col("price"))})


@query("rnk_01_deterministic_rank", sql(f"SELECT policy, unit_id, {RANK} AS rank FROM p", p=POL))
def ranks(spark, sf_dir):
    return R.deterministic_rank(policies(spark, sf_dir), ["policy"], F.col("tier"), F.col("policy_score"), "unit_id").select("policy", "unit_id", "rank")


@query("rnk_02_rank_tertiles", sql("SELECT unit_id, floor((row_number() OVER (ORDER BY price, unit_id) - 1) * 3 / (SELECT count(*) FROM units))::INT AS tertile FROM units"))
def tertiles(spark, sf_dir):
    return R.rank_tertiles(units(spark, sf_dir), ["price", "unit_id"]).select("unit_id", "tertile")


@query("rnk_03_top_k_per_family", sql(f"""SELECT 'anchor' AS family, unit_id, row_number() OVER (ORDER BY price DESC, {H.format('unit_id')})::INT AS family_rank FROM units WHERE cell = 'anchor' QUALIFY family_rank <= 8
UNION ALL SELECT 'late', unit_id, row_number() OVER (ORDER BY size, {H.format('unit_id')})::INT AS family_rank FROM units WHERE position = 'late' QUALIFY family_rank <= 8"""))
def families(spark, sf_dir):
    return R.top_k_per_family(units(spark, sf_dir), {"anchor": (F.col("cell") == "anchor", [F.desc("price")]), "late": (F.col("position") == "late", [F.asc("size")])}, 8, "unit_id").select("family", "unit_id", "family_rank")


RUN = f"SELECT *, {RANK} AS k, count(*) OVER (PARTITION BY policy) AS n FROM p"
CURVE = """SELECT policy, k, k / n::DOUBLE AS coverage, es / n AS net_change, es / k AS mean_effect, ds / nullif(rs, 0)::DOUBLE AS danger_rate, bs / nullif(rs, 0)::DOUBLE AS benefit_rate, ds / nullif(cs, 0)::DOUBLE AS danger_given_correct, du / k::DOUBLE AS unit_danger_rate FROM (
  SELECT policy, k, n, sum(effect) OVER w AS es, sum(runs) OVER w AS rs, sum(danger) OVER w AS ds, sum(benefit) OVER w AS bs, sum(control_correct) OVER w AS cs, sum((effect < 0)::INT) OVER w AS du FROM rk WINDOW w AS (PARTITION BY policy ORDER BY k)) WHERE k % 10 = 0 OR k = n"""
CURVE_FLOATS = "coverage net_change mean_effect danger_rate benefit_rate danger_given_correct unit_danger_rate"


@query("crv_01_risk_coverage_curve", sql(CURVE, p=POL, rk=RUN), CURVE_FLOATS)
def curve(spark, sf_dir):
    return R.risk_coverage_curve(policies(spark, sf_dir))


@query("crv_02_random_policy_expectation", sql("SELECT coverage, coverage * m AS net_change, m AS mean_effect, d AS danger_rate FROM (SELECT avg(effect) AS m, sum(danger) / sum(runs)::DOUBLE AS d FROM p WHERE policy = 'random'), (VALUES (0.1::DOUBLE), (0.5), (1.0)) g(coverage)", p=POL), "coverage net_change mean_effect danger_rate")
def expectation(spark, sf_dir):
    return R.random_policy_expectation(policy_units(spark, sf_dir), [0.1, 0.5, 1.0])


@query("crv_03_model_risk_coverage", sql("""SELECT scorer, coverage, k, ys / k::DOUBLE AS rate FROM (SELECT scorer, row_number() OVER w AS r, sum(y) OVER w AS ys FROM scores WINDOW w AS (PARTITION BY scorer ORDER BY score, unit_id ROWS UNBOUNDED PRECEDING)) JOIN
  (SELECT scorer, coverage, greatest(1, round(n * coverage))::BIGINT AS k FROM (SELECT scorer, count(*) AS n FROM scores GROUP BY 1), (VALUES (0.05::DOUBLE), (0.25), (1.0)) g(coverage)) USING (scorer) WHERE r = k"""), "coverage rate")
def model_curve(spark, sf_dir):
    return R.model_risk_coverage(scores(spark, sf_dir), ["scorer"], "score", "y", [0.05, 0.25, 1.0])


POINTS = """SELECT policy, point, CASE point WHEN 'natural' THEN sum((valence = -1)::INT)::BIGINT ELSE greatest(1, round(count(*) * try_cast(point AS DOUBLE)))::BIGINT END AS size FROM p, (VALUES ('natural'), ('0.05'), ('0.1'), ('0.25')) v(point) GROUP BY 1, 2"""


@query("crv_04_operating_points", boot("SELECT policy, point, size AS k, cluster_id AS cluster, CASE WHEN rk.k <= size THEN effect ELSE 0 END AS num, 1 AS den FROM rk JOIN pts USING (policy)", "policy, point, k", p=POL, rk=RUN, pts=POINTS), CI)
def operating(spark, sf_dir):
    return R.operating_points(policies(spark, sf_dir), F.col("valence") == -1, [0.05, 0.1, 0.25], reps=REPS, seed=SEED)


@query("crv_05_max_prefix_under_budget", sql(f"SELECT policy, budget, coalesce(max(k) FILTER (danger_rate <= budget), 0) AS k, coalesce(arg_max(net_change, k) FILTER (danger_rate <= budget), 0) AS net_change, arg_max(danger_rate, k) FILTER (danger_rate <= budget) AS rate FROM ({CURVE}), (VALUES (0.2::DOUBLE), (0.25), (0.3)) b(budget) GROUP BY 1, 2", p=POL, rk=RUN), "budget net_change rate")
def budgeted(spark, sf_dir):
    return R.max_prefix_under_budget(R.risk_coverage_curve(policies(spark, sf_dir)), "danger_rate", [0.2, 0.25, 0.3])


CERT = """SELECT policy, k, m AS clusters, t AS estimate, CASE WHEN m < 2 THEN -1 ELSE t - 1.645 * sqrt(m / (m - 1)::DOUBLE * greatest(q, 0)) / sb END AS lcb FROM (
  SELECT policy, k, count(*) AS m, any_value(sa / sb) AS t, any_value(sb) AS sb, sum((a - sa / sb * b)**2) AS q FROM (
    SELECT policy, k, a, b, sum(a) OVER (PARTITION BY policy, k) AS sa, sum(b) OVER (PARTITION BY policy, k) AS sb FROM (
      SELECT g.policy, g.k, r.cluster_id, sum(r.w * r.effect) AS a, sum(r.w) AS b FROM (SELECT policy, k FROM rk WHERE k % 10 = 0 OR k = n) g JOIN rk r ON g.policy = r.policy AND r.k <= g.k GROUP BY 1, 2, 3)) GROUP BY 1, 2)"""


@query("crv_06_certified_prefixes", sql(CERT, p=POL, rk=RUN), "estimate lcb")
def certified(spark, sf_dir):
    return R.certified_prefixes(policies(spark, sf_dir))


@query("crv_06b_lcb_certified_prefix", sql(f"SELECT policy, budget, coalesce(max(k) FILTER (lcb >= -budget), 0) AS k, arg_max(estimate, k) FILTER (lcb >= -budget) AS estimate, arg_max(lcb, k) FILTER (lcb >= -budget) AS lcb FROM ({CERT}), (VALUES (0.01::DOUBLE), (0.05)) b(budget) GROUP BY 1, 2", p=POL, rk=RUN), "budget estimate lcb")
def certified_best(spark, sf_dir):
    return R.lcb_certified_prefix(policies(spark, sf_dir), [0.01, 0.05])


CTP = "SELECT unit_id, count(*) FILTER (condition = 'control') AS c, count(*) FILTER (condition = 'target_delete') AS t, avg(outcome) FILTER (condition IN ('control', 'target_delete')) AS p FROM runs GROUP BY 1 HAVING count(*) FILTER (condition = 'control') > 0 AND count(*) FILTER (condition = 'target_delete') > 0"
MASS = "CASE WHEN p <= 0 THEN ({k} = 0)::INT WHEN p >= 1 THEN ({k} = {n})::INT ELSE exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln(p) + ({n} - {k}) * ln(1 - p)) END"


def floor_sql(cells: str) -> str:
    """Twin of null_floors by all pairs of outcomes."""
    return f"""SELECT c, t, p, coalesce(sum(mass) FILTER (d < -1e-12), 0) AS floor, coalesce(sum(mass) FILTER (d <= -0.5 + 1e-12), 0) AS severe_floor FROM (
  SELECT c, t, p, j / t::DOUBLE - i / c::DOUBLE AS d, ({MASS.format(k='i', n='c')}) * ({MASS.format(k='j', n='t')}) AS mass
  FROM (SELECT c, t, p, i, unnest(range(t + 1)) AS j FROM (SELECT c, t, p, unnest(range(c + 1)) AS i FROM (SELECT DISTINCT c, t, p FROM {cells})))) GROUP BY 1, 2, 3"""


def binomial_cells(spark, sf_dir):
    both = F.col("condition").isin("control", "target_delete")
    n = lambda c: F.count(F.when(F.col("condition") == c, 1))
    return runs(spark, sf_dir).groupBy("unit_id").agg(n("control").alias("c"), n("target_delete").alias("t"), F.avg(F.when(both, F.col("outcome"))).alias("p")).where("c > 0 and t > 0")


@query("exp_19_null_floor", sql("SELECT c, t, p, unit_id, floor FROM cells JOIN (" + floor_sql("cells") + ") USING (c, t, p)", cells=CTP), "p floor")
def floors(spark, sf_dir):
    return R.null_floor(binomial_cells(spark, sf_dir))


NATURAL = "CASE valence WHEN -1 THEN 0.5 WHEN 0 THEN 1.0 ELSE 1.5 END"


@query("crv_07_tail_risk", sql("""SELECT regime, units, share_negative, null_floor, greatest(0, share_negative - null_floor) AS excess, share_severe, severe_floor, greatest(0, share_severe - severe_floor) AS severe_excess FROM (
  SELECT regime, count(*) AS units, sum(w * (target_effect < 0)::INT) / sum(w) AS share_negative, sum(w * floor) / sum(w) AS null_floor, sum(w * (target_effect <= -0.5)::INT) / sum(w) AS share_severe, sum(w * severe_floor) / sum(w) AS severe_floor
  FROM (SELECT *, CASE regime WHEN 'balanced' THEN 1 ELSE """ + NATURAL + """ END::DOUBLE AS w FROM cells JOIN (""" + floor_sql("cells") + """) USING (c, t, p) JOIN eff USING (unit_id) JOIN (SELECT unit_id, valence FROM units) USING (unit_id), (VALUES ('balanced'), ('natural')) v(regime) WHERE target_effect IS NOT NULL) GROUP BY 1)""", cells=CTP),
    "share_negative null_floor excess share_severe severe_floor severe_excess")
def tail(spark, sf_dir):
    e = A.unit_effects(runs(spark, sf_dir)).select("unit_id", F.col("target_effect").alias("effect")).where("effect is not null")
    natural = F.when(F.col("valence") == -1, 0.5).when(F.col("valence") == 0, 1.0).otherwise(1.5)
    rows = binomial_cells(spark, sf_dir).join(e, "unit_id").join(units(spark, sf_dir).select("unit_id", "valence"), "unit_id")
    regime = F.explode(F.array(F.struct(F.lit("balanced").alias("regime"), F.lit(1.0).alias("w")), F.struct(F.lit("natural").alias("regime"), natural.alias("w"))))
    return R.tail_risk(rows.select("*", regime.alias("x")).select("*", "x.*"), ["regime"])


@query("exp_20_wilson_upper", sql("SELECT type, position, r AS rate, n, (r + 2.706025/(2*n) + 1.645*sqrt(r*(1-r)/n + 2.706025/(4*n*n::DOUBLE)))/(1 + 2.706025/n) AS upper FROM (SELECT type, position, avg(outcome) AS r, count(*) AS n FROM runs JOIN units USING (unit_id) GROUP BY 1, 2)"), "rate upper")
def wilson(spark, sf_dir):
    g = runs(spark, sf_dir).join(units(spark, sf_dir).select("unit_id", "type", "position"), "unit_id").groupBy("type", "position").agg(F.avg("outcome").alias("rate"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("upper", X.wilson_upper("rate", "n"))


@query("crv_08_wilson_calibrated_policy", sql("""SELECT scorer, budget, c.coverage, upper, test_k, test_rate FROM (SELECT scorer, budget, max(coverage) AS coverage, arg_max(upper, coverage) AS upper FROM (SELECT *, (r + 2.706025/(2*k) + 1.645*sqrt(r*(1-r)/k + 2.706025/(4*k*k::DOUBLE)))/(1 + 2.706025/k) AS upper FROM cov WHERE split = 'calibration'), (VALUES (0.45::DOUBLE), (0.55)) b(budget) WHERE upper <= budget GROUP BY 1, 2) c
  JOIN (SELECT scorer, coverage, k AS test_k, r AS test_rate FROM cov WHERE split = 'test') t USING (scorer, coverage)""",
    sp="SELECT unit_id, scorer, score, y, CASE WHEN ('0x' || substr(sha256('3|' || cluster_id), 1, 16))::UBIGINT % 10 < 5 THEN 'calibration' ELSE 'test' END AS split FROM scores",
    cov="SELECT scorer, split, coverage, k, ys / k::DOUBLE AS r FROM (SELECT scorer, split, row_number() OVER w AS rk, sum(y) OVER w AS ys FROM sp WINDOW w AS (PARTITION BY scorer, split ORDER BY score, unit_id ROWS UNBOUNDED PRECEDING)) JOIN (SELECT scorer, split, coverage, floor(n * coverage)::BIGINT AS k FROM (SELECT scorer, split, count(*) AS n FROM sp GROUP BY 1, 2), (VALUES (0.1::DOUBLE), (0.25), (0.5), (1.0)) g(coverage)) USING (scorer, split) WHERE rk = k"), "budget coverage upper test_rate")
def calibrated(spark, sf_dir):
    from tandem.operators.sampling import hash_split

    s = hash_split(scores(spark, sf_dir), "cluster_id", 10, 5, 3)
    return P.wilson_calibrated_policy(s, ["scorer"], "split", "score", "y", [0.45, 0.55], [0.1, 0.25, 0.5, 1.0]).select("scorer", "budget", "coverage", "upper", "test_k", "test_rate")


MODELS = {"A": ["neg"], "B": ["log_price"], "C": ["neg", "late"], "D": ["neg", "late", "log_price"], "E": ["neg", "late", "log_price", "log_size"]}
FEATURES = ("neg", "late", "log_price", "log_size")


def predictive_units(spark, sf_dir):
    return units(spark, sf_dir).withColumns({"neg": (F.col("valence") == -1).cast("double"), "late": (F.col("position") == "late").cast("double"), "log_price": F.log1p("price"), "log_size": F.log1p("size")})


def predictive_pairs(spark, sf_dir):
    p = pair_runs(runs(spark, sf_dir)).select("unit_id", "run_id", "danger", "benefit", "control_outcome")
    return p.join(predictive_units(spark, sf_dir).select("unit_id", "cluster_id", *FEATURES), "unit_id")


@query("crv_09_nested_policy_selection")
def nested(spark, sf_dir):
    u = policy_units(spark, sf_dir).where("effect is not null").select("unit_id", "effect", "w", "valence").join(predictive_units(spark, sf_dir).select("unit_id", "cluster_id", "price", *FEATURES), "unit_id")
    zero = F.lit(0.0)
    static = {"random": (zero, zero), "valence_first": (F.col("valence"), F.col("price")), "price": (zero, F.col("price"))}
    return P.nested_policy_selection(predictive_pairs(spark, sf_dir), u, static, {m: MODELS[m] for m in "DE"})


SC = "SELECT o_orderkey AS unit_id, list_avg(s) AS m, list_max(s) - list_min(s) AS spread, o_totalprice / 100000 - 2.5 AS effect FROM (SELECT *, [(o_custkey % 11) / 10.0::DOUBLE, (o_custkey % 7) / 6.0::DOUBLE] AS s FROM orders)"


@query("crv_10_score_policies", sql("SELECT count(*) AS units, sum((m <= 0.5 AND spread <= 0.3)::INT)::BIGINT AS selected, sum((m <= 0.5 AND spread > 0.3)::INT)::BIGINT AS abstained, avg(effect) FILTER (m <= 0.5 AND spread <= 0.3) AS mean_effect, avg((effect < 0)::INT) FILTER (m <= 0.5 AND spread <= 0.3) AS danger_share FROM s", s=SC), "mean_effect danger_share")
def score_policy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("unit_id", F.col("o_orderkey"))
    long = o.select("unit_id", F.posexplode(F.array((F.col("o_custkey") % 11) / 10.0, (F.col("o_custkey") % 7) / 6.0)).alias("scorer", "score"))
    return P.score_policies(P.combine_scores(long, 2), o.select("unit_id", (F.col("o_totalprice") / 100000 - 2.5).alias("effect")), 0.5, 0.3)


CURVES = """SELECT policy, k, k / (SELECT count(*) FROM o)::DOUBLE AS coverage, es / (SELECT count(*) FROM o) AS net_change, ds / rs::DOUBLE AS danger_rate, bs / rs::DOUBLE AS benefit_rate FROM (
  SELECT policy, row_number() OVER w AS k, sum(effect) OVER w AS es, sum(runs) OVER w AS rs, sum(danger) OVER w AS ds, sum(benefit) OVER w AS bs FROM r WINDOW w AS (PARTITION BY policy ORDER BY s, """ + H.format("unit_id") + """, unit_id ROWS UNBOUNDED PRECEDING)) WHERE k % 20 = 0"""
CURVE_ROWS = {
    "o": "SELECT o_orderkey AS unit_id, (o_custkey % 11) / 10.0::DOUBLE AS s0, (o_custkey % 7) / 6.0::DOUBLE AS s1, o_totalprice / 100000 - 2.5 AS effect, 4 AS runs, o_orderkey % 4 AS danger, o_custkey % 3 AS benefit FROM orders",
    "r": "SELECT *, 'score 0' AS policy, s0 AS s FROM o UNION ALL SELECT *, 'score 1', s1 FROM o WHERE unit_id % 9 <> 0 UNION ALL SELECT *, 'ensemble', (s0 + s1) / 2 FROM o WHERE unit_id % 9 <> 0 AND abs(s0 - s1) <= 0.3",
}
CURVE_RATES = "coverage net_change danger_rate benefit_rate"


def score_curve(spark, sf_dir):
    """Two scorers of orders; the second leaves out a ninth of them."""
    o = table(spark, sf_dir, "orders").withColumn("unit_id", F.col("o_orderkey"))
    second = F.when(F.col("unit_id") % 9 != 0, (F.col("o_custkey") % 7) / 6.0)
    long = o.select("unit_id", F.posexplode(F.array((F.col("o_custkey") % 11) / 10.0, second)).alias("scorer", "score"))
    u = o.select("unit_id", (F.col("o_totalprice") / 100000 - 2.5).alias("effect"), F.lit(4).alias("runs"), (F.col("o_orderkey") % 4).alias("danger"), (F.col("o_custkey") % 3).alias("benefit"))
    return P.score_curves(long, u, 2, 0.3, 20)


@query("crv_10b_score_curves", sql(CURVES, **CURVE_ROWS), CURVE_RATES)
def score_policy_curves(spark, sf_dir):
    return score_curve(spark, sf_dir)


@query("crv_10c_score_budgets", sql(f"SELECT policy, budget, coalesce(max(k) FILTER (danger_rate <= budget), 0) AS k, coalesce(arg_max(net_change, k) FILTER (danger_rate <= budget), 0) AS net_change, arg_max(danger_rate, k) FILTER (danger_rate <= budget) AS rate FROM ({CURVES}), (VALUES (0.2::DOUBLE), (0.37), (0.4)) b(budget) GROUP BY 1, 2", **CURVE_ROWS), "budget net_change rate")
def score_budgets(spark, sf_dir):
    return R.max_prefix_under_budget(score_curve(spark, sf_dir), "danger_rate", [0.2, 0.37, 0.4])


PROBED = """SELECT r.unit_id, any_value(cluster_id) AS cluster_id, any_value(valence) AS valence, max(t) FILTER (run_id = 1) AS probe, count(*) FILTER (run_id <> 1 AND c IS NOT NULL AND t IS NOT NULL) AS n, sum(c) FILTER (run_id <> 1 AND c IS NOT NULL AND t IS NOT NULL) AS sc, sum(t) FILTER (run_id <> 1 AND c IS NOT NULL AND t IS NOT NULL) AS st
FROM (SELECT unit_id, run_id, max(outcome) FILTER (condition = 'control') AS c, max(outcome) FILTER (condition = 'target_delete') AS t FROM runs WHERE condition IN ('control', 'target_delete') GROUP BY 1, 2) r JOIN units USING (unit_id) GROUP BY 1"""
PROBE_ROWS = """SELECT candidate_set, policy, unit_id, cluster_id AS cluster, CASE WHEN policy = 'naive' OR probe = 1 THEN 1 ELSE 0 END AS a, CASE WHEN policy = 'naive' OR probe = 1 THEN st / n::DOUBLE - sc / n::DOUBLE ELSE 0 END AS num, 1 AS den, CASE WHEN policy = 'naive' OR probe = 1 THEN floor ELSE 0 END AS f
FROM cells JOIN floors USING (c, t, p), (VALUES ('naive'), ('rollback')) v(policy), (VALUES ('valence -1'), ('all')) k(candidate_set) WHERE candidate_set = 'all' OR valence = -1"""


@query("crv_11_probe_and_rollback", sql(
    "SELECT candidate_set, policy, candidates, accept_rate, net, CASE WHEN clusters < 2 THEN -1 ELSE low END AS net_lcb, harmed_share, null_floor, greatest(0, harmed_share - null_floor) AS excess FROM (SELECT candidate_set, policy, count(*) AS candidates, count(DISTINCT cluster) AS clusters, avg(a) AS accept_rate, avg(num) AS net, avg((num < 0)::INT) AS harmed_share, avg(f) AS null_floor FROM rows_ GROUP BY 1, 2) JOIN (SELECT candidate_set, policy, quantile_cont(v, 0.05) AS low FROM rep_ GROUP BY 1, 2) USING (candidate_set, policy)",
    probed=PROBED, cells="SELECT *, n AS c, n AS t, (sc + st) / (2 * n)::DOUBLE AS p FROM probed WHERE probe IS NOT NULL AND n >= 3", floors=floor_sql("cells"), rows_=PROBE_ROWS,
    sums="SELECT candidate_set, policy, cluster, sum(num)::DOUBLE AS num, sum(den)::DOUBLE AS den FROM rows_ GROUP BY 1, 2, 3", rep_=drawn("sums", "candidate_set, policy")), "accept_rate net net_lcb harmed_share null_floor excess")
def rollback(spark, sf_dir):
    r = runs(spark, sf_dir).select("unit_id", "run_id", "condition", "outcome").join(units(spark, sf_dir).select("unit_id", "cluster_id", "valence"), "unit_id")
    return P.probe_and_rollback(r, {"valence -1": F.col("valence") == -1, "all": F.lit(True)}, reps=REPS, seed=SEED)


@query("crv_12_split_half_null", sql("SELECT units, mean_difference, share_negative, share_half_down, null_floor, greatest(0, share_negative - null_floor) AS excess FROM (SELECT count(*) AS units, avg(b - a) AS mean_difference, avg((b - a < 0)::INT) AS share_negative, avg((b - a <= -0.5)::INT) AS share_half_down, avg(floor) AS null_floor FROM cells JOIN (" + floor_sql("cells") + ") USING (c, t, p))",
    cells="SELECT *, 2 AS c, 2 AS t FROM (SELECT unit_id, avg(outcome) FILTER (run_id IN (1, 2)) AS a, avg(outcome) FILTER (run_id IN (3, 4)) AS b, avg(outcome) AS p FROM runs WHERE condition = 'control' AND run_id <= 4 GROUP BY 1 HAVING count(DISTINCT run_id) = 4)"), "mean_difference share_negative share_half_down null_floor excess")
def split_half(spark, sf_dir):
    return P.split_half_null(runs(spark, sf_dir))


@query("met_01_roc_auc", sql("SELECT scorer, sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives, (sum(CASE WHEN y = 1 THEN rank END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0) AS auroc FROM (SELECT scorer, y, rank() OVER (PARTITION BY scorer ORDER BY score) + (count(*) OVER (PARTITION BY scorer, score) - 1) / 2.0::DOUBLE AS rank FROM scores) GROUP BY 1"), "auroc")
def auroc(spark, sf_dir):
    return R.roc_auc(scores(spark, sf_dir), ["scorer"])


PREC = "SELECT scorer, y, row_number() OVER w AS k, sum(y) OVER w AS tp FROM scores WINDOW w AS (PARTITION BY scorer ORDER BY score DESC, unit_id ROWS UNBOUNDED PRECEDING)"


@query("met_02_average_precision", sql("SELECT scorer, avg(tp / k::DOUBLE) FILTER (y = 1) AS average_precision, avg(y) AS base_rate FROM pr GROUP BY 1", pr=PREC), "average_precision base_rate")
def ap(spark, sf_dir):
    return R.average_precision(scores(spark, sf_dir), ["scorer"])


@query("met_03_05_calibration", sql("SELECT scorer, sum(se) / sum(n) AS brier, sum(abs(sp - sy)) / sum(n) AS ece, sum(tn) / sum(neg)::DOUBLE AS specificity FROM (SELECT scorer, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y)**2) AS se, sum((y = 0 AND p < 0.5)::INT) AS tn, sum((y = 0)::INT) AS neg FROM (SELECT scorer, y, least(score / 500, 1.0) AS p FROM scores) GROUP BY 1, 2) GROUP BY 1"), "brier ece specificity")
def calibration(spark, sf_dir):
    return R.calibration(scores(spark, sf_dir).withColumn("p", F.least(F.col("score") / 500, F.lit(1.0))), ["scorer"], "p", "y")


@query("met_06_coverage_at_precision", sql("SELECT scorer, coalesce(max(k) FILTER (tp / k::DOUBLE >= 0.51), 0) / count(*)::DOUBLE AS coverage FROM pr GROUP BY 1", pr=PREC), "coverage")
def coverage(spark, sf_dir):
    return R.coverage_at_precision(scores(spark, sf_dir), ["scorer"], 0.51)


@query("met_07_spearman", sql("SELECT type, count(*) AS n, corr(rx, ry) AS spearman FROM (SELECT type, rank() OVER (PARTITION BY type ORDER BY size) + (count(*) OVER (PARTITION BY type, size) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY type ORDER BY target_effect) + (count(*) OVER (PARTITION BY type, target_effect) - 1) / 2.0::DOUBLE AS ry FROM eu WHERE target_effect IS NOT NULL) GROUP BY 1", eu=EU), "spearman")
def rank_correlation(spark, sf_dir):
    return R.spearman(effect_units(spark, sf_dir), ["type"], "size", "target_effect")


SIG = "SELECT unit_id, scorer, CASE scorer WHEN 'size' THEN size ELSE price END::DOUBLE AS score, target_effect, (target_effect < 0)::INT AS y FROM eu, (VALUES ('size'), ('price')) v(scorer) WHERE target_effect IS NOT NULL"


@query("met_08_signal_audit", sql("""SELECT scorer, units, auroc, average_precision, spearman FROM (SELECT scorer, count(*) AS units, (sum(CASE WHEN y = 1 THEN rx END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS auroc, corr(rx, ry) AS spearman FROM (
  SELECT scorer, y, rank() OVER (PARTITION BY scorer ORDER BY score) + (count(*) OVER (PARTITION BY scorer, score) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY scorer ORDER BY target_effect) + (count(*) OVER (PARTITION BY scorer, target_effect) - 1) / 2.0::DOUBLE AS ry FROM sig) GROUP BY 1)
  JOIN (SELECT scorer, avg(tp / k::DOUBLE) FILTER (y = 1) AS average_precision FROM (SELECT scorer, y, row_number() OVER w AS k, sum(y) OVER w AS tp FROM sig WINDOW w AS (PARTITION BY scorer ORDER BY score DESC, unit_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1) USING (scorer)""", eu=EU, sig=SIG), "auroc average_precision spearman")
def signals(spark, sf_dir):
    e = effect_units(spark, sf_dir)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("scorer"), F.col(c).cast("double").alias("score")) for c in ("size", "price"))))
    return P.signal_audit(e.select("unit_id", cells.alias("x")).select("unit_id", "x.*"), e)


@query("met_09_cross_validated_predictions")
def out_of_fold(spark, sf_dir):
    folds = S.grouped_kfold(units(spark, sf_dir), "cluster_id", 5).select("cluster_id", "fold")
    rows = predictive_pairs(spark, sf_dir).join(folds.hint("merge"), "cluster_id")
    # danger can only befall runs that were right, benefit only those that were wrong
    task = F.when(F.col("control_outcome") == 1, "danger").otherwise("benefit")
    rows = rows.withColumns({"task": task, "y": F.when(F.col("control_outcome") == 1, F.col("danger")).otherwise(F.col("benefit")), "row": F.concat_ws("-", "unit_id", "run_id")})
    p = P.cross_validated_predictions(rows, ["task"], "y", MODELS, "fold", 5, keep=("row",))
    return P.fold_metrics(p, ["task"], [("C", "A"), ("D", "C"), ("E", "D"), ("E", "A")], unit="row")


PRED = "SELECT unit_id, (size % 10) / 10.0::DOUBLE AS pd, (size % 7) / 7.0::DOUBLE AS pb, (target_effect < 0)::INT AS danger, (target_effect > 0)::INT AS benefit FROM eu WHERE target_effect IS NOT NULL"


@query("met_10_benchmark_evaluate", sql("""SELECT task, avg(tp / k::DOUBLE) FILTER (y = 1) AS average_precision, avg(y) AS base_rate, (SELECT count(*) FROM pd WHERE unit_id % 10 = 0) AS missing FROM (
  SELECT task, y, row_number() OVER w AS k, sum(y) OVER w AS tp FROM (SELECT 'danger' AS task, unit_id, pd AS s, danger AS y FROM pd WHERE unit_id % 10 <> 0 UNION ALL SELECT 'benefit', unit_id, pb, benefit FROM pd WHERE unit_id % 10 <> 0) WINDOW w AS (PARTITION BY task ORDER BY s DESC, unit_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1""", eu=EU, pd=PRED), "average_precision base_rate")
def benchmark(spark, sf_dir):
    e = effect_units(spark, sf_dir).where("target_effect is not null")
    hidden = e.select("unit_id", (F.col("target_effect") < 0).cast("int").alias("danger"), (F.col("target_effect") > 0).cast("int").alias("benefit"))
    predictions = e.where("unit_id % 10 <> 0").select("unit_id", ((F.col("size") % 10) / 10.0).alias("p_danger"), ((F.col("size") % 7) / 7.0).alias("p_benefit"))
    return P.benchmark_evaluate(predictions, hidden)


@query("udf_03_ordering_rule", sql(f"SELECT policy, unit_id, row_number() OVER (PARTITION BY policy ORDER BY CASE policy WHEN 'shortest' THEN size ELSE 0 END, CASE policy WHEN 'shortest' THEN 0 ELSE price / size END DESC, {H.format('unit_id')}, unit_id) AS rank FROM units, (VALUES ('shortest'), ('dearest')) v(policy)"))
def own_rules(spark, sf_dir):
    """Orderings that a user brings: a tier and a score as any columns."""
    rules = {"shortest": (F.col("size"), F.lit(0.0)), "dearest": (F.lit(0), F.col("price") / F.col("size"))}
    rows = R.policy_rows(units(spark, sf_dir), rules)
    return R.deterministic_rank(rows, ["policy"], F.col("tier"), F.col("policy_score"), "unit_id").select("policy", "unit_id", "rank")
