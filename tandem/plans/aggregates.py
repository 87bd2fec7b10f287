"""Queries of the aggregates."""

from pyspark.sql import functions as F

from tandem.functions import exprs as X
from tandem.operators import aggregates as A
from tandem.operators import ranking as R
from tandem.operators.joins import pair_runs
from tandem.plans.registry import query
from tandem.plans.views import raters, runs, sql, table, units


def pairs(spark, sf_dir):
    return pair_runs(runs(spark, sf_dir))


def effects(spark, sf_dir):
    return A.unit_effects(runs(spark, sf_dir))


@query("agg_01_unit_effects", sql("SELECT unit_id, cluster_id, control_rate, target_rate, placebo_rate, target_effect, placebo_effect, semantic_effect, (target_effect < 0)::INT AS danger_unit, (target_effect > 0)::INT AS benefit_unit FROM eff"), "control_rate target_rate placebo_rate target_effect placebo_effect semantic_effect")
def unit_effects(spark, sf_dir):
    return effects(spark, sf_dir).drop("control_runs", "target_runs", "placebo_runs")


TRANS = "sum((control = 0 AND target = 1)::INT)::BIGINT AS wrong_to_correct, sum((control = 1 AND target = 0)::INT)::BIGINT AS correct_to_wrong, sum((control = 1 AND target = 1)::INT)::BIGINT AS still_correct, sum((control = 0 AND target = 0)::INT)::BIGINT AS still_wrong"
UNIT_TRANS = f"SELECT unit_id, count(*) AS n, {TRANS}, avg(target_cost - control_cost) AS mean_cost_delta FROM pairs GROUP BY unit_id"


@query("agg_02_unit_transitions", sql("SELECT *, wrong_to_correct - correct_to_wrong AS net_gain, correct_to_wrong / nullif(correct_to_wrong + still_correct, 0)::DOUBLE AS danger_rate, wrong_to_correct / nullif(wrong_to_correct + still_wrong, 0)::DOUBLE AS recovery_rate FROM t", t=UNIT_TRANS), "mean_cost_delta danger_rate recovery_rate")
def unit_transitions(spark, sf_dir):
    return A.unit_transitions(pairs(spark, sf_dir))


@query("exp_08_stability_class", sql("""SELECT unit_id, CASE WHEN wrong_to_correct > 0 AND correct_to_wrong > 0 THEN 'mixed' WHEN wrong_to_correct >= 2 THEN 'strongly_beneficial' WHEN wrong_to_correct > 0 THEN 'weakly_beneficial'
  WHEN correct_to_wrong >= 2 THEN 'strongly_harmful' WHEN correct_to_wrong > 0 THEN 'weakly_harmful' ELSE 'stable' END AS class FROM t""", t=UNIT_TRANS))
def stability(spark, sf_dir):
    return A.unit_transitions(pairs(spark, sf_dir)).select("unit_id", X.stability_class("wrong_to_correct", "correct_to_wrong").alias("class"))


@query("exp_09_conditional_rate", sql("SELECT unit_id, correct_to_wrong / nullif(correct_to_wrong + still_correct, 0)::DOUBLE AS danger_rate FROM t", t=UNIT_TRANS), "danger_rate")
def conditional(spark, sf_dir):
    t = A.unit_transitions(pairs(spark, sf_dir))
    return t.select("unit_id", X.conditional_rate("correct_to_wrong", F.col("correct_to_wrong") + F.col("still_correct")).alias("danger_rate"))


@query("agg_03_collect_cells", sql("""SELECT unit_id, coalesce(array_to_string(list(outcome ORDER BY run_id) FILTER (condition = 'control'), ','), '') AS control_labels, coalesce(array_to_string(list(outcome ORDER BY run_id) FILTER (condition = 'target_delete'), ','), '') AS target_labels, any_value(s) AS status_counts
FROM runs JOIN (SELECT unit_id, string_agg(status || ':' || n, ',' ORDER BY status) AS s FROM (SELECT unit_id, status, count(*) AS n FROM runs GROUP BY ALL) GROUP BY 1) USING (unit_id) GROUP BY unit_id"""))
def cells(spark, sf_dir):
    c = A.collect_cells(runs(spark, sf_dir))
    pairs_ = F.array_join(F.transform(F.map_entries("status_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    text = lambda n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n)
    return c.select("unit_id", text("control_labels"), text("target_labels"), pairs_.alias("status_counts"))


DIMS = {"valence": "valence", "type": "type", "position": "position", "type_position": "type || '|' || position"}
LONG = "SELECT 'overall' AS dimension, 'all' AS \"group\", * FROM eu UNION ALL " + " UNION ALL ".join(f"SELECT '{d}', ({c})::VARCHAR, * FROM eu" for d, c in DIMS.items())
EU = "SELECT e.*, valence, type, position, cell, price, size FROM eff e JOIN units u USING (unit_id)"


def dimensions():
    return {"valence": "valence", "type": "type", "position": "position", "type_position": F.concat_ws("|", "type", "position")}


def effect_units(spark, sf_dir):
    return effects(spark, sf_dir).join(units(spark, sf_dir).drop("cluster_id"), "unit_id")


@query("agg_04_multi_dimension_summary", sql('SELECT dimension, "group", count(*) AS units, avg(target_effect) AS mean_effect FROM long GROUP BY ALL', eu=EU, long=LONG), "mean_effect")
def multi(spark, sf_dir):
    return A.multi_dimension_summary(effect_units(spark, sf_dir), dimensions(), [F.count(F.lit(1)).alias("units"), F.avg("target_effect").alias("mean_effect")])


@query("agg_05_numeric_summary", sql("SELECT condition, count(cost) AS n, avg(cost) AS mean, coalesce(stddev_samp(cost), 0) AS sd, quantile_cont(cost, 0.5) AS median, quantile_cont(cost, 0.25) AS q1, quantile_cont(cost, 0.75) AS q3, quantile_disc(cost, 0.95) AS p95 FROM runs GROUP BY 1"), "mean sd median q1 q3 p95")
def summary(spark, sf_dir):
    return A.numeric_summary(runs(spark, sf_dir), ["condition"], "cost")


@query("agg_06_nearest_rank_percentile", sql("SELECT status, quantile_disc(cost, 0.9) AS p90 FROM runs GROUP BY 1"), "p90")
def nearest(spark, sf_dir):
    return R.order_statistics(runs(spark, sf_dir), ["status"], "cost", p90=("disc", 0.9))


STATS = "count(*) AS n, sum(outcome)::BIGINT AS correct, sum(outcome) * 100 / count(*)::DOUBLE AS accuracy, sum(cost) AS cost_total, avg(cost) AS cost_mean, quantile_cont(cost, 0.5) AS cost_median, quantile_disc(cost, 0.95) AS cost_p95, sum((status='completed')::INT)::BIGINT AS n_completed, sum((status='cannot_continue')::INT)::BIGINT AS n_cannot_continue, sum((status='logical_break')::INT)::BIGINT AS n_logical_break"


@query("agg_07_condition_stats", sql(f"SELECT condition, run_id AS run, {STATS} FROM runs GROUP BY 1, 2 UNION ALL SELECT condition, NULL, {STATS} FROM runs GROUP BY 1"), "accuracy cost_total cost_mean cost_median cost_p95")
def conditions(spark, sf_dir):
    return A.condition_stats(runs(spark, sf_dir))


SAVED = """sum(control_cost - target_cost) AS net_saved, sum(control_cost - target_cost) * 100 / sum(control_cost) AS percent_saved, avg(control_cost - target_cost) AS mean_saved, quantile_cont(control_cost - target_cost, 0.5) AS median_saved,
 sum((control_cost > target_cost)::INT)::BIGINT AS fewer, sum((control_cost = target_cost)::INT)::BIGINT AS same, sum((control_cost < target_cost)::INT)::BIGINT AS more,
 sum((control_status = 'completed' AND target_status <> 'completed')::INT)::BIGINT AS newly_broken, sum((control_status <> 'completed' AND target_status = 'completed')::INT)::BIGINT AS recovered"""


@query("agg_08_cost_savings", sql(f"SELECT run_id, {SAVED} FROM pairs GROUP BY 1"), "net_saved percent_saved mean_saved median_saved")
def savings(spark, sf_dir):
    return A.cost_savings(pairs(spark, sf_dir), ["run_id"])


@query("agg_09_retained_cohort", sql(f"SELECT run_id, {SAVED} FROM pairs WHERE control = 1 OR target = 1 GROUP BY 1"), "net_saved percent_saved mean_saved median_saved")
def retained(spark, sf_dir):
    return A.cost_savings(A.retained_cohort(pairs(spark, sf_dir)), ["run_id"])


@query("agg_10_ratio_metrics", sql("""SELECT type, count(DISTINCT p.cluster_id) AS clusters, count(*) AS pairs, (sum(target) - sum(control)) / count(*)::DOUBLE AS accuracy_change, sum((control=1 AND target=0)::INT) / nullif(sum(control), 0)::DOUBLE AS harm_rate,
  sum((control=0 AND target=1)::INT) / nullif(count(*) - sum(control), 0)::DOUBLE AS recovery_rate, (sum(target_cost) - sum(control_cost)) / nullif(sum(control_cost), 0) AS cost_change FROM pairs p JOIN units USING (unit_id) GROUP BY 1"""), "accuracy_change harm_rate recovery_rate cost_change")
def ratios(spark, sf_dir):
    return A.ratio_metrics(pairs(spark, sf_dir).join(units(spark, sf_dir).select("unit_id", "type"), "unit_id"), ["type"])


GRID = """SELECT a, b, coalesce(n, 0) AS n, sum(coalesce(n,0)) OVER (PARTITION BY a)::BIGINT AS row_total, sum(coalesce(n,0)) OVER (PARTITION BY b)::BIGINT AS col_total, sum(coalesce(n,0)) OVER ()::BIGINT AS total FROM
  (SELECT DISTINCT type AS a FROM units) JOIN (SELECT DISTINCT position AS b FROM units) ON true LEFT JOIN (SELECT type AS a, position AS b, count(*) AS n FROM units GROUP BY ALL) USING (a, b)"""


@query("agg_11_contingency", sql("SELECT a, b, n, row_total, col_total, total, n / total::DOUBLE AS share, n / row_total::DOUBLE AS row_share, row_total * col_total / total::DOUBLE AS expected FROM g", g=GRID), "share row_share expected")
def table_of_levels(spark, sf_dir):
    return A.contingency(units(spark, sf_dir), "type", "position")


@query("agg_12_cramers_v", sql("SELECT chi_square, df, sqrt(chi_square / (total * (least(r, c) - 1))) AS cramers_v, total FROM (SELECT sum((n - row_total*col_total/total::DOUBLE)**2 / (row_total*col_total/total::DOUBLE)) AS chi_square, (count(DISTINCT a)-1)*(count(DISTINCT b)-1) AS df, any_value(total) AS total, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM g)", g=GRID), "chi_square cramers_v")
def cramer(spark, sf_dir):
    return A.chi_square(A.contingency(units(spark, sf_dir), "type", "position"))


CONF = "sum((p AND t)::INT)::BIGINT AS tp, sum((NOT p AND NOT t)::INT)::BIGINT AS tn, sum((p AND NOT t)::INT)::BIGINT AS fp, sum((NOT p AND t)::INT)::BIGINT AS fn"
RATES = "*, (tp+tn)/nullif(tp+tn+fp+fn,0)::DOUBLE AS agreement, tp/nullif(tp+fp,0)::DOUBLE AS precision, tp/nullif(tp+fn,0)::DOUBLE AS recall, 2*tp/nullif(2*tp+fp+fn,0)::DOUBLE AS f1, fp/nullif(fp+tn,0)::DOUBLE AS fpr, fn/nullif(fn+tp,0)::DOUBLE AS fnr"


@query("agg_13_confusion_matrix", sql(f"SELECT {RATES} FROM (SELECT status, {CONF} FROM (SELECT status, cost > 25 AS p, outcome = 1 AS t FROM runs) GROUP BY 1)"), "agreement precision recall f1 fpr fnr")
def confusion(spark, sf_dir):
    return A.confusion_matrix(runs(spark, sf_dir).withColumn("p", (F.col("cost") > 25).cast("int")), "p", "outcome", ["status"])


RP = "SELECT a.item_id, a.rater AS rater_a, b.rater AS rater_b, a.label AS label_a, b.label AS label_b FROM raters a JOIN raters b ON a.item_id = b.item_id AND a.rater < b.rater"


@query("agg_14_rater_agreement", sql("""SELECT rater_a, rater_b, n, agreement, (agreement - e) / nullif(1 - e, 0) AS kappa, (agreement - g) / nullif(1 - g, 0) AS ac1 FROM (
  SELECT *, a0*b0 + a1*b1 AS e, (a0+b0)/2*(1-(a0+b0)/2) + (a1+b1)/2*(1-(a1+b1)/2) AS g FROM (
  SELECT rater_a, rater_b, count(*) AS n, avg((label_a = label_b)::INT) AS agreement, avg((label_a=0)::INT) AS a0, avg((label_a=1)::INT) AS a1, avg((label_b=0)::INT) AS b0, avg((label_b=1)::INT) AS b1 FROM rp GROUP BY 1, 2))""", rp=RP), "agreement kappa ac1")
def agreement(spark, sf_dir):
    return A.rater_agreement(A.rater_pairs(raters(spark, sf_dir)), ["rater_a", "rater_b"], [0, 1])


@query("agg_15_rater_confusion", sql('SELECT rater_a, rater_b, label_a, sum((label_b=0)::INT)::BIGINT AS "0", sum((label_b=1)::INT)::BIGINT AS "1" FROM rp GROUP BY 1,2,3', rp=RP))
def rater_confusion(spark, sf_dir):
    return A.rater_confusion(A.rater_pairs(raters(spark, sf_dir)), [0, 1])


@query("agg_16_consensus", sql("SELECT item_id, rater_a, rater_b, CASE WHEN label_a = label_b THEN label_a END AS label, label_a = label_b AS agreed FROM rp", rp=RP))
def consensus(spark, sf_dir):
    same, other = A.consensus_and_disagreements(A.rater_pairs(raters(spark, sf_dir)))
    return same.select("item_id", "rater_a", "rater_b", "label", F.lit(True).alias("agreed")).unionByName(other.select("item_id", "rater_a", "rater_b", F.lit(None).cast("int").alias("label"), F.lit(False).alias("agreed")))


@query("agg_17_label_validity", sql("SELECT label, count(*) AS units, avg(target_effect) AS mean_effect, avg((target_effect < 0)::INT) AS danger_share, avg((target_effect > 0)::INT) AS benefit_share, avg((label = type)::INT) AS reference_share FROM (SELECT target_effect, type, CASE WHEN unit_id % 4 = 0 THEN 'essential' ELSE type END AS label FROM eu) GROUP BY 1", eu=EU), "mean_effect danger_share benefit_share reference_share")
def validity(spark, sf_dir):
    e = effect_units(spark, sf_dir)
    labels = e.select("unit_id", F.when(F.col("unit_id") % 4 == 0, "essential").otherwise(F.col("type")).alias("label"))
    return A.label_validity(e, labels, "unit_id", "type")


@query("agg_18_label_distribution", sql("""SELECT dimension, "group", count(*) AS n, sum((label=1)::INT)::BIGINT AS strict_n, avg((label=1)::INT) AS strict_rate, avg((label IN (0,1))::INT) AS lenient_rate FROM (
  SELECT 'overall' AS dimension, 'all' AS "group", label FROM raters UNION ALL SELECT 'rater', rater, label FROM raters) GROUP BY 1, 2"""), "strict_rate lenient_rate")
def distribution(spark, sf_dir):
    return A.label_distribution(raters(spark, sf_dir), {"rater": "rater"}, "label", [1], [0, 1])


@query("agg_19_grouped_bias", sql("SELECT rater_a, rater_b, count(*) AS n, avg((label_a = label_b)::INT) AS agreement, avg(label_a) AS rate_a, avg(label_b) AS rate_b, (avg(label_a) - avg(label_b)) * 100 AS bias_pp FROM rp GROUP BY 1, 2", rp=RP), "agreement rate_a rate_b bias_pp")
def bias(spark, sf_dir):
    return A.grouped_bias(A.rater_pairs(raters(spark, sf_dir)), ["rater_a", "rater_b"], "label_a", "label_b")


@query("agg_20_label_change_summary", sql("SELECT rater_a, rater_b, count(*) AS n, sum((label_a=label_b)::INT)::BIGINT AS unchanged, sum((label_a=0 AND label_b=1)::INT)::BIGINT AS up, sum((label_a=1 AND label_b=0)::INT)::BIGINT AS down, avg((label_a=label_b)::INT) AS agreement FROM rp GROUP BY 1, 2", rp=RP), "agreement")
def changes(spark, sf_dir):
    return A.label_change_summary(A.rater_pairs(raters(spark, sf_dir)), ["rater_a", "rater_b"], "label_a", "label_b")


@query("agg_21_frame_counts", sql("SELECT condition, status, count(*) AS n, count(DISTINCT cluster_id) AS clusters, count(*) / sum(count(*)) OVER (PARTITION BY condition)::DOUBLE AS share FROM runs GROUP BY 1, 2"), "share")
def frames(spark, sf_dir):
    return A.frame_counts(runs(spark, sf_dir), "condition", "status", "cluster_id")


WEIGHTS = "SELECT valence, position, natural_share, cohort_share, natural_share / cohort_share AS weight FROM (SELECT valence, position, count(*) / (SELECT count(*) FROM units)::DOUBLE AS natural_share FROM units GROUP BY 1, 2) JOIN (SELECT valence, position, count(*) / (SELECT count(*) FROM units WHERE unit_id % 3 <> 0 OR position = 'late')::DOUBLE AS cohort_share FROM units WHERE unit_id % 3 <> 0 OR position = 'late' GROUP BY 1, 2) USING (valence, position)"


@query("agg_22_prevalence_weights", sql(WEIGHTS), "natural_share cohort_share weight")
def weights(spark, sf_dir):
    u = units(spark, sf_dir)
    return A.prevalence_weights(u, u.where("unit_id % 3 <> 0 or position = 'late'"), ["valence", "position"])


@query("agg_23_weighted_mean", sql("SELECT type, sum(weight * target_effect) / sum(weight) AS weighted_effect, sum(weight * (target_effect < 0)::INT) / sum(weight) AS weighted_danger FROM eu JOIN w USING (valence, position) WHERE target_effect IS NOT NULL GROUP BY 1", eu=EU, w=WEIGHTS), "weighted_effect weighted_danger")
def weighted(spark, sf_dir):
    w = weights(spark, sf_dir).select("valence", "position", "weight")
    e = effect_units(spark, sf_dir).join(w, ["valence", "position"]).withColumn("danger", (F.col("target_effect") < 0).cast("int"))
    return e.groupBy("type").agg(A.weighted_mean("target_effect", "weight").alias("weighted_effect"), A.weighted_mean("danger", "weight").alias("weighted_danger"))


ELIG = "SELECT u.*, (u.unit_id IN (SELECT unit_id FROM runs WHERE condition = 'placebo_delete'))::INT AS eligible FROM units u"


def eligible(spark, sf_dir):
    have = runs(spark, sf_dir).where("condition = 'placebo_delete'").select("unit_id").distinct().withColumn("eligible", F.lit(1))
    return units(spark, sf_dir).join(have, "unit_id", "left").withColumn("eligible", F.coalesce("eligible", F.lit(0)))


SM = "SELECT count(v) FILTER (eligible=1) AS n_1, count(v) FILTER (eligible=0) AS n_0, avg(v) FILTER (eligible=1) AS m1, avg(v) FILTER (eligible=0) AS m0, var_samp(v) FILTER (eligible=1) AS v1, var_samp(v) FILTER (eligible=0) AS v0, avg(v) AS p FROM"


@query("agg_24_smd", sql(f"""SELECT 'pooled' AS form, n_1, n_0, m1 AS mean_1, m0 AS mean_0, m1-m0 AS difference, (m1-m0)/sqrt(((n_1-1)*v1+(n_0-1)*v0)/(n_1+n_0-2)) AS smd FROM ({SM} (SELECT price AS v, eligible FROM el))
UNION ALL SELECT 'average', n_1, n_0, m1, m0, m1-m0, (m1-m0)/sqrt((v1+v0)/2) FROM ({SM} (SELECT price AS v, eligible FROM el)) UNION ALL SELECT 'binary', n_1, n_0, m1, m0, m1-m0, (m1-m0)/sqrt(p*(1-p)) FROM ({SM} (SELECT (type='essential')::INT AS v, eligible FROM el))""", el=ELIG), "mean_1 mean_0 difference smd")
def standardised(spark, sf_dir):
    e = eligible(spark, sf_dir).withColumn("essential", (F.col("type") == "essential").cast("int"))
    parts = [A.smd(e, "eligible", v, f).select(F.lit(f).alias("form"), "*") for f, v in (("pooled", "price"), ("average", "price"), ("binary", "essential"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("agg_25_ks_statistic", sql("SELECT n_1, n_0, max(abs(a/n_1::DOUBLE - b/n_0::DOUBLE)) AS ks FROM (SELECT sum((eligible=1)::INT) OVER (ORDER BY price RANGE UNBOUNDED PRECEDING) AS a, sum((eligible=0)::INT) OVER (ORDER BY price RANGE UNBOUNDED PRECEDING) AS b, sum(eligible) OVER ()::BIGINT AS n_1, sum(1-eligible) OVER ()::BIGINT AS n_0 FROM el) GROUP BY 1, 2", el=ELIG), "ks")
def ks(spark, sf_dir):
    return R.ks_statistic(eligible(spark, sf_dir), "eligible", "price")


@query("agg_26_chi_square_homogeneity", sql("SELECT chi_square, df, sqrt(chi_square/(total*(least(r,c)-1))) AS cramers_v, total FROM (SELECT sum((n - rt*ct/total::DOUBLE)**2/(rt*ct/total::DOUBLE)) AS chi_square, (count(DISTINCT a)-1)*(count(DISTINCT b)-1) AS df, any_value(total) AS total, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS rt, sum(n) OVER (PARTITION BY b) AS ct, sum(n) OVER ()::BIGINT AS total FROM (SELECT eligible AS a, type AS b, count(*) AS n FROM el GROUP BY 1,2)))", el=ELIG), "chi_square cramers_v")
def homogeneity(spark, sf_dir):
    return A.chi_square(A.contingency(eligible(spark, sf_dir), "eligible", "type"))


BAL = f"""SELECT 'price' AS variable, '' AS level, n_1, n_0, m1 AS mean_1, m0 AS mean_0, (m1-m0)/sqrt(((n_1-1)*v1+(n_0-1)*v0)/(n_1+n_0-2)) AS smd FROM ({SM} (SELECT price AS v, eligible FROM el))
UNION ALL SELECT 'size', '', n_1, n_0, m1, m0, (m1-m0)/sqrt(((n_1-1)*v1+(n_0-1)*v0)/(n_1+n_0-2)) FROM ({SM} (SELECT size AS v, eligible FROM el))
UNION ALL SELECT variable, level, n1, n0, k1/n1::DOUBLE, k0/n0::DOUBLE, (k1/n1::DOUBLE - k0/n0::DOUBLE)/sqrt((k1+k0)/(n1+n0)::DOUBLE*(1-(k1+k0)/(n1+n0)::DOUBLE)) FROM (
  SELECT *, sum(k1) OVER (PARTITION BY variable)::BIGINT AS n1, sum(k0) OVER (PARTITION BY variable)::BIGINT AS n0 FROM (SELECT variable, level, sum(eligible)::BIGINT AS k1, sum(1-eligible)::BIGINT AS k0 FROM (SELECT 'type' AS variable, type AS level, eligible FROM el UNION ALL SELECT 'position', position, eligible FROM el) GROUP BY 1,2))"""


@query("agg_27_balance_table", sql("SELECT *, max(abs(smd)) OVER (PARTITION BY variable) AS max_abs_smd, coalesce(max(abs(smd)) OVER (PARTITION BY variable) > 0.1, false) AS imbalanced FROM b", el=ELIG, b=BAL), "mean_1 mean_0 smd max_abs_smd")
def balance(spark, sf_dir):
    return A.balance_table(eligible(spark, sf_dir), "eligible", ["price", "size"], ["type", "position"])


@query("agg_28_group_balance_pairs", sql("SELECT a.g AS g_a, b.g AS g_b, a.n AS n_a, b.n AS n_b, a.m AS mean_a, b.m AS mean_b, (a.m-b.m)/sqrt((a.v+b.v)/2) AS smd FROM s a JOIN s b ON a.g < b.g", s="SELECT type AS g, count(price) AS n, avg(price) AS m, var_samp(price) AS v FROM units GROUP BY 1"), "mean_a mean_b smd")
def group_pairs(spark, sf_dir):
    return A.group_balance_pairs(units(spark, sf_dir), "type", "price")


@query("agg_29_first_by", sql("SELECT unit_id, arg_min(run_id, cost * 1000000 + run_id) AS run_id, arg_min(outcome, cost * 1000000 + run_id) AS outcome FROM runs WHERE condition = 'target_delete' GROUP BY 1"))
def first(spark, sf_dir):
    return A.first_by(runs(spark, sf_dir), ["unit_id"], ["cost", "run_id"], ["run_id", "outcome"], F.col("condition") == "target_delete")


@query("agg_30_case_rule_verification", sql("SELECT unit_id, family, holds FROM (SELECT unit_id, 'danger' AS family, correct_to_wrong > wrong_to_correct AS holds FROM t UNION ALL SELECT unit_id, 'benefit', wrong_to_correct > correct_to_wrong FROM t UNION ALL SELECT unit_id, 'stable', wrong_to_correct + correct_to_wrong = 0 FROM t)", t=UNIT_TRANS))
def case_rules(spark, sf_dir):
    up, down = F.col("wrong_to_correct"), F.col("correct_to_wrong")
    return A.case_rule_verification(A.unit_transitions(pairs(spark, sf_dir)), {"danger": down > up, "benefit": up > down, "stable": up + down == 0}).select("unit_id", "family", "holds")


@query("agg_31_exclusion_bias", sql("SELECT CASE WHEN eligible = 1 THEN 'retained' ELSE 'excluded' END AS status, count(*) AS n, avg(price) AS mean_price, avg((type='essential')::INT) AS essential FROM el GROUP BY 1", el=ELIG), "mean_price essential")
def exclusion(spark, sf_dir):
    return A.exclusion_bias(units(spark, sf_dir), runs(spark, sf_dir).where("condition = 'placebo_delete'"), ["unit_id"], ["price"], {"essential": F.col("type") == "essential"})


@query("agg_32_disambiguate", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN n > 1 THEN k || '#' || n ELSE k END AS unique_key FROM (SELECT *, l_orderkey::VARCHAR AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS n FROM lineitem)")
def unique_keys(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    return A.disambiguate(table(spark, sf_dir, "lineitem"), "l_orderkey", order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "unique_key")


@query("agg_33_paired_mcnemar", sql("SELECT type, b, c, greatest(abs(b - c) - 1, 0)**2 / nullif(b + c, 0)::DOUBLE AS chi_square FROM (SELECT type, sum((control=1 AND target=0)::INT)::BIGINT AS b, sum((control=0 AND target=1)::INT)::BIGINT AS c FROM pairs JOIN units USING (unit_id) GROUP BY 1)"), "chi_square")
def mcnemar(spark, sf_dir):
    return A.paired_mcnemar(pairs(spark, sf_dir).join(units(spark, sf_dir).select("unit_id", "type"), "unit_id"), ["type"])


@query("agg_34_redundancy_prediction", sql(f"SELECT {RATES} FROM (SELECT {CONF} FROM (SELECT type = 'redundant' AS p, NOT (control = 1 AND target = 0) AS t FROM pairs JOIN units USING (unit_id)))"), "agreement precision recall f1 fpr fnr")
def redundancy(spark, sf_dir):
    p = pairs(spark, sf_dir).join(units(spark, sf_dir).select("unit_id", "type"), "unit_id")
    return A.confusion_matrix(p.select((F.col("type") == "redundant").cast("int").alias("p"), (1 - F.col("danger")).alias("t")), "p", "t")
