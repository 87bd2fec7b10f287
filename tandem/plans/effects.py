"""Queries of resampling inference and effect workflows."""

from pyspark.sql import functions as F

from tandem.functions import exprs as X
from tandem.functions.storage import cut
from tandem.operators import aggregates as A
from tandem.operators import effects as E
from tandem.operators import inference as I
from tandem.operators.joins import pair_runs
from tandem.operators.ranking import rank_tertiles
from tandem.plans.aggregates import EU, LONG, dimensions, effect_units, pairs
from tandem.plans.registry import query
from tandem.plans.views import runs, sql, table, units

REPS, SEED = 200, 20260722


def unit(seed, *parts):
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def weight(seed, rep: str, cluster: str):
    """(Poisson weight of `u`, `u`: the draw of a replicate and a cluster, eight to a hash)."""
    u = f"(('0x' || substr(sha256(concat_ws('|', '{seed}', ({rep} - 1) // {I.DRAWS}, {cluster})), 1 + 8 * (({rep} - 1) % {I.DRAWS}), 8))::BIGINT / 4294967296.0::DOUBLE)"
    return "list_sum([" + ", ".join(f"(u >= {c!r})::INT" for c in I.POISSON) + "])", u


def drawn(sums: str, by: str, num: str = "num", den: str = "den", seed: int = SEED, reps: int = REPS) -> str:
    """Replicate statistics `v` of a table of cluster sums."""
    w, u = weight(seed, "rep", "cluster")
    by_ = f"{by}, " if by else ""
    return f"SELECT {by_}rep, sum(w * {num}) / nullif(sum(w * {den}), 0) AS v FROM (SELECT *, {w} AS w FROM (SELECT s.*, rep, {u} AS u FROM {sums} s, range(1, {reps + 1}) r(rep))) GROUP BY {by_}rep"


def boot(rows: str, by: str, seed: int = SEED, reps: int = REPS, more: dict | None = None, low: str = "quantile_cont(v, 0.025)", **ctes: str) -> str:
    """Twin of bootstrap_ci over rows (by..., cluster, num, den)."""
    by_ = f"{by}, " if by else ""
    using = "JOIN ci ON " + " AND ".join(f"point.{b} IS NOT DISTINCT FROM ci.{b}" for b in by.split(", ")) if by else ", ci"
    return sql(
        f"SELECT {', '.join([*(f'point.{b}' for b in by.split(', ') if by), 'n'])}, clusters, estimate, ci_lower, ci_upper FROM point {using}", **ctes, rows_=rows,
        sums=f"SELECT {by_}cluster, count(*) AS n, sum(num)::DOUBLE AS num, sum(den)::DOUBLE AS den FROM rows_ GROUP BY {by_}cluster",
        point=f"SELECT {by_}sum(n)::BIGINT AS n, count(*) AS clusters, sum(num) / nullif(sum(den), 0) AS estimate FROM sums" + (f" GROUP BY {by}" if by else ""),
        rep_=drawn("sums", by), ci=f"SELECT {by_}quantile_cont(v, 0.025) AS ci_lower, quantile_cont(v, 0.975) AS ci_upper FROM rep_" + (f" GROUP BY {by}" if by else ""),
    )


CI = "estimate ci_lower ci_upper"


@query("inf_01_bootstrap_mean_ci", boot("SELECT valence, unit_id AS cluster, target_effect AS num, 1 AS den FROM eu WHERE target_effect IS NOT NULL", "valence", eu=EU), CI)
def mean_ci(spark, sf_dir):
    return I.bootstrap_ci(effect_units(spark, sf_dir).where("target_effect is not null"), ["valence"], "unit_id", F.col("target_effect"), F.lit(1), REPS, SEED)


@query("inf_02_cluster_bootstrap", boot('SELECT dimension, "group", cluster_id AS cluster, target_effect AS num, 1 AS den FROM long WHERE target_effect IS NOT NULL', 'dimension, "group"', eu=EU, long=LONG), CI)
def cluster_ci(spark, sf_dir):
    rows = A.dimension_rows(effect_units(spark, sf_dir).where("target_effect is not null"), dimensions())
    return I.bootstrap_ci(rows, ["dimension", "group"], "cluster_id", F.col("target_effect"), F.lit(1), REPS, SEED)


NAT = "SELECT *, CASE valence WHEN -1 THEN 0.2 WHEN 0 THEN 1.0 ELSE 1.8 END AS w FROM eu"


@query("inf_03_weighted_bootstrap", boot("SELECT cluster_id AS cluster, w * target_effect AS num, w AS den FROM nat WHERE target_effect IS NOT NULL", "", eu=EU, nat=NAT), CI)
def weighted_ci(spark, sf_dir):
    w = F.when(F.col("valence") == -1, 0.2).when(F.col("valence") == 0, 1.0).otherwise(1.8)
    rows = effect_units(spark, sf_dir).where("target_effect is not null").withColumn("w", w)
    return I.bootstrap_ci(rows, [], "cluster_id", F.col("w") * F.col("target_effect"), F.col("w"), REPS, SEED)


@query("inf_04_stratified_cluster_bootstrap", boot("SELECT tertile, cluster_id AS cluster, target_effect AS num, 1 AS den FROM (SELECT *, floor((row_number() OVER (ORDER BY price, unit_id) - 1) * 3 / (count(*) OVER ()))::INT AS tertile FROM eu) WHERE target_effect IS NOT NULL", "tertile", eu=EU), CI)
def stratified_ci(spark, sf_dir):
    rows = rank_tertiles(effect_units(spark, sf_dir), ["price", "unit_id"]).where("target_effect is not null")
    return I.bootstrap_ci(rows, ["tertile"], "cluster_id", F.col("target_effect"), F.lit(1), REPS, SEED)


def difference_sql(rows, by, **ctes):
    by_ = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    join = f"USING ({by_}rep)"
    both = f"JOIN p0 USING ({by}) JOIN ci USING ({by})" if by else ", p0, ci"
    sums = "SELECT {by}cluster, count(*) AS n, sum(num)::DOUBLE AS num, sum(den)::DOUBLE AS den FROM rows_ WHERE side = {s} GROUP BY {by}cluster"
    point = "SELECT {by}sum(n)::BIGINT AS n_{s}, sum(num) / nullif(sum(den), 0) AS e{s} FROM s{s}" + g
    return sql(
        f"SELECT {by_}n_1, n_0, e1 - e0 AS estimate, ci_lower, ci_upper FROM p1 {both}", **ctes, rows_=rows, s1=sums.format(by=by_, s=1), s0=sums.format(by=by_, s=0), p1=point.format(by=by_, s=1), p0=point.format(by=by_, s=0),
        r1=drawn("s1", by, seed=SEED + 1), r0=drawn("s0", by, seed=SEED), ci=f"SELECT {by_}quantile_cont(r1.v - r0.v, 0.025) AS ci_lower, quantile_cont(r1.v - r0.v, 0.975) AS ci_upper FROM r1 JOIN r0 {join}" + g,
    )


@query("inf_05_bootstrap_difference", difference_sql("SELECT position, unit_id AS cluster, (cell = 'anchor')::INT AS side, target_effect AS num, 1 AS den FROM eu WHERE target_effect IS NOT NULL", "position", eu=EU), CI)
def difference_ci(spark, sf_dir):
    rows = effect_units(spark, sf_dir).where("target_effect is not null").withColumn("side", (F.col("cell") == "anchor").cast("int"))
    return I.bootstrap_difference(rows, ["position"], "side", "unit_id", F.col("target_effect"), F.lit(1), REPS, SEED)


@query("inf_06_bootstrap_multi_effect", sql(
    "SELECT type, effect, clusters, estimate, ci_lower, ci_upper FROM point JOIN ci USING (type, effect)", eu=EU,
    rows_="SELECT type, cluster_id AS cluster, effect, CASE effect WHEN 'target' THEN target_effect ELSE semantic_effect END AS num, 1 AS den FROM eu, (VALUES ('target'), ('semantic')) v(effect) WHERE semantic_effect IS NOT NULL",
    sums="SELECT type, effect, cluster, sum(num) AS num, sum(den)::DOUBLE AS den FROM rows_ GROUP BY ALL", point="SELECT type, effect, count(*) AS clusters, sum(num) / sum(den) AS estimate FROM sums GROUP BY ALL",
    rep_=drawn("sums", "type, effect"), ci="SELECT type, effect, quantile_cont(v, 0.025) AS ci_lower, quantile_cont(v, 0.975) AS ci_upper FROM rep_ GROUP BY ALL"), CI)
def multi_ci(spark, sf_dir):
    rows = effect_units(spark, sf_dir).where("semantic_effect is not null")
    return I.bootstrap_multi(rows, ["type"], "cluster_id", {"target": (F.col("target_effect"), F.lit(1)), "semantic": (F.col("semantic_effect"), F.lit(1))}, REPS, SEED)


@query("inf_07_fold_bootstrap", boot("SELECT fold AS cluster, avg(target_effect) AS num, 1 AS den FROM (SELECT ('0x' || substr(sha256('7|' || cluster_id), 1, 16))::UBIGINT % 5 AS fold, target_effect FROM eff WHERE target_effect IS NOT NULL) GROUP BY 1", ""), CI)
def fold_ci(spark, sf_dir):
    e = A.unit_effects(runs(spark, sf_dir)).where("target_effect is not null").withColumn("fold", X.hash_mod(X.stable_hash("cluster_id", 7), 5))
    return I.bootstrap_ci(e.groupBy("fold").agg(F.avg("target_effect").alias("metric")), [], "fold", F.col("metric"), F.lit(1), REPS, SEED)


ROBUST = "SELECT type, cluster_id AS cluster, sum(target_effect) AS a, count(*)::DOUBLE AS b FROM eu WHERE target_effect IS NOT NULL GROUP BY 1, 2"


@query("inf_08_one_sided_lcb", sql("SELECT type, clusters, estimate, CASE WHEN clusters < 2 THEN -1 ELSE low END AS lcb FROM (SELECT type, count(*) AS clusters, sum(a) / sum(b) AS estimate FROM s GROUP BY 1) JOIN (SELECT type, quantile_cont(v, 0.05) AS low FROM rep_ GROUP BY 1) USING (type)", eu=EU, s=ROBUST, rep_=drawn("s", "type", "a", "b")), "estimate lcb")
def one_sided(spark, sf_dir):
    return I.one_sided_lcb(effect_units(spark, sf_dir).where("target_effect is not null"), ["type"], "cluster_id", F.col("target_effect"), F.lit(1), REPS, SEED)


@query("inf_09_cluster_robust_lcb", sql("SELECT type, m AS clusters, t AS estimate, t - 1.645 * sqrt(m / (m - 1)::DOUBLE * q) / sb AS lcb FROM (SELECT type, any_value(m) AS m, any_value(t) AS t, sum((a - t * b)**2) AS q, any_value(sb) AS sb FROM (SELECT *, count(*) OVER (PARTITION BY type) AS m, sum(a) OVER (PARTITION BY type) / sum(b) OVER (PARTITION BY type) AS t, sum(b) OVER (PARTITION BY type) AS sb FROM s) GROUP BY 1)", eu=EU, s=ROBUST), "estimate lcb")
def robust(spark, sf_dir):
    return I.cluster_robust_lcb(effect_units(spark, sf_dir).where("target_effect is not null"), ["type"], "cluster_id", F.col("target_effect"), F.lit(1))


ANCHOR = "SELECT unit_id, (cell = 'anchor')::INT AS s, target_effect AS x FROM eu WHERE target_effect IS NOT NULL"
RANKED = f"SELECT unit_id, x, rep, row_number() OVER (PARTITION BY rep ORDER BY {unit(SEED, 'rep', 'unit_id')}, unit_id) AS rank FROM a, range(1, 101) r(rep)"


@query("inf_10_permutation_test", sql("""SELECT observed, n1, n, (sum((abs(d) >= abs(observed) - 1e-12)::INT) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM (
  SELECT b.*, sum(x) / n1 - (total - sum(x)) / (n - n1) AS d FROM (SELECT k.*, b.* FROM k, b WHERE rank <= n1) b GROUP BY rep, n1, n, total, observed, b.unit_id IS NULL) GROUP BY 1, 2, 3""".replace("SELECT b.*, sum(x)", "SELECT observed, n1, n, total, sum(x)").replace(", b.unit_id IS NULL", ""), eu=EU, a=ANCHOR, k=RANKED, b="SELECT count(*) FILTER (s = 1) AS n1, count(*) AS n, sum(x) AS total, avg(x) FILTER (s = 1) - avg(x) FILTER (s = 0) AS observed FROM a"), "observed p_value")
def permutation(spark, sf_dir):
    e = effect_units(spark, sf_dir).withColumn("side", (F.col("cell") == "anchor").cast("int"))
    return I.permutation_test(e, "side", "target_effect", "unit_id", 100, SEED)


@query("inf_11_label_permutation_null", sql("""SELECT observed, units, null_mean, null_lower, null_upper FROM (SELECT avg(x) FILTER (cell = 'anchor') - avg(x) FILTER (cell <> 'anchor') AS observed, count(*) AS units FROM a), (
  SELECT avg(v) AS null_mean, quantile_cont(v, 0.025) AS null_lower, quantile_cont(v, 0.975) AS null_upper FROM (SELECT rep, avg(x) FILTER (rank <= n1) - avg(x) FILTER (rank > n1) AS v FROM k, (SELECT count(*) FILTER (cell = 'anchor') AS n1 FROM a) GROUP BY rep))""",
    eu=EU, a="SELECT unit_id, cell, target_effect AS x FROM eu WHERE target_effect IS NOT NULL", k=RANKED), "observed null_mean null_lower null_upper")
def label_null(spark, sf_dir):
    return I.label_permutation_null(effect_units(spark, sf_dir), "unit_id", "cell", "target_effect", "anchor", 100, SEED)


@query("inf_12_ols_cluster_bootstrap", sql("SELECT 'intercept' AS term, regr_intercept(target_effect, size) AS coefficient FROM eu UNION ALL SELECT 'size', regr_slope(target_effect, size) FROM eu", eu=EU), "coefficient")
def ols(spark, sf_dir):
    return I.ols_cluster_bootstrap(effect_units(spark, sf_dir), "target_effect", ["size"], "cluster_id", 50, SEED).select("term", "coefficient")


def elimination(source: str, p: int, right: list[str], keep: str) -> tuple[dict[str, str], str]:
    """CTEs that solve p equations a_i_j with right sides <name>_i: Gauss-Jordan steps, each a select over the one before; and the last one's name."""
    names = [f"a_{{0}}_{j}" for j in range(p)] + [r + "_{0}" for r in right]
    ctes, last = {}, source
    for k in range(p):
        cols = [f"{n.format(k)} / a_{k}_{k} AS {n.format(k)}" if i == k else f"{n.format(i)} - a_{i}_{k} * {n.format(k)} / a_{k}_{k} AS {n.format(i)}" for i in range(p) for n in names]
        ctes[f"{source}_e{k}"] = f"SELECT {keep}{', ' if keep else ''}{', '.join(cols)} FROM {last}"
        last = f"{source}_e{k}"
    return ctes, last


def newton(rows: str, y: str, xs: list[str], l2: float, weight: str, steps: int = 8) -> tuple[dict[str, str], str]:
    """CTEs of a logistic regression by Newton steps over the table `rows`; the last has b_0... in one row."""
    x, p = ["1", *xs], len(xs) + 1
    ctes, last = {"nw_0": "SELECT " + ", ".join(f"0::DOUBLE AS b_{i}" for i in range(p))}, "nw_0"
    for t in range(1, steps + 1):
        eta = " + ".join(f"b_{i} * ({c})" for i, c in enumerate(x))
        v, r = f"greatest(pr * (1 - pr), 1e-7) * ({weight})", f"({y} - pr) * ({weight})"
        sums = [f"sum({v} * ({x[i]}) * ({x[j]})) + {(l2 if i else 1e-8) if i == j else 0}::DOUBLE AS a_{i}_{j}" for i in range(p) for j in range(p)]
        sums += [f"sum({r} * ({x[i]})) - {l2 if i else 0}::DOUBLE * any_value(b_{i}) AS g_{i}" for i in range(p)] + [f"any_value(b_{i}) AS b_{i}" for i in range(p)]
        ctes[f"m{t}"] = f"SELECT {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS pr FROM {rows}, {last})"
        more, end = elimination(f"m{t}", p, ["g"], ", ".join(f"b_{i}" for i in range(p)))
        ctes |= more | {f"nw_{t}": "SELECT " + ", ".join(f"b_{i} + g_{i} AS b_{i}" for i in range(p)) + f" FROM {end}"}
        last = f"nw_{t}"
    return ctes, last


OLS = ["size", "price", "late", "essential"]
OLS_X = ["1", *OLS]
OLS_SUMS = {f"a_{i}_{j}": f"({a}) * ({b})" for i, a in enumerate(OLS_X) for j, b in enumerate(OLS_X)} | {f"g_{i}": f"({a}) * target_effect" for i, a in enumerate(OLS_X)}
OLS_W, OLS_U = weight(SEED, "rep", "cluster")
OLS_STEPS, OLS_END = elimination("sy", len(OLS_X), ["g"], "rep")


@query("inf_12b_ols_intervals", sql(
    " UNION ALL ".join(f"SELECT '{n}' AS term, any_value(g_{i}) FILTER (rep = 0) AS coefficient, quantile_cont(g_{i}, 0.025) FILTER (rep > 0) AS ci_lower, quantile_cont(g_{i}, 0.975) FILTER (rep > 0) AS ci_upper FROM {OLS_END}" for i, n in enumerate(["intercept", *OLS])),
    eu=EU, ox="SELECT *, (position = 'late')::INT AS late, (type = 'essential')::INT AS essential FROM eu WHERE target_effect IS NOT NULL",
    oc="SELECT cluster_id AS cluster, " + ", ".join(f"sum({v})::DOUBLE AS {k}" for k, v in OLS_SUMS.items()) + " FROM ox GROUP BY 1",
    sy="SELECT rep, " + ", ".join(f"sum(w * {k}) AS {k}" for k in OLS_SUMS) + f" FROM (SELECT *, CASE WHEN rep = 0 THEN 1 ELSE {OLS_W} END AS w FROM (SELECT oc.*, rep, {OLS_U} AS u FROM oc, range(0, {REPS + 1}) r(rep))) GROUP BY rep",
    **OLS_STEPS), "coefficient ci_lower ci_upper")
def ols_intervals(spark, sf_dir):
    e = effect_units(spark, sf_dir).withColumns({"late": (F.col("position") == "late").cast("int"), "essential": (F.col("type") == "essential").cast("int")})
    return I.ols_cluster_bootstrap(e, "target_effect", OLS, "cluster_id", REPS, SEED)


def regression_rows(spark, sf_dir):
    r = runs(spark, sf_dir).where("condition in ('control', 'target_delete')").withColumn("deleted", (F.col("condition") == "target_delete").cast("int"))
    u = units(spark, sf_dir).select("unit_id", (F.col("cell") == "anchor").cast("int").alias("anchor"), (F.col("size") / 50).alias("size50"))
    return r.join(u, "unit_id").withColumn("anchor_deleted", F.col("anchor") * F.col("deleted"))


REGRESSION = "SELECT r.outcome, r.cluster_id, (r.condition = 'target_delete')::INT AS deleted, (cell = 'anchor')::INT AS anchor, (cell = 'anchor' AND r.condition = 'target_delete')::INT AS anchor_deleted, size / 50.0::DOUBLE AS size50 FROM runs r JOIN units USING (unit_id) WHERE r.condition IN ('control', 'target_delete')"
LOGIT = ["deleted", "anchor", "anchor_deleted", "size50"]
LOGIT_STEPS, LOGIT_END = newton("rx", "outcome", LOGIT, 1.0, "CASE WHEN outcome = 1 THEN n / (2 * pos) ELSE n / (2 * (n - pos)) END")


@query("inf_13_logistic_fit", sql(" UNION ALL ".join(f"SELECT '{n}' AS term, b_{i} AS coefficient FROM {LOGIT_END}" for i, n in enumerate(["intercept", *LOGIT])),
    rg=REGRESSION, rx="SELECT *, count(*) OVER ()::DOUBLE AS n, sum(outcome) OVER ()::DOUBLE AS pos FROM rg", **LOGIT_STEPS), "coefficient")
def logistic(spark, sf_dir):
    return I.logistic_coefficients(regression_rows(spark, sf_dir), "outcome", LOGIT)


ROBUST_XS = ["deleted", "anchor", "anchor_deleted"]
RX = ["1", *ROBUST_XS]
ROBUST_STEPS, ROBUST_END = newton("rg", "outcome", ROBUST_XS, 1e-6, "1")
ROBUST_P = "1 / (1 + exp(-(" + " + ".join(f"b_{i} * ({x})" for i, x in enumerate(RX)) + ")))"
BREAD_STEPS, BREAD_END = elimination("info", 4, [f"u{j}" for j in range(4)], "")


@query("inf_14_cluster_robust_logit", sql(
    " UNION ALL ".join(f"SELECT '{n}' AS term, b_{i} AS coefficient, se_{i} AS se, exp(b_{i}) AS odds_ratio, exp(b_{i} - 1.96 * se_{i}) AS or_lower, exp(b_{i} + 1.96 * se_{i}) AS or_upper FROM errors, fitted" for i, n in enumerate(["intercept", *ROBUST_XS])),
    rg=REGRESSION, **ROBUST_STEPS, fitted=f"SELECT * FROM {ROBUST_END}", pr=f"SELECT rg.*, {ROBUST_P} AS pr FROM rg, fitted",
    info="SELECT " + ", ".join([f"sum(pr * (1 - pr) * ({a}) * ({b})) AS a_{i}_{j}" for i, a in enumerate(RX) for j, b in enumerate(RX)] + [f"{int(i == j)}::DOUBLE AS u{j}_{i}" for i in range(4) for j in range(4)]) + " FROM pr",
    **BREAD_STEPS, sc="SELECT cluster_id, " + ", ".join(f"sum((outcome - pr) * ({x})) AS s_{i}" for i, x in enumerate(RX)) + " FROM pr GROUP BY 1",
    meat="SELECT count(*) AS m, " + ", ".join(f"sum(s_{i} * s_{j}) AS m_{i}_{j}" for i in range(4) for j in range(4)) + " FROM sc",
    errors="SELECT " + ", ".join(f"sqrt(m / (m - 1)::DOUBLE * ({' + '.join(f'u{j}_{i} * m_{j}_{k} * u{k}_{i}' for j in range(4) for k in range(4))})) AS se_{i}" for i in range(4)) + f" FROM {BREAD_END}, meat"), "coefficient se odds_ratio or_lower or_upper")
def robust_logit(spark, sf_dir):
    return I.cluster_robust_logit(regression_rows(spark, sf_dir), "outcome", ROBUST_XS, "cluster_id")


@query("inf_15_power_grid", sql(f"""SELECT size, scale, count(*) AS sims, avg((abs(m - mean + mean * scale) > 1.96 * sd / sqrt(size))::INT) AS power FROM (
  SELECT size, sim, avg(x) AS m, stddev_samp(x) AS sd FROM (SELECT size, sim, floor({unit(SEED, 'size', 'sim', 'draw')} * (SELECT count(*) FROM a))::BIGINT AS i FROM (VALUES (50), (100)) v(size), range(1, 101) t(sim), (SELECT unnest(range(1, 101)) AS draw) WHERE draw <= size) JOIN (SELECT x, row_number() OVER (ORDER BY unit_id) - 1 AS i FROM a) USING (i) GROUP BY 1, 2), (SELECT avg(x) AS mean FROM a), (VALUES (1.0::DOUBLE), (2.0)) c(scale) GROUP BY 1, 2""",
    a="SELECT unit_id, target_effect AS x FROM eff WHERE target_effect IS NOT NULL"), "power scale")
def power(spark, sf_dir):
    return I.power_grid(A.unit_effects(runs(spark, sf_dir)), "target_effect", [50, 100], [1.0, 2.0], 100, SEED)


ESTIMANDS = ("target_effect", "placebo_effect", "semantic_effect")


@query("eff_01_effect_summary", sql('SELECT dimension, "group", estimand, n AS units, estimate * 100 AS estimate_pp, ci_lower * 100 AS ci_lower_pp, ci_upper * 100 AS ci_upper_pp FROM point JOIN ci USING (dimension, "group", estimand) WHERE n >= 10', eu=EU, long=LONG,
    rows_='SELECT dimension, "group", estimand, cluster_id AS cluster, CASE estimand WHEN \'target_effect\' THEN target_effect WHEN \'placebo_effect\' THEN placebo_effect ELSE semantic_effect END AS num FROM long, (VALUES (\'target_effect\'), (\'placebo_effect\'), (\'semantic_effect\')) v(estimand)',
    sums='SELECT dimension, "group", estimand, cluster, count(*) AS n, sum(num) AS num, count(*)::DOUBLE AS den FROM rows_ WHERE num IS NOT NULL GROUP BY ALL', point='SELECT dimension, "group", estimand, sum(n)::BIGINT AS n, sum(num) / sum(den) AS estimate FROM sums GROUP BY ALL',
    rep_=drawn("sums", 'dimension, "group", estimand'), ci='SELECT dimension, "group", estimand, quantile_cont(v, 0.025) AS ci_lower, quantile_cont(v, 0.975) AS ci_upper FROM rep_ GROUP BY ALL'), "estimate_pp ci_lower_pp ci_upper_pp")
def effect_summary(spark, sf_dir):
    e = effect_units(spark, sf_dir).withColumn("type_position", F.concat_ws("|", "type", "position"))
    return E.effect_summary(e, {d: d for d in ("valence", "type", "position", "type_position")}, list(ESTIMANDS), reps=REPS, seed=SEED)


DID = """SELECT e.unit_id, cluster_id, target_effect, placebo_effect AS placebo_legacy_effect, own AS placebo_own_effect, n AS cut_offs, target_effect - own AS did_semantic_effect, target_effect - placebo_effect AS legacy_semantic_effect FROM eff e JOIN (
  SELECT unit_id, avg(p - o) AS own, count(*) AS n FROM (SELECT unit_id, placebo_index, avg(outcome) AS p FROM runs WHERE condition = 'placebo_delete' GROUP BY ALL) JOIN (SELECT unit_id, placebo_index, avg(outcome) AS o FROM runs WHERE condition = 'placebo_control' GROUP BY ALL) USING (unit_id, placebo_index) GROUP BY 1) USING (unit_id)"""


@query("eff_02_did_effects", sql(f"SELECT unit_id, cluster_id, target_effect, placebo_legacy_effect, placebo_own_effect, cut_offs, did_semantic_effect, legacy_semantic_effect FROM ({DID})"), "target_effect placebo_legacy_effect placebo_own_effect did_semantic_effect legacy_semantic_effect")
def did(spark, sf_dir):
    return E.did_effects(runs(spark, sf_dir))


@query("eff_03_condition_contrasts", sql("SELECT unit_id, min(cluster_id) AS cluster_id, r('target_delete') - r('control') AS c1_c0, r('target_delete') - r('placebo_delete') AS c1_c2, r('c3_paraphrase') - r('control') AS c3_c0, r('target_delete') - r('c3_paraphrase') AS c1_c3 FROM runs GROUP BY 1".replace("r('", "avg(outcome) FILTER (condition = '")), "c1_c0 c1_c2 c3_c0 c1_c3")
def contrasts(spark, sf_dir):
    t, c, p, q = "target_delete", "control", "placebo_delete", "c3_paraphrase"
    return E.condition_contrasts(runs(spark, sf_dir), {"c1_c0": (t, c), "c1_c2": (t, p), "c3_c0": (q, c), "c1_c3": (t, q)})


HALF = "SELECT unit_id, avg(outcome) FILTER (condition = 'target_delete') - avg(outcome) FILTER (condition = 'control') AS e, avg(outcome) FILTER (condition = 'control') AS c FROM runs WHERE placebo_index % 2 = {} GROUP BY 1"


@query("eff_04_cross_source_interaction", sql("SELECT count(*) AS units, avg(va) AS mean_a, avg(vb) AS mean_b, avg(vb - va) AS difference, avg(vb - va) FILTER (i) - avg(vb - va) FILTER (NOT i) AS interaction, avg(va) FILTER (i) AS mean_a_level, avg(vb) FILTER (i) AS mean_b_level FROM (SELECT a.e AS va, b.e AS vb, cell = 'anchor' AS i FROM a JOIN b USING (unit_id) JOIN units USING (unit_id)) WHERE va IS NOT NULL AND vb IS NOT NULL", a=HALF.format(0), b=HALF.format(1)), "mean_a mean_b difference interaction mean_a_level mean_b_level")
def interaction(spark, sf_dir):
    r = runs(spark, sf_dir)
    a, b = (A.unit_effects(r.where(F.col("placebo_index") % 2 == k)).join(units(spark, sf_dir).select("unit_id", "cell"), "unit_id") for k in (0, 1))
    return E.cross_source_interaction(a, b, "cell", "anchor", "target_effect")


@query("eff_05_mode_toggle_contrast", sql("SELECT count(*) AS units, avg(ca) AS control_a, avg(cb) AS control_b, avg(ea) AS effect_a, avg(eb) AS effect_b, avg((ea <> 0)::INT) AS nonzero_a, avg((eb <> 0)::INT) AS nonzero_b, avg((sign(ea) = sign(eb))::INT) FILTER (ea <> 0 AND eb <> 0) AS sign_agreement FROM (SELECT a.e AS ea, b.e AS eb, a.c AS ca, b.c AS cb FROM a JOIN b USING (unit_id)) WHERE ea IS NOT NULL AND eb IS NOT NULL", a=HALF.format(0), b=HALF.format(1)), "control_a control_b effect_a effect_b nonzero_a nonzero_b sign_agreement")
def toggle(spark, sf_dir):
    r = runs(spark, sf_dir)
    return E.mode_toggle_contrast(*(r.where(F.col("placebo_index") % 2 == k) for k in (0, 1)))


RE = "SELECT *, CASE WHEN run_id % 7 = 0 THEN 1 - outcome ELSE outcome END AS re FROM runs"


def mean_effect(col, by="unit_id"):
    return f"SELECT avg(t - c) AS te, avg(t - p) AS se FROM (SELECT {by}, avg({col}) FILTER (condition='target_delete') AS t, avg({col}) FILTER (condition='control') AS c, avg({col}) FILTER (condition='placebo_delete') AS p FROM re GROUP BY 1)"


@query("eff_06_regrade_sensitivity", sql("SELECT runs, agreement, a.te AS effect_first, a.se AS semantic_first, b.te AS effect_second, b.se AS semantic_second, abs(b.te - a.te) AS effect_change, abs(b.se - a.se) AS semantic_change FROM (SELECT count(*) AS runs, avg((re = outcome)::INT) AS agreement FROM re), a, b", re=RE, a=mean_effect("outcome"), b=mean_effect("re")), "agreement effect_first semantic_first effect_second semantic_second effect_change semantic_change")
def regrade(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("re", F.when(F.col("run_id") % 7 == 0, 1 - F.col("outcome")).otherwise(F.col("outcome")))
    return E.regrade_sensitivity(r, "re")


@query("eff_07_label_substitution", sql("SELECT condition, count(*) AS runs, count(*) FILTER (run_id % 5 = 0) AS audited, avg(outcome) AS rate_before, avg(CASE WHEN run_id % 5 = 0 THEN (cost > 20)::INT ELSE outcome END) AS rate_after, (avg(CASE WHEN run_id % 5 = 0 THEN (cost > 20)::INT ELSE outcome END) - avg(outcome)) * 100 AS change_pp FROM runs GROUP BY 1"), "rate_before rate_after change_pp")
def substitution(spark, sf_dir):
    r = runs(spark, sf_dir)
    audited = r.where("run_id % 5 = 0").select("unit_id", "condition", "run_id", (F.col("cost") > 20).cast("int").alias("label"))
    return E.label_substitution_sensitivity(r, audited, ["unit_id", "condition", "run_id"])


@query("eff_08_label_set_robustness", boot("SELECT label_pass, label, cluster_unit, cluster, target_effect AS num, 1 AS den FROM (SELECT target_effect, label_pass, CASE label_pass WHEN 'type' THEN type ELSE type2 END AS label, cluster_unit, CASE cluster_unit WHEN 'unit_id' THEN unit_id::VARCHAR ELSE cluster_id END AS cluster FROM (SELECT *, CASE WHEN unit_id % 10 = 0 THEN 'harmful' ELSE type END AS type2 FROM eu), (VALUES ('type'), ('type2')) p(label_pass), (VALUES ('unit_id'), ('cluster_id')) c(cluster_unit)) WHERE target_effect IS NOT NULL", "label_pass, label, cluster_unit", eu=EU), CI)
def robustness(spark, sf_dir):
    e = effect_units(spark, sf_dir).withColumn("type2", F.when(F.col("unit_id") % 10 == 0, "harmful").otherwise(F.col("type")))
    return E.label_set_robustness(e, ["type", "type2"], ["unit_id", "cluster_id"], "target_effect", REPS, SEED)


@query("eff_09_group_by_position", sql("SELECT position, units, inside, outside, inside - outside AS contrast, inside - outside - (SELECT arg_min(inside - outside, position) FROM p) AS difference_to_first FROM p", eu=EU, p="SELECT position, count(*) AS units, avg(target_effect) FILTER (type = 'essential') AS inside, avg(target_effect) FILTER (type <> 'essential') AS outside FROM eu WHERE target_effect IS NOT NULL GROUP BY 1"), "inside outside contrast difference_to_first")
def by_position(spark, sf_dir):
    return E.group_by_position_interaction(effect_units(spark, sf_dir), "type", "essential", "position", "target_effect")


SEL = "SELECT statistic, unit_id AS cluster, (placebo_effect IS NOT NULL)::INT AS side, CASE statistic WHEN 'price' THEN price WHEN 'effect' THEN target_effect ELSE (type = 'essential')::INT END AS num, 1 AS den FROM eu, (VALUES ('price'), ('effect'), ('essential')) v(statistic) WHERE target_effect IS NOT NULL"


@query("eff_10_selection_effect_differences", difference_sql(SEL, "statistic", eu=EU), CI)
def selection(spark, sf_dir):
    e = effect_units(spark, sf_dir).where("target_effect is not null").withColumn("eligible", F.col("placebo_effect").isNotNull())
    one = F.lit(1)
    return E.selection_effect_differences(e, "eligible", {"price": (F.col("price"), one), "effect": (F.col("target_effect"), one), "essential": ((F.col("type") == "essential").cast("int"), one)}, REPS, SEED)


@query("eff_11_prevalence_reweighted", sql("SELECT count(*) AS units, avg(target_effect) AS balanced_effect, sum(w * target_effect) / sum(w) FILTER (target_effect IS NOT NULL) AS natural_effect, sum(w) AS total_weight FROM co JOIN (SELECT valence, n.s / c.s AS w FROM (SELECT valence, count(*) / (SELECT count(*) FROM units)::DOUBLE AS s FROM units GROUP BY 1) n JOIN (SELECT valence, count(*) / (SELECT count(*) FROM co)::DOUBLE AS s FROM co GROUP BY 1) c USING (valence)) USING (valence)", eu=EU, co="SELECT * FROM eu WHERE unit_id % 3 = 0 OR valence = -1"), "balanced_effect natural_effect total_weight")
def reweighted(spark, sf_dir):
    return E.prevalence_reweighted_effects(effect_units(spark, sf_dir).where("unit_id % 3 = 0 or valence = -1"), units(spark, sf_dir), ["valence"], "target_effect")


@query("eff_12_discordance_rates", sql("SELECT run_id, count(*) AS pairs, sum((control=1 AND target=0)::INT) / count(*)::DOUBLE AS joint_danger, sum((control=1 AND target=0)::INT) / nullif(sum(control), 0)::DOUBLE AS danger_given_correct, sum((control=0 AND target=1)::INT) / count(*)::DOUBLE AS joint_benefit, sum((control=0 AND target=1)::INT) / nullif(count(*) - sum(control), 0)::DOUBLE AS benefit_given_wrong FROM pairs GROUP BY 1"), "joint_danger danger_given_correct joint_benefit benefit_given_wrong")
def discordance(spark, sf_dir):
    return E.discordance_rates(pairs(spark, sf_dir), ["run_id"])


@query("eff_13_figure_source", sql("""SELECT 'group' AS layer, nth::INT AS nth, position AS "group", avg(target_effect) AS y, 0.0::DOUBLE AS x FROM eu JOIN (VALUES (0, 'early'), (1, 'late')) w(nth, position) USING (position) GROUP BY nth, position
UNION ALL SELECT 'unit', nth, position, target_effect, ((('0x' || substr(sha256('5|' || unit_id), 1, 16))::UBIGINT % 1000) / 1000.0::DOUBLE - 0.5) * 0.22 FROM eu JOIN (VALUES (0, 'early'), (1, 'late')) w(nth, position) USING (position) WHERE target_effect IS NOT NULL""", eu=EU), "x y")
def figure(spark, sf_dir):
    e = effect_units(spark, sf_dir).where("target_effect is not null")
    s = A.multi_dimension_summary(e, {"position": "position"}, [F.count(F.lit(1)).alias("n"), F.avg("target_effect").alias("estimate")])
    points = e.select(F.col("position").alias("group"), F.col("target_effect").alias("y"), X.hash_jitter("unit_id", 5).alias("x"))
    return E.figure_source(s, [("position", "early"), ("position", "late")], points)


@query("exp_23_standardize", sql("SELECT p.unit_id, p.fold, (p.price - m) / CASE WHEN s <= 1e-6 OR s IS NULL THEN 1 ELSE s END AS z FROM p JOIN (SELECT f AS fold, avg(price) AS m, stddev_pop(price) AS s FROM p, range(5) r(f) WHERE fold <> f GROUP BY 1) USING (fold)", p="SELECT unit_id, price, (('0x' || substr(sha256('7|' || cluster_id), 1, 16))::UBIGINT % 5)::BIGINT AS fold FROM units"), "z")
def standardized(spark, sf_dir):
    from tandem.operators.predict import standardize

    u = units(spark, sf_dir).withColumn("fold", X.hash_mod(X.stable_hash("cluster_id", 7), 5))
    return standardize(u, "fold", ["price"], 5).select("unit_id", "fold", F.col("price_z").alias("z"))


@query("exp_22_feature_matrix", sql("SELECT unit_id, (valence = -1)::INT AS neg, (position = 'late')::INT AS late, (valence = -1 AND position = 'late')::INT AS neg_late, ln(1 + price) AS log_price FROM units"), "log_price")
def features(spark, sf_dir):
    from tandem.operators.predict import feature_columns

    cols = feature_columns({"neg": F.col("valence") == -1, "late": F.col("position") == "late"}, [("neg", "late")], {"log_price": F.col("price")})
    return units(spark, sf_dir).select("unit_id", *(c.alias(n) for n, c in cols.items()))


@query("exp_24_combine_scores", sql("SELECT vec_id AS unit_id, list_avg(s) AS mean_score, list_max(s) - list_min(s) AS spread, list_stddev_samp(s) AS disagreement FROM (SELECT vec_id, [embedding[1]::DOUBLE, -embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS s FROM embeddings WHERE len(embedding) >= 3)"), "mean_score spread disagreement")
def combined(spark, sf_dir):
    from tandem.operators.predict import combine_scores

    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 3)
    long = e.select(F.col("vec_id").alias("unit_id"), F.posexplode(F.slice("embedding", 1, 3)).alias("scorer", "score"))
    return combine_scores(long.withColumn("score", F.col("score").cast("double")), 3, {1: -1.0})


@query("udf_01_sum_expressions", boot("SELECT type, cluster_id AS cluster, CASE WHEN target_effect < 0 THEN size ELSE 0 END AS num, size AS den FROM eu WHERE target_effect IS NOT NULL", "type", eu=EU), CI)
def own_statistic(spark, sf_dir):
    """A statistic that a user brings as two sum expressions: the share of all steps in units that lost."""
    rows = effect_units(spark, sf_dir).where("target_effect is not null")
    return I.bootstrap_ci(rows, ["type"], "cluster_id", F.when(F.col("target_effect") < 0, F.col("size")).otherwise(0), F.col("size"), REPS, SEED)
