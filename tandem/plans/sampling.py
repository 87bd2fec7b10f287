"""Queries of sampling, integrity, sources and streams."""

from pyspark.sql import functions as F

from tandem.functions import exprs as X
from tandem.functions.storage import shared_folder
from tandem.operators import aggregates as A
from tandem.operators import audit as C
from tandem.operators import inference as I
from tandem.operators import sampling as S
from tandem.plans.aggregates import EU, effect_units
from tandem.plans.registry import query
from tandem.plans.views import raters, runs, sql, table, trajectories, units
from tandem.sources import readers as RD
from tandem.sources import sinks as SK
from tandem.streaming import ingest as ST

H = "substr(sha256('{1}|' || {0}), 1, 16)"
SEED = 20260722
h = lambda c, s=SEED: H.format(c, s)
ELIG = "SELECT u.*, (u.unit_id IN (SELECT unit_id FROM runs WHERE condition = 'placebo_delete'))::INT AS eligible FROM units u"


def eligible(spark, sf_dir):
    have = runs(spark, sf_dir).where("condition = 'placebo_delete'").select("unit_id").distinct().withColumn("eligible", F.lit(1))
    return units(spark, sf_dir).join(have, "unit_id", "left").withColumn("eligible", F.coalesce("eligible", F.lit(0)))


@query("smp_01_balanced_cohort", sql(f"SELECT unit_id, valence, position, stratum_order FROM (SELECT *, row_number() OVER (PARTITION BY valence, position ORDER BY {h('unit_id', SEED + 1)}, unit_id)::INT AS stratum_order FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, type ORDER BY {h('unit_id')}, unit_id) AS n FROM units) WHERE n = 1) WHERE stratum_order <= 20"))
def cohort(spark, sf_dir):
    return S.balanced_cohort(units(spark, sf_dir), ["valence", "position"], F.concat_ws("|", "cluster_id", "type"), 20).select("unit_id", "valence", "position", "stratum_order")


QUOTA = "CASE position WHEN 'early' THEN 34 ELSE 33 END"


def quota_sql(source, by=""):
    by_ = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {by_}unit_id, position, CASE WHEN inq THEN 'quota' ELSE 'fill' END AS picked_by, pick_order FROM (SELECT *, row_number() OVER ({part}ORDER BY CASE WHEN inq THEN 0 ELSE 1 END, f, {h('unit_id')}, unit_id)::INT AS pick_order FROM (
  SELECT *, nth <= {QUOTA} AS inq FROM (SELECT *, 1 - eligible AS f, row_number() OVER (PARTITION BY {by_}position ORDER BY 1 - eligible, {h('unit_id')}, unit_id) AS nth FROM {source}) WHERE nth <= 100)) WHERE pick_order <= 100"""


@query("smp_02_quota_sample", sql(quota_sql("el", "type"), el=ELIG))
def quota(spark, sf_dir):
    return S.quota_sample(eligible(spark, sf_dir), "position", ["early", "middle", "late"], 100, "eligible", by="type").select("type", "unit_id", "position", "picked_by", "pick_order")


@query("smp_03_disjoint_groups", sql("SELECT unit_id, CASE WHEN cell = 'anchor' THEN 'anchor' WHEN valence = -1 THEN 'negative' WHEN position = 'late' THEN 'late' ELSE 'rest' END AS grp FROM units"))
def groups(spark, sf_dir):
    g = S.disjoint_groups({"anchor": F.col("cell") == "anchor", "negative": F.col("valence") == -1, "late": F.col("position") == "late"}, "rest")
    return units(spark, sf_dir).select("unit_id", g.alias("grp"))


@query("smp_04_capped_quota_sample", sql(quota_sql("capped"), el=ELIG, capped=f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {h('unit_id')}, unit_id) AS kk FROM el) WHERE kk <= 2"))
def capped(spark, sf_dir):
    return S.capped_quota_sample(eligible(spark, sf_dir), "cluster_id", 2, "position", ["early", "middle", "late"], 100, "eligible").select("unit_id", "position", "picked_by", "pick_order")


OUT = "SELECT unit_id || '-' || condition || '-' || run_id AS output_id, unit_id, condition, outcome, status, cost FROM runs"


def outputs(spark, sf_dir):
    return runs(spark, sf_dir).select(F.concat_ws("-", "unit_id", "condition", "run_id").alias("output_id"), "unit_id", "condition", "outcome", "status", "cost")


def robin(source, size):
    return f"""SELECT output_id, unit_id, condition, round FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY CASE WHEN rep = 1 THEN 0 ELSE 1 END, {h('output_id')}, output_id)::INT AS round FROM (
  SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY {h('output_id')}, output_id) AS rep FROM {source})) ORDER BY round, {h('condition')}, {h('output_id')} LIMIT {size}"""


@query("smp_05_round_robin_balanced", sql(robin("o", 50), o=OUT))
def round_robin(spark, sf_dir):
    return S.round_robin_balanced(outputs(spark, sf_dir), "condition", 50, "output_id").select("output_id", "unit_id", "condition", "round")


@query("smp_06_priority_audit_sample", sql(f"SELECT 'broken' AS audit_stratum, * FROM ({robin('b', 40)}) UNION ALL SELECT 'wrong', * FROM ({robin('w', 30)}) UNION ALL SELECT 'rest', * FROM ({robin('r', 30)})", o=OUT, b="SELECT * FROM o WHERE status = 'logical_break'", w="SELECT * FROM o WHERE status <> 'logical_break' AND outcome = 0", r="SELECT * FROM o WHERE status <> 'logical_break' AND outcome = 1"))
def priority(spark, sf_dir):
    strata = [("broken", F.col("status") == "logical_break", 40), ("wrong", F.col("outcome") == 0, 30), ("rest", F.lit(True), 30)]
    return S.priority_audit_sample(outputs(spark, sf_dir), strata, "condition", "output_id").select("audit_stratum", "output_id", "unit_id", "condition", "round")


@query("smp_07_proportional_sample", sql(f"SELECT type, unit_id, pick_order FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {h('unit_id')}, unit_id)::INT AS pick_order, round(count(*) OVER (PARTITION BY type) * 100 / (count(*) OVER ())::DOUBLE) AS q FROM units) WHERE pick_order <= q"))
def proportional(spark, sf_dir):
    return S.proportional_sample(units(spark, sf_dir), "type", 100).select("type", "unit_id", "pick_order")


@query("smp_08_assign_raters", sql(f"SELECT unit_id, half, unnest(CASE half WHEN 1 THEN ['a','b'] ELSE ['c','d'] END) AS rater FROM (SELECT unit_id, ntile(2) OVER (PARTITION BY position ORDER BY {h('unit_id')}, unit_id)::INT AS half FROM units)"))
def rater_pairs(spark, sf_dir):
    return S.assign_raters(units(spark, sf_dir), "position", list("abcd")).select("unit_id", "half", "rater")


@query("smp_08b_deal_equally", sql(f"SELECT unit_id, ['a','b','c'][(row_number() OVER (PARTITION BY type ORDER BY {h('unit_id')}, unit_id) - 1) % 3 + 1] AS rater FROM units"))
def dealt(spark, sf_dir):
    return S.deal_equally(units(spark, sf_dir), "type", list("abc")).select("unit_id", "rater")


@query("smp_09_blind_order", sql(f"SELECT unit_id, lpad((('0x' || {h('unit_id')})::UBIGINT % 100000000)::VARCHAR, 8, '0') AS blind_id, {h('unit_id')} AS blind_key, (('0x' || {h('unit_id')})::UBIGINT % 1000) < 200 AS dual_coded FROM units"))
def blind(spark, sf_dir):
    return S.blind_order(units(spark, sf_dir).select("unit_id", "type", "valence"), ["type", "valence"])


FOLDS = f"""WITH RECURSIVE g AS (SELECT cluster_id, count(*) AS group_size FROM units GROUP BY 1), o AS (SELECT group_size, row_number() OVER (ORDER BY group_size DESC) AS i FROM g),
step(i, group_size, fold, loads) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::INT, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT o.i, o.group_size, f::INT, list_transform(loads, lambda x, j: CASE WHEN j = f THEN x + o.group_size ELSE x END) FROM (SELECT *, list_position(loads, list_min(loads)) AS f FROM step) s JOIN o ON o.i = s.i + 1
), shares AS (SELECT group_size, fold - 1 AS fold, sum(count(*)) OVER (PARTITION BY group_size ORDER BY fold) AS last, count(*) AS n FROM step WHERE i > 0 GROUP BY group_size, fold)
SELECT r.cluster_id, r.group_size, s.fold::INT AS fold FROM (SELECT *, row_number() OVER (PARTITION BY group_size ORDER BY {h('cluster_id')}, cluster_id) AS nth FROM g) r JOIN shares s ON r.group_size = s.group_size AND r.nth > s.last - s.n AND r.nth <= s.last"""


@query("smp_10_grouped_kfold", sql(FOLDS).replace("WITH units", "WITH RECURSIVE units", 1).replace("\nWITH RECURSIVE g AS", ", g AS", 1))
def kfold(spark, sf_dir):
    return S.grouped_kfold(units(spark, sf_dir), "cluster_id", 5)


@query("smp_11_hash_split", sql("SELECT unit_id, CASE WHEN ('0x' || substr(sha256('s1|' || cluster_id), 1, 16))::UBIGINT % 10 < 7 THEN 'calibration' ELSE 'test' END AS split FROM units"))
def split(spark, sf_dir):
    return S.hash_split(units(spark, sf_dir), "cluster_id", 10, 7, "s1").select("unit_id", "split")


@query("smp_12_package_benchmark", sql(f"SELECT part, unit_id, CASE WHEN part <> 'test_hidden' THEN type END AS type, CASE WHEN part <> 'test_public' THEN target_effect END AS target_effect FROM (SELECT *, CASE WHEN ('0x' || {h('cluster_id')})::UBIGINT % 10 < 7 THEN 'dev' ELSE 'test_public' END AS part FROM eu UNION ALL SELECT *, 'test_hidden' FROM eu WHERE ('0x' || {h('cluster_id')})::UBIGINT % 10 >= 7)", eu=EU), "target_effect")
def packaged(spark, sf_dir):
    parts = S.package_benchmark(effect_units(spark, sf_dir), "cluster_id", ["unit_id", "type"], ["unit_id", "target_effect"])
    none = {"type": F.lit(None).cast("string"), "target_effect": F.lit(None).cast("double")}
    rows = [df.select(F.lit(n).alias("part"), "unit_id", *((F.col(c) if c in df.columns else v).alias(c) for c, v in none.items())) for n, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("chk_01_expect", sql("""SELECT 'runs' AS "check", count(*)::DOUBLE AS observed, 1.0::DOUBLE AS expected, CASE WHEN count(*) = 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM runs
UNION ALL SELECT 'run key', count(*)::DOUBLE, 0, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT 1 FROM runs GROUP BY unit_id, condition, run_id HAVING count(*) > 1)
UNION ALL SELECT 'cluster of unit', count(*)::DOUBLE, 0, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT 1 FROM runs GROUP BY unit_id HAVING min(cluster_id) <> max(cluster_id))
UNION ALL SELECT 'costs', count(*)::DOUBLE, 0, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM runs WHERE cost <= 0"""))
def expectations(spark, sf_dir):
    return C.expect(runs(spark, sf_dir), [("rows", "runs", 1), ("unique", "run key", ["unit_id", "condition", "run_id"]), ("constant", "cluster of unit", "unit_id", "cluster_id"), ("none", "costs", F.col("cost") <= 0)])


@query("chk_02_consistency_report", """SELECT * FROM (VALUES ('identity', 0.0::DOUBLE, 0.0::DOUBLE, 'PASS'), ('range', 0.0, 0.0, 'PASS'), ('estimate_in_interval', 0.0, 0.0, 'PASS')) v("check", observed, expected, status)""")
def consistency(spark, sf_dir):
    e = effect_units(spark, sf_dir)
    s = I.bootstrap_ci(e.where("target_effect is not null"), ["position"], "cluster_id", F.col("target_effect"), F.lit(1), 100, SEED)
    return C.consistency_report(e, s)


@query("chk_03_golden_compare", sql("""SELECT type, 'mean_price' AS value, a AS actual, g AS expected, CASE WHEN abs(a - g) <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT type, avg(price) AS a, round(avg(price)) AS g FROM units GROUP BY 1)"""), "actual expected")
def golden(spark, sf_dir):
    a = units(spark, sf_dir).groupBy("type").agg(F.avg("price").alias("mean_price"))
    return C.golden_compare(a, a.withColumn("mean_price", F.round("mean_price")), ["type"], ["mean_price"], 0.5)


AUD = "SELECT unit_id, run_id, condition, outcome AS judge, CASE WHEN run_id % 11 = 0 THEN 1 - outcome ELSE outcome END AS human FROM runs"


def audited(spark, sf_dir):
    return runs(spark, sf_dir).select("unit_id", "run_id", "condition", "status", "cost", F.col("outcome").alias("judge"), F.when(F.col("run_id") % 11 == 0, 1 - F.col("outcome")).otherwise(F.col("outcome")).alias("human"))


@query("chk_04_audit_gate", sql("SELECT audited, agreement, worst_bias, CASE WHEN agreement < 0.9 OR worst_bias > 0.05 THEN 'HARD_STOP' WHEN agreement >= 0.97 THEN 'UNCONDITIONAL_PASS' ELSE 'PASS_WITH_SENSITIVITY' END AS gate FROM (SELECT sum(n)::BIGINT AS audited, sum(s) / sum(n)::DOUBLE AS agreement, max(abs(b)) AS worst_bias FROM (SELECT condition, count(*) AS n, sum((judge = human)::INT) AS s, avg(judge) - avg(human) AS b FROM aud GROUP BY 1))", aud=AUD), "agreement worst_bias")
def gate(spark, sf_dir):
    return C.audit_gate(audited(spark, sf_dir), "condition", "human", "judge")


@query("chk_05_pair_transition_audit", sql("SELECT unit_id, run_id, h AS human_transition, j AS judge_transition, h = j AS agrees FROM (SELECT a.unit_id, a.run_id, CASE a.human WHEN 1 THEN 'C' ELSE 'W' END || CASE b.human WHEN 1 THEN 'C' ELSE 'W' END AS h, CASE a.judge WHEN 1 THEN 'C' ELSE 'W' END || CASE b.judge WHEN 1 THEN 'C' ELSE 'W' END AS j FROM aud a JOIN aud b ON a.unit_id = b.unit_id AND a.run_id = b.run_id AND a.condition = 'control' AND b.condition = 'target_delete')", aud=AUD))
def pair_audit(spark, sf_dir):
    return C.pair_transition_audit(audited(spark, sf_dir), ["unit_id", "run_id"], "condition", "human", "judge")


@query("chk_06_select_disagreements", sql("SELECT unit_id, run_id, condition FROM aud WHERE judge <> human", aud=AUD))
def disagreements(spark, sf_dir):
    return C.select_disagreements(audited(spark, sf_dir), "human", "judge", ["unit_id", "run_id", "condition"])


@query("chk_07_abnormal_flags", sql("SELECT unit_id, condition, run_id, array_to_string(r, ',') AS reasons, r[1] AS category FROM (SELECT unit_id, condition, run_id, list_filter([CASE WHEN status <> 'completed' THEN 'status:' || status END, CASE WHEN outcome = 0 AND run_id = 1 THEN 'missing_answer' END, CASE WHEN cost > (SELECT quantile_disc(cost, 0.75) FROM runs) THEN 'long' END], lambda x: x IS NOT NULL) AS r FROM runs) WHERE len(r) > 0"))
def abnormal(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("answer", F.when((F.col("outcome") == 0) & (F.col("run_id") == 1), "").otherwise("x"))
    return C.abnormal_flags(r, "answer", "cost").select("unit_id", "condition", "run_id", F.array_join("reasons", ",").alias("reasons"), "category")


def scratch(spark) -> str:
    """A new folder below the shared one, for files that a query writes and reads."""
    return shared_folder(spark, "files")


@query("src_01_csv_strings", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations")
def csv_strings(spark, sf_dir):
    path = scratch(spark)
    RD.write_csv(table(spark, sf_dir, "conversations"), path, ["conv_id", "turn", "role", "text"])
    return RD.read_csv_strings(spark, path)


@query("src_02_jsonl", "SELECT event_id, event_type, value, props FROM events", "value")
def jsonl(spark, sf_dir):
    path = scratch(spark)
    RD.write_jsonl(RD.ordered_columns(table(spark, sf_dir, "events"), ["event_id", "event_type", "value", "props"]), path)
    return RD.read_jsonl(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE, props STRING")


@query("src_03_jsonl_shards", "SELECT event_type, count(*) AS n, sum(CASE WHEN event_id % 3 > 0 THEN event_id END)::BIGINT AS ids FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def shards(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("event_id"), "event_type", F.col("event_type").alias("part")).write.partitionBy("part").json(path)
    df = RD.read_jsonl_shards(spark, [f"{path}/part=click/*.json", f"{path}/part=view/*.json", f"{path}/part=click/*.json"], "event_id BIGINT, event_type STRING")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("src_04_embedded_json", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, ('{' || '\"n\": ' || regexp_extract(html, 'track\\(([0-9]+)\\)', 1) || '}')::JSON ->> 'n' AS n FROM pages")
def embedded(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("doc", F.concat(F.lit("<script id=data>{\"lang\": \""), F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit("\", \"n\": \""), F.regexp_extract("html", r"track\(([0-9]+)\)", 1), F.lit("\"}</script>"), F.col("html")))
    j = RD.embedded_json(F.col("doc"), "<script id=data>", "</script>", "lang STRING, n STRING")
    return p.select("page_id", j.alias("j")).select("page_id", "j.lang", "j.n")


@query("src_05_keyed_documents", "SELECT 'a' || conv_id || '-' || turn AS id, role, length(text)::BIGINT AS chars FROM conversations")
def keyed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("id", F.concat(F.lit("a"), "conv_id", F.lit("-"), "turn"))
    entry = F.struct("id", F.struct("role", F.char_length("text").cast("long").alias("chars")).alias("value"))
    docs = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(entry)).alias("annotations"), F.count(F.lit(1)).alias("n"))
    text = docs.select(F.to_json(F.struct(F.create_map(F.lit("count"), "n").alias("metadata"), "annotations")).alias("text"))
    return RD.keyed_documents(text, "text", "role: STRING, chars: BIGINT").select("id", "value.role", "value.chars")


NEST = "SELECT unit_id AS line, unnest(range(len(steps))) AS step_index, unnest(steps) AS step, target_index FROM traj"


@query("src_06_nested_records", sql("SELECT line, step_index::INT AS step_index, c::INT AS completion_index, c = (step_index % 2) AS is_chosen, CASE c WHEN 0 THEN step ELSE 'alt' END AS text, (CASE c WHEN 0 THEN 1 ELSE -1 END)::INT AS valence FROM n, (VALUES (0), (1)) v(c)", n=NEST))
def nested(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    step = F.transform("steps", lambda s, i: F.struct((i % 2).alias("chosen_completion"), F.array(F.struct(s.alias("text"), F.lit(1).alias("valence")), F.struct(F.lit("alt").alias("text"), F.lit(-1).alias("valence"))).alias("completions")))
    return RD.flatten_nested(t.select("unit_id", step.alias("steps")), "unit_id", "steps")


@query("snk_01_write_csv", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders")
def csv_sink(spark, sf_dir):
    path = scratch(spark)
    RD.write_csv(table(spark, sf_dir, "orders"), path, ["o_orderkey", "o_orderpriority"])
    return RD.read_csv_strings(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"))


@query("snk_02_write_jsonl", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def jsonl_sink(spark, sf_dir):
    path = scratch(spark)
    RD.write_jsonl(table(spark, sf_dir, "customer"), path)
    return RD.read_jsonl(spark, path, "c_custkey BIGINT, c_mktsegment STRING").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def rows_json(column: str) -> str:
    return f"""(SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT '{{"{column}":"' || {column} || '","n":' || count(*) || '}}' AS r FROM runs GROUP BY {column}))"""


@query("snk_03_summary_json", sql(f"""SELECT '{{"conditions":[' || {rows_json('condition')} || '],"statuses":[' || {rows_json('status')} || ']}}' AS document"""))
def summary_json(spark, sf_dir):
    r = runs(spark, sf_dir)
    return RD.summary_document({"conditions": r.groupBy("condition").agg(F.count(F.lit(1)).alias("n")), "statuses": r.groupBy("status").agg(F.count(F.lit(1)).alias("n"))})


@query("snk_04_append_pending", "SELECT key, valence, n FROM (SELECT key, min(valence) AS valence, count(*) FILTER (valence IS NOT NULL) AS n FROM (SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_partkey // 2 END AS key, p_size AS valence FROM part) GROUP BY key)")
def appended(spark, sf_dir):
    """Three batches, the second sent twice: keys repeat inside and across them, and a fifth of the parts has none. The first size of each key stays."""
    p, path = table(spark, sf_dir, "part"), scratch(spark)
    key = F.when(F.col("p_partkey") % 5 != 0, F.floor(F.col("p_partkey") / 2))
    rows = p.select(key.alias("key"), F.col("p_size").alias("valence"))
    least = rows.groupBy("key").agg(F.min("valence").alias("valence"))
    for batch, part in (("a", least.where("key is null or key % 3 = 0")), ("b", rows), ("b", rows), ("c", rows)):
        SK.append_pending(part, path, "key", batch, ["valence"])
    once = SK.read_sink(spark, path, rows.schema).groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("valence").alias("valence"))
    n = rows.groupBy(F.coalesce("key", F.lit(-1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return once.where("times = 1").join(n.hint("merge"), F.coalesce("key", F.lit(-1)) == F.col("k")).select("key", "valence", "n")


@query("snk_05_shard_assign", "SELECT o_orderkey, (o_orderkey % 16)::INT AS shard FROM orders")
def sharded(spark, sf_dir):
    return RD.shard_assign(table(spark, sf_dir, "orders").withColumn("order", F.col("o_orderkey") + 1), "order", 16).select("o_orderkey", "shard")


STREAM = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, task STRING"


def event_files(spark, sf_dir, where: str = "true") -> str:
    """The events as JSON-lines files, each task twice: the second record repeats the key."""
    path = scratch(spark)
    e = table(spark, sf_dir, "events").where(where).withColumn("task", F.concat(F.lit("t"), "event_id"))
    e.unionByName(e.where("event_id % 4 = 0")).repartition(4, "event_id").write.json(path)
    return path


@query("str_01_ingest_runs_stream", "SELECT event_id, user_id, event_type FROM events")
def ingested(spark, sf_dir):
    path, sink = event_files(spark, sf_dir), scratch(spark)
    ST.ingest_runs_stream(spark, path, STREAM, sink, scratch(spark), "task", "ts", "90 days").awaitTermination()
    return spark.read.parquet(sink).select("event_id", "user_id", "event_type")


@query("str_01b_ingest_runs_once", "SELECT event_id, user_id, event_type FROM events")
def ingested_once(spark, sf_dir):
    path, sink, checkpoint = event_files(spark, sf_dir), scratch(spark), scratch(spark)
    for _ in range(2):  # a second start finds all batches committed
        ST.ingest_runs_once(spark, path, STREAM, sink, checkpoint, "task", ["ts", "event_id"], 2).awaitTermination()
    return SK.read_sink(spark, sink, STREAM).select("event_id", "user_id", "event_type")


@query("str_02_verdict_join_stream", "SELECT event_id, CASE WHEN event_type = 'error' THEN false ELSE value > 10 END AS verdict FROM events WHERE event_type = 'error' OR event_id % 3 <> 0")
def judged(spark, sf_dir):
    path = event_files(spark, sf_dir)
    g = ST.first_per_key(ST.read_runs_stream(spark, path, STREAM), "task", "ts", "90 days").withColumn("answer", F.when(F.col("event_type") == "error", "").otherwise("x"))
    verdicts = table(spark, sf_dir, "events").where("event_id % 3 <> 0").select(F.concat(F.lit("t"), "event_id").alias("task"), (F.col("value") > 10).alias("correct"))
    out = scratch(spark)
    ST.verdict_join_stream(g, verdicts, "task", "answer").select("event_id", "verdict").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("str_03_live_unit_counts", "SELECT user_id, event_type, count(*) AS runs, sum((value > 10)::INT)::BIGINT AS correct FROM events GROUP BY 1, 2")
def counted(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "events").repartition(4, "event_id").write.json(path)
    s = ST.read_runs_stream(spark, path, STREAM).withColumn("y", F.col("value") > 10)
    sink = scratch(spark)
    ST.drain_counts(ST.live_unit_counts(s, ["user_id", "event_type"], "y"), sink, scratch(spark))
    return ST.latest_counts(spark, sink, ["user_id", "event_type"])


@query("udf_02_sample_statistic", sql(f"SELECT type, quantile_cont(target_effect, 0.9) - quantile_cont(target_effect, 0.1) AS statistic FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {h('unit_id')}, unit_id) AS n FROM eu WHERE target_effect IS NOT NULL) WHERE n <= 5000 GROUP BY 1", eu=EU), "statistic")
def custom_statistic(spark, sf_dir):
    from tandem.functions.udfs import grouped_statistic

    return grouped_statistic(effect_units(spark, sf_dir).where("target_effect is not null"), ["type"], "target_effect", lambda x: float(x.quantile(0.9) - x.quantile(0.1)))


@query("udf_04_group_membership", sql("SELECT g, count(*) AS units, avg(target_effect) AS mean_effect FROM (SELECT unnest(string_split(type || '|' || position || '|all', '|')) AS g, target_effect FROM eu) GROUP BY 1", eu=EU), "mean_effect")
def membership(spark, sf_dir):
    from tandem.functions.udfs import group_membership

    e = effect_units(spark, sf_dir).withColumn("groups", F.concat_ws("|", "type", "position", F.lit("all")))
    return group_membership(e, "groups", "g").groupBy("g").agg(F.count(F.lit(1)).alias("units"), F.avg("target_effect").alias("mean_effect"))
