"""Study views: the given tables read as an experiment. The texts run in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# unit x condition x run, with a binary outcome and a cost
RUNS = """
SELECT unit_id, condition, placebo_index, outcome, cost, cluster_id, status, ts,
  CAST(row_number() OVER (PARTITION BY unit_id, condition ORDER BY l_orderkey, placebo_index, l_suppkey, cost, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, ts) AS BIGINT) AS run_id
FROM (
  SELECT l_partkey AS unit_id,
    CASE WHEN l_returnflag = 'A' THEN 'control' WHEN l_returnflag = 'R' THEN 'target_delete'
         WHEN l_discount < 0.02 THEN 'placebo_delete' WHEN l_discount < 0.05 THEN 'placebo_control' ELSE 'c3_paraphrase' END AS condition,
    l_linenumber AS placebo_index, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS outcome, l_quantity AS cost,
    p_brand || '|' || CAST(p_size AS STRING) AS cluster_id,
    CASE WHEN l_tax < 0.06 THEN 'completed' WHEN l_tax < 0.07 THEN 'cannot_continue' ELSE 'logical_break' END AS status,
    l_shipdate AS ts, l_orderkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
) AS lines
"""

UNITS = """
SELECT p_partkey AS unit_id, p_brand || '|' || CAST(p_size AS STRING) AS cluster_id, p_size AS size, p_retailprice AS price,
  CASE WHEN p_size <= 17 THEN -1 WHEN p_size <= 34 THEN 0 ELSE 1 END AS valence,
  CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'essential' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'redundant' ELSE 'harmful' END AS type,
  CASE WHEN (p_size - 1) / 49.0 < 1 / 3.0 THEN 'early' WHEN (p_size - 1) / 49.0 < 2 / 3.0 THEN 'middle' ELSE 'late' END AS position,
  CASE WHEN p_size <= 17 AND p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'anchor' ELSE 'other' END AS cell
FROM {part}
"""

# pairs of runs of one unit, and effects per unit, for twins only: the library computes them itself
PAIRS = """
SELECT c.unit_id, c.run_id, c.cluster_id, c.outcome AS control, t.outcome AS target, c.cost AS control_cost, t.cost AS target_cost,
  c.status AS control_status, t.status AS target_status
FROM runs c JOIN runs t ON c.unit_id = t.unit_id AND c.run_id = t.run_id AND c.condition = 'control' AND t.condition = 'target_delete'
"""

EFFECTS = """
SELECT unit_id, min(cluster_id) AS cluster_id,
  avg(CASE WHEN condition = 'control' THEN outcome END) AS control_rate,
  avg(CASE WHEN condition = 'target_delete' THEN outcome END) AS target_rate,
  avg(CASE WHEN condition = 'placebo_delete' THEN outcome END) AS placebo_rate,
  avg(CASE WHEN condition = 'target_delete' THEN outcome END) - avg(CASE WHEN condition = 'control' THEN outcome END) AS target_effect,
  avg(CASE WHEN condition = 'placebo_delete' THEN outcome END) - avg(CASE WHEN condition = 'control' THEN outcome END) AS placebo_effect,
  avg(CASE WHEN condition = 'target_delete' THEN outcome END) - avg(CASE WHEN condition = 'placebo_delete' THEN outcome END) AS semantic_effect
FROM runs GROUP BY unit_id
"""

# steps of texts, with one of them chosen
TRAJECTORIES = """
SELECT doc_id AS unit_id, lang, source, steps, CAST(size AS BIGINT) AS n_steps, CAST(doc_id % size AS BIGINT) AS target_index
FROM (SELECT doc_id, lang, source, {split}(text, '{newline}') AS steps, {size}({split}(text, '{newline}')) AS size FROM {documents}) AS d
"""

# two raters of documents and a third that flips every seventh
RATERS = """
SELECT doc_id AS item_id, 'r1' AS rater, CAST(quality AS INT) AS label FROM {labels}
UNION ALL SELECT doc_id, 'r2', CAST(toxic AS INT) FROM {labels}
UNION ALL SELECT doc_id, 'r3', CAST(CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS INT) FROM {labels}
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK_WORDS = {"split": "split", "size": "size", "newline": "\\n"}
DUCK_WORDS = {"split": "string_split", "size": "len", "newline": "\n"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    words = {t: "{" + t + "}" for t in TABLES} | SPARK_WORDS
    own = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.format(**words), **own)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RUNS)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, UNITS)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRAJECTORIES)


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RATERS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order-level scores against a binary outcome (finished or not), for several scorers: (unit_id, scorer, score, y, cluster_id)."""
    o = table(spark, sf_dir, "orders")
    y = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    named = F.explode(F.array(F.struct(F.lit("price").alias("scorer"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score")), F.struct(F.lit("customer").alias("scorer"), (F.col("o_custkey") % 97).cast("double").alias("score"))))
    return o.select(F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 300).alias("cluster_id"), y.alias("y"), named.alias("s")).select("unit_id", "cluster_id", "y", "s.*")


SCORES_SQL = """
SELECT o_orderkey AS unit_id, o_custkey % 300 AS cluster_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, scorer,
  CASE WHEN scorer = 'price' THEN floor(o_totalprice / 1000) ELSE (o_custkey % 97)::DOUBLE END AS score
FROM orders, (VALUES ('price'), ('customer')) v(scorer)
"""


def sql(body: str, **more: str) -> str:
    """A twin's text: the views it names, then `body`."""
    words = {t: t for t in TABLES} | DUCK_WORDS
    known = {"runs": RUNS, "units": UNITS, "traj": TRAJECTORIES, "raters": RATERS, "scores": SCORES_SQL, "pairs": PAIRS, "eff": EFFECTS}
    need = {"pairs": ["runs"], "eff": ["runs"]}
    import re

    text = body + " ".join(more.values())
    wanted = [k for k in known if re.search(rf"\b{k}\b", text)]
    wanted = [k for k in known if k in wanted or any(k in need.get(w, []) for w in wanted)]
    parts = [f"{k} AS ({known[k].format(**words) if k not in ('scores', 'pairs', 'eff') else known[k]})" for k in wanted] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
