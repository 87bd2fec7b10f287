"""Queries of the scalar expressions."""

from pyspark.sql import functions as F

from tandem.functions import exprs as X
from tandem.plans.registry import query
from tandem.plans.views import sql, table, trajectories

BARE = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
RAW = """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,
  CASE l_linenumber % 5 WHEN 0 THEN chr(10) WHEN 1 THEN ' ' || CAST(l_quantity AS STRING) || chr(13) || chr(10) WHEN 2 THEN chr(9) || 'Yes' || chr(10) WHEN 3 THEN '-' || CAST(l_quantity AS STRING) || chr(9) ELSE 'n/a' END AS raw FROM {lineitem}"""


def raw(spark, sf_dir):
    return spark.sql(RAW, lineitem=table(spark, sf_dir, "lineitem"))


RAW_SQL = RAW.format(lineitem="lineitem")


@query("exp_01_casts", f"""
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, try_cast(nullif({BARE.format('raw')}, '') AS DOUBLE) AS as_float,
  coalesce(trunc(try_cast(nullif({BARE.format('raw')}, '') AS DOUBLE))::BIGINT, 0) AS as_int, coalesce(lower({BARE.format('raw')}) IN ('1','true','yes','y'), false) AS as_bool
FROM ({RAW_SQL})""")
def casts(spark, sf_dir):
    return raw(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", X.as_float("raw").alias("as_float"), X.as_int("raw", 0).alias("as_int"), X.as_bool("raw").alias("as_bool"))


@query("exp_02_strict_bool", "SELECT l_orderkey, l_partkey, l_linenumber, l_linestatus = 'F' AS flag FROM lineitem")
def strict_bool(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("raw", F.when(F.col("l_linestatus") == "F", " TRUE\n").otherwise("no\t\r\n"))
    return df.select("l_orderkey", "l_partkey", "l_linenumber", X.parse_bool_strict("raw").alias("flag"))


@query("exp_03_normalize_space", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalize_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_space("text").alias("text"))


@query("exp_04_stable_hash", "SELECT p_partkey, substr(sha256('7|' || p_partkey), 1, 16) AS h, (('0x' || substr(sha256('7|' || p_partkey), 1, 16))::UBIGINT % 1000)::BIGINT AS m FROM part")
def hashes(spark, sf_dir):
    h = X.stable_hash("p_partkey", 7)
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("h"), X.hash_mod(h, 1000).alias("m"))


@query("exp_05_stable_id", "SELECT p_partkey, 'unit-' || substr(sha256(p_partkey || '|' || p_brand || '|' || p_type), 1, 16) AS id FROM part")
def ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.stable_id("unit", "p_partkey", "p_brand", "p_type").alias("id"))


POSITION = "CASE WHEN {n} <= 1 THEN 'early' WHEN {i} / ({n} - 1)::DOUBLE < 1/3.0 THEN 'early' WHEN {i} / ({n} - 1)::DOUBLE < 2/3.0 THEN 'middle' ELSE 'late' END"


@query("exp_06_position_bin", sql(f"SELECT unit_id, {POSITION.format(i='target_index', n='n_steps')} AS position FROM traj"))
def positions(spark, sf_dir):
    return trajectories(spark, sf_dir).select("unit_id", X.position_bin("target_index", "n_steps").alias("position"))


def nested(c: str, rules) -> str:
    """`c` through regexp_replace for each (pattern, replacement) in turn."""
    for pattern, put in rules:
        c = f"regexp_replace({c}, '{pattern}', '{put}', 'g')"
    return c


def normal(c: str) -> str:
    bare = BARE.format(c)
    inner = f"CASE WHEN regexp_matches({bare}, '{X.BOXED}') THEN regexp_extract({bare}, '{X.BOXED}', 1) ELSE {bare} END"
    dollar = lambda rules: [(p, put.replace("$1", "\\1").replace("$2", "\\2")) for p, put in rules]
    return nested(f"lower({nested(inner, [(X.NO_MEANING, ''), *dollar(X.ANSWER_FORMS)])})", dollar(X.NUMBER_FORMS))


ANSWER_CASES = (
    r"""'\boxed{\frac{1}{' || (o_custkey % 9) || '}}'""", r"""chr(9) || ' 1,' || (100 + o_custkey % 900) || '.50' || chr(10)""", r"""'0.5' || (o_custkey % 9) || '.'""",
    r"""'$' || (o_custkey % 50) || '.0 \text{ cm}$'""", r"""'so \boxed{\sqrt' || (o_custkey % 7) || '\pi} holds'""", r"""'\dfrac{a+b}{c} \cdot ' || (o_custkey % 5) || '^{\circ}'""",
    r"""'\left( x \times \sqrt{2} \right) = \infty'""", "''",
)
ANSWER = "CASE " + " ".join(f"WHEN o_orderkey % {len(ANSWER_CASES)} = {i} THEN {c}" for i, c in enumerate(ANSWER_CASES)) + " END"


def answers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(ANSWER.replace("\\", "\\\\")).alias("answer"))


@query("exp_10_normalize_answer", f"SELECT o_orderkey, {normal('answer')} AS plain FROM (SELECT o_orderkey, {ANSWER} AS answer FROM orders)")
def plain_answers(spark, sf_dir):
    return answers(spark, sf_dir).select("o_orderkey", X.normalize_answer("answer").alias("plain"))


@query("exp_11_grade_exact", f"""
SELECT o_orderkey, CASE WHEN answer IS NULL OR {normal('answer')} = '' THEN 'no_answer' WHEN {normal('answer')} = {normal('truth')} THEN 'string_match' ELSE 'mismatch' END AS tier
FROM (SELECT o_orderkey, {ANSWER} AS answer, '(1)/(' || (o_custkey % 9) || ')' AS truth FROM orders)""")
def graded(spark, sf_dir):
    truth = F.concat(F.lit("(1)/("), (F.col("o_custkey") % 9).cast("string"), F.lit(")"))
    return answers(spark, sf_dir).select("o_orderkey", X.grade_exact("answer", truth).alias("tier"))


@query("exp_12_extract_answer", r"""
SELECT o_orderkey, coalesce(regexp_extract_all(reply, '\\boxed\{([^{}]*)\}', 1)[-1], nullif(regexp_extract(reply, '(?i)answer is:?\s*([^\s.,;]+)', 1), '')) AS answer
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'first \boxed{1} then \boxed{' || o_custkey || '} end' WHEN 1 THEN 'The Answer is: ' || o_custkey || '.' ELSE o_orderpriority END AS reply FROM orders)""")
def extracted(spark, sf_dir):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    reply = F.when(k == 0, F.concat(F.lit("first \\boxed{1} then \\boxed{"), c, F.lit("} end"))).when(k == 1, F.concat(F.lit("The Answer is: "), c, F.lit("."))).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.extract_answer(reply).alias("answer"))


@query("exp_12b_extract_balanced", r"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '\frac{' || o_custkey || '}{2}' WHEN 1 THEN repeat('{', (o_custkey % 40)::INT) || 'é' || repeat('}', (o_custkey % 40)::INT) WHEN 2 THEN '' END AS answer FROM orders")
def balanced(spark, sf_dir):
    c = F.col("o_custkey").cast("string")
    deep = F.repeat(F.lit("{"), (F.col("o_custkey") % 40).cast("int"))
    nested = F.concat(F.lit("\\boxed{no} then \\boxed{"), deep, F.lit("é"), F.repeat(F.lit("}"), (F.col("o_custkey") % 40).cast("int")), F.lit("} and }} more"))
    k = F.col("o_orderkey") % 4
    reply = F.when(k == 0, F.concat(F.lit("so \\boxed{\\frac{"), c, F.lit("}{2}} done"))).when(k == 1, nested).when(k == 2, "none: \\boxed{}").otherwise(F.lit("open \\boxed{\\frac{1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.extract_answer_balanced(reply).alias("answer"))


@query("exp_13_extract_json", """SELECT o_orderkey, (o_orderkey % 2 = 0) AS correct, CASE WHEN o_orderkey % 3 = 0 THEN 'uses \\frac' ELSE o_orderpriority END AS reason FROM orders""")
def replies(spark, sf_dir):
    flag = F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false")
    why = F.when(F.col("o_orderkey") % 3 == 0, F.lit("uses \\\\frac")).otherwise(F.col("o_orderpriority"))
    reply = F.concat(F.lit("<think>maybe {no}</think>\n```json\n{\"correct\": "), flag, F.lit(', "reason": "'), why, F.lit('"}\n```'))
    found = X.extract_json_object(reply, "correct boolean, reason string")
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("j")).select("o_orderkey", "j.correct", "j.reason")


STATUSES = " Completed|Logical-Break|logical break|unable to continue|status: cannot continue|COMPLETE!|unknown||stopped".split("|")


@query("exp_14_normalize_status", f"""
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, CASE WHEN s IN ('completed','cannot_continue','logical_break') THEN s WHEN contains(s,'logical') OR contains(s,'break') THEN 'logical_break'
  WHEN contains(s,'cannot') OR contains(s,'unable') THEN 'cannot_continue' WHEN contains(s,'complete') OR a <> '' THEN 'completed' ELSE 'cannot_continue' END AS status
FROM (SELECT *, replace(replace(lower(trim(({STATUSES!r})[1 + (l_partkey % {len(STATUSES)})])), '-', '_'), ' ', '_') AS s, trim(CASE WHEN l_linestatus = 'F' THEN 'x' ELSE ' ' END) AS a FROM lineitem)""")
def statuses(spark, sf_dir):
    s = F.get(F.array(*map(F.lit, STATUSES)), (F.col("l_partkey") % len(STATUSES)).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", X.normalize_status(s, F.when(F.col("l_linestatus") == "F", "x").otherwise(" ")).alias("status"))


TAIL = r"""CASE doc_id % 5 WHEN 0 THEN coalesce(text, '') || ' so $x \/geq \frac{1' WHEN 1 THEN coalesce(text, '') || '\text{ }\text{}\text{} \sqrt{' WHEN 2 THEN 'value, $x + \sqrt{2' ELSE text END"""


@query("exp_15_repair_text", rf"""
WITH clean AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(t, chr(8), '\b'), chr(9), '\t'), chr(12), '\f'), chr(11), '\v'),
    '\\/({'|'.join(X.SLASHED)})', '\\\1', 'g'), '(?:\\+\s*text\s*\{{\s*\}}\s*){{3,}}', '\\;', 'g'), '(?:\\+\s*,\s*){{8,}}', '\\,', 'g') AS v
  FROM (SELECT doc_id, {TAIL} AS t FROM documents)
), ends AS (
  SELECT *, regexp_replace(v, '\s+$', '') AS e FROM clean
)
SELECT doc_id, CASE WHEN (length(e) - length(replace(e, '$', '')) - (length(e) - length(replace(e, '\$', ''))) // 2) % 2 = 1 AND regexp_matches(e, '\\$|\\(?:text|frac|dfrac|sqrt)\{{[^}}\n]*$')
  THEN coalesce(nullif(regexp_extract(e, '(?s)^(.*[.!?])["'')\]]*(?:\s.*)?$', 1), ''), regexp_replace(regexp_extract(e, '(?s)^(.*[^\\]|)\$', 1), '[ \t\r\n,:;]+$', '')) ELSE v END AS text
FROM ends""")
def repaired(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.repair_text(F.expr(TAIL.replace("\\", "\\\\"))).alias("text"))


WRAPPED = r"""CASE o_orderkey % 5 WHEN 0 THEN '{"continuation": "Is \\frac{1}{2}.\nSo ' || o_custkey || '"}' WHEN 1 THEN '  {"continuation" : "One \"x\".\nTwo \u00e9 is \alpha ' || o_custkey WHEN 2 THEN '{"n": ' || o_custkey || ', "output": 5, "content": "kept ' || o_custkey || '"}'
  WHEN 3 THEN '{"continuation":"no end $a + \\sqrt{' || o_custkey ELSE '{set} of ' || o_custkey END"""


@query("exp_15b_unwrap_reply", r"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Is \frac{1}{2}.' || chr(10) || 'So ' || o_custkey WHEN 1 THEN 'One "x".' WHEN 2 THEN 'kept ' || o_custkey WHEN 3 THEN 'no end' ELSE '{set} of ' || o_custkey END AS text FROM orders""".replace(r"'Is \frac", r"'Is \frac".replace("\\\\", "\\")))
def unwrapped(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.repair_text(F.expr(WRAPPED.replace("\\", "\\\\")), unwrap=True).alias("text"))


@query("exp_16_excerpt", r"SELECT doc_id, CASE WHEN length(v) > 80 THEN substr(v, 1, 79) || '…' ELSE v END AS text FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS v FROM documents)")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.excerpt("text", 80).alias("text"))


@query("exp_17_visible_prefix", sql("""
SELECT unit_id, coalesce((SELECT string_agg('Step ' || (i + 1) || ': ' || CASE WHEN i = 0 THEN 'given' ELSE steps[i + 1] END, chr(10) || chr(10) ORDER BY i) FROM range(0, target_index + 1) r(i)), '(no steps)') AS prefix FROM traj"""))
def prefixes(spark, sf_dir):
    given = F.create_map(F.lit(0), F.lit("given"))
    return trajectories(spark, sf_dir).select("unit_id", X.visible_prefix("steps", F.col("target_index").cast("int"), given).alias("prefix"))


@query("exp_18_split_context", sql("""
SELECT unit_id, array_to_string(steps[:target_index], chr(10)) AS prefix, steps[target_index + 1] AS target, array_to_string(steps[target_index + 2:], chr(10)) AS downstream FROM traj"""))
def contexts(spark, sf_dir):
    return trajectories(spark, sf_dir).select("unit_id", *(c.alias(n) for n, c in X.split_context("steps", F.col("target_index").cast("int")).items()))


@query("exp_25_scale_pp", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, round(l_discount * 100, 1) AS pp FROM lineitem", "pp")
def scaled(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", X.scale_pp("l_discount", 1).alias("pp"))


@query("exp_26_length_ratio_ok", """
SELECT conv_id, turn, coalesce(b <> '' AND a <> b AND length(b) / nullif(length(a), 0)::DOUBLE BETWEEN 0.5 AND 1.7, false) AS ok
FROM (SELECT conv_id, turn, trim(text) AS a, trim(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role)) AS b FROM conversations)""")
def rewrites(spark, sf_dir):
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.length_ratio_ok("text", nxt).alias("ok"))


@query("exp_21_blind_id", """
SELECT p_partkey, lpad((('0x' || substr(sha256('11|' || p_partkey), 1, 16))::UBIGINT % 100000000)::VARCHAR, 8, '0') AS blind,
  ((('0x' || substr(sha256('11|' || p_partkey), 1, 16))::UBIGINT % 1000) / 1000.0::DOUBLE - 0.5) * 0.22 AS jitter FROM part""", "jitter")
def blinded(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.blind_id("p_partkey", 11).alias("blind"), X.hash_jitter("p_partkey", 11).alias("jitter"))
