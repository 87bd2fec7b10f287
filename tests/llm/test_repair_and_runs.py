"""Conversation repair, periodic runs and decontamination against brute force and SQL."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import conversations, decontamination, periodic, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
DIR = "/root/testdata/sf0.001"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def brute_audit(turns):
    """Suffix programme: (cost, letters, repaired) of the best way to end from turn i and a state, over plain strings."""
    seen, faults = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserts):
        options = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        if inserts < 3:
            for r in "ua":
                if r in after[state] and (x := best(i, r, inserts + 1)):
                    options.append((2 + x[0], "I" + x[1], (name[r] + ":", *x[2])))
        if i < len(turns):
            _, role, text = turns[i]
            if x := best(i + 1, state, 0):
                options.append((3 + x[0], "D" + x[1], x[2]))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] in after[state] and role and (x := best(i + 1, role[:1], 0)):
                    options.append((more + x[0], "K" + x[1], (f"{role}:{text}", *x[2])))
                for r in "ua":
                    if r in after[state] and (x := best(i + 1, r, 0)):
                        options.append((2 + more + x[0], "R" + x[1], (f"{name[r]}:{text}", *x[2])))
        return min(options) if options else None

    numbers = {t for t, _, _ in turns if t is not None}
    roles = [r[:1] for _, r, _ in turns]
    cost, audit, repaired = best(0, "", 0)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
    }, repaired


def random_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in sorted(rng.sample(range(20), rng.randrange(0, 9))):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Hi.", "What?", "so it is", " \n", "", None, "é ist. ", f"Answer {t}!", "x" * 3000 + "."])))
    return rows


def test_audits_equal_brute_force(spark):
    rows = random_turns(5, 250) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, TURNS).withColumn("cost", F.lit("clash"))
    got = {r.conv_id: r.asDict() for r in conversations.audits(conversations.damaged(df)).collect()}
    texts = {}
    for r in conversations.repaired(conversations.damaged(df)).orderBy("place").collect():
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert len(got) == len({r[0] for r in rows})
    for c in got:
        want, repaired = brute_audit(brute_damage([r for r in rows if r[0] == c]))
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == want, c
        assert texts.get(c, []) == list(repaired)


def test_collisions_of_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(conversations, "MODULUS", 3)  # nearly all strings collide
    rng = random.Random(1)
    for _ in range(300):
        turns = [(t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Hi.", "so", "", "No!", "Yes?"])) for t in range(rng.randrange(0, 12))]
        own = conversations.Repair()
        for t in turns:
            own.add(*t)
        assert own.result() == brute_audit(turns)[0]


def test_order_of_edits_is_that_of_strings():
    rng = random.Random(2)
    pool = [conversations.Edit()]
    for _ in range(400):
        pool.append(conversations.Edit(rng.choice(pool[-30:]), rng.choice("DIKR")))
    for _ in range(4000):
        a, b = rng.choice(pool), rng.choice(pool)
        assert conversations.precedes(a, b) == (a.spelled() < b.spelled())


def test_a_conversation_of_many_turns(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), "id", F.lit(".")).alias("text"))
    r = conversations.audits(rows).collect()[0]
    assert len(r.audit) >= n and r.cost == 2 * (n // 3) and r.gaps == 0 and set(r.audit) == {"I", "K"}


def brute_runs(w):
    best = {}
    for q in range(len(w) // 4, 0, -1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q):
                best[s, e + q - s] = q
            s = e + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_periodic(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["", None, " \n", "a " * 6, "a " * 5, "a b " * 4, "é x é x " * 9, "so " * 400 + "x " + "so it is " * 90]
    for _ in range(400):
        words = list(rng.choice([f"w{i}" for i in range(int(rng.choice([1, 2, 3, 40])))], int(rng.integers(0, 150))))
        if rng.random() < 0.5 and words:
            a = int(rng.integers(0, len(words)))
            words = words[:a] + words[a : a + int(rng.integers(1, 12))] * int(rng.integers(2, 9)) + words[a:]
        texts.append(" \n".join(words))
    found = periodic.run_digest(periodic.periodic_runs(docs(spark, texts).withColumn("runs", F.lit("clash")), faulty=True)).collect()
    assert len(found) == len(texts) and sum(r.n_runs > 0 for r in found) > 80
    for r in found:
        assert tuple(r)[1:] == brute_periodic(r.doc_id, texts[r.doc_id]), texts[r.doc_id]


def test_runs_of_very_long_texts(spark):
    long = [f"w{i}" for i in range(150_000)]
    texts = [" ".join(long), " ".join(long[:300] * 400), "a " * 200_000]
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs(spark, texts)).collect()}
    assert runs == {0: [], 1: [(0, 120_000, 300)], 2: [(0, 200_000, 1)]}


def test_common_extensions():
    rng = np.random.default_rng(5)
    for size in (5, 400):
        parts = [np.append(rng.integers(0, 2, size), -1 - k) for k in range(3)]
        codes = np.concatenate(parts)
        codes[size // 2 : size] = codes[: size - size // 2]
        ext = periodic.Extensions(codes)
        i, j = rng.integers(0, len(codes), (2, 500))
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        few, on = ext.few(i, j)
        few[on] += ext.beyond(i[on] + few[on], j[on] + few[on]) if on.any() else 0
        for a, b, n in zip(i, j, few, strict=True):
            m = 0
            while b + m < len(codes) and codes[a + m] == codes[b + m]:
                m += 1
            assert m == n


def brute_contamination(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for t in texts:
        w, hit, held = split(t), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    held |= found
        out.append((len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("most", [400_000, 40])
def test_contamination_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (most,))
    rng = np.random.default_rng(6)
    prose = lambda n: [f"w{i}" for i in rng.zipf(1.5, n) % 50]
    items = [(int(i), " ".join(prose(int(rng.integers(8, 40))))) for i in range(30)] + [(30, "Two Words"), (31, "one"), (32, ""), (33, None), (None, "éa Éa b C"), (2, " ".join(prose(12))), (35, items_text := " ".join(prose(25))), (36, items_text)]
    texts = ["", None, "one", "ONE!two,words", "éa éa b c Éa b c", "two words " * 3]
    for _ in range(150):
        w = prose(int(rng.integers(0, 60)))
        t = (items[int(rng.integers(0, len(items)))][1] or "").split()
        a = int(rng.integers(0, max(1, len(t) - 11)))
        texts.append("-".join([*w, *t[a : a + int(rng.integers(5, 14))], *prose(5)]).title())
    texts += texts[-3:]
    df = docs(spark, texts).withColumn("key", F.lit("clash")).withColumn("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("doc_id")))
    rows = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash"))).drop("items").collect()
    want = brute_contamination(texts, items)
    got = sorted(((r.doc_id, *tuple(r)[1:]) for r in rows), key=repr)
    assert got == sorted(((i if i % 9 else None, *x) for i, x in enumerate(want)), key=repr)
    assert 20 < sum(x[4] for x in want) < len(texts)


def test_new_operators_on_empty_tables(spark):
    none, items = docs(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert periodic.periodic_runs(none).count() == 0 and conversations.audits(spark.createDataFrame([], TURNS)).count() == 0 and conversations.repaired(spark.createDataFrame([], TURNS)).count() == 0
    assert decontamination.contamination(none, items).count() == 0
    r = decontamination.contamination(docs(spark, ["a b"]), items.limit(0)).collect()
    assert [tuple(x)[:4] for x in r] == [(0, 2, 0, 0)]


@pytest.mark.parametrize("name", ["op11_conversations", "op13_decontamination"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    cur = con.execute(queries.ORACLES[name])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


def test_runs_of_the_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in queries.op12_periodic_runs(spark, DIR).collect():
        assert tuple(r)[1:] == brute_periodic(r.doc_id, texts[r.doc_id])
