"""Personal data, secrets and quality rules against brute force."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import pii, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in enumerate(texts)], SCHEMA)


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def random_texts(parts, n=300, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(n)] + ["", None, "é" * 50, "a" * 3000 + "@b.c@d.e-f.g"]


def test_base_personal_data(spark):
    texts = random_texts(["a@b.co", "x_y", "@", ".", " ", "é", "1", "23", "255", "256", "-", "+1 ", "(5)", "4539578763621486", "+44 20 7946 0958", "a@b.com_x@y.org", "1.2.3.4", "\n", "__@a.b"])
    for r in pii.personal_data_digest(pii.find_personal_data(docs(spark, texts))).collect():
        want = brute_pii(texts[r.doc_id] or "")
        assert r.base_sha256 == sha(want), texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, *_ in want) for k in pii.KINDS)


def test_revealing_terms(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = [f"{word()} {word()} Jörgensson mail j@x.org {word()}" for _ in range(6)] + [f"{word()} Jörgensson alone {word()}"]
    texts += [f"{word()} mail {word()} k{i}@x.org {word()}" for i in range(40)] + [f"nothing here {word()} mail" for _ in range(40)]
    rows = pii.find_personal_data(docs(spark, texts)).collect()
    found = {(texts[r.doc_id][t.start : t.end], t.kind) for r in rows for t in r.terms}
    assert found == {("Jörgensson", "generalised")}  # 6 of 7 texts; "mail" reveals no address
    assert any(r.doc_id == 6 and r.terms for r in rows)  # also where the address is not
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "@" not in "".join(clean.values()) and "Jörgensson" not in "".join(clean.values()) and "[EMAIL]" in clean[0] and "[NAME]" in clean[6]
    assert clean[60] == texts[60]


def brute_terms(texts, window=12, support=3, remove=0.95, generalise=0.75):
    """Spans of revealing terms per text, by plain dictionaries."""
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())

    def words(t):
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            w = m[0].strip(marks)
            start = m.start() + (len(m[0]) - len(m[0].lstrip(marks)) if w else len(m[0]))
            yield start, start + len(w), "".join(c.lower() if c.isascii() else c for c in w)

    n_e, n_te, n_t = {}, {}, {}
    for t in {t or "" for t in texts}:
        spans, ws = brute_pii(t), list(words(t))
        for w in {w for _, _, w in ws if len(w.encode()) >= 3}:
            n_t[w] = n_t.get(w, 0) + 1
        around = {}
        for kind, s, e in spans:
            before = [k for k, (_, z, _) in enumerate(ws) if z <= s]
            after = [k for k, (a, _, _) in enumerate(ws) if a >= e]
            lo, hi = len(before), len(ws) - len(after)
            for k in [*range(max(0, lo - window), lo), *range(hi, min(len(ws), hi + window))]:
                a, z, w = ws[k]
                if len(w.encode()) >= 3 and not any(x < z and a < y for _, x, y in spans):
                    around.setdefault((kind, t[s:e].lower()), set()).add(w)
            around.setdefault((kind, t[s:e].lower()), set())
        for entity, near in around.items():
            n_e[entity] = n_e.get(entity, 0) + 1
            for w in near:
                n_te[w, entity] = n_te.get((w, entity), 0) + 1
    share = {}
    for (w, entity), n in n_te.items():
        if n >= support and n_e[entity] >= support:
            share[w] = max(share.get(w, 0), min(1.0, n / n_t[w]))
    action = {w: "removed" if s >= remove else "generalised" for w, s in share.items() if s >= generalise}
    return [sorted((action[w], a, z) for a, z, w in words(t or "") if w in action and not any(x < z and a < y for _, x, y in brute_pii(t or ""))) for t in texts]


def test_terms_and_actions_equal_brute_force(spark):
    rng = np.random.default_rng(23)
    vocabulary = [f"word{i}" for i in range(60)] + ["it", "Ünïcode", "(quoted)", "x_y", "--", "a.b"]
    entities, names = ["jo@x.org", "Jo@X.org", "10.0.0.7", "+44 20 7946 0958", "amy@y.net", "4539578763621486"], ["Kowalski", "«Ngata»", "Oyelaran,", "zed", "Petrov!", "Quayle"]
    texts = ["", None]
    for _ in range(220):
        words = list(rng.choice(vocabulary, int(rng.integers(3, 40))))
        k = int(rng.integers(0, len(entities)))
        at = int(rng.integers(0, len(words)))
        if rng.random() < 0.6:
            words[at:at] = [names[k], entities[k]] if rng.random() < 0.9 else [entities[k]]
        elif rng.random() < 0.06 * k:
            words[at:at] = [names[k]]
        texts.append(" ".join(words))
    texts += texts[5:40]  # copies count once
    want = brute_terms(texts)
    rows = pii.find_personal_data(docs(spark, texts)).collect()
    assert {k for spans in want for k, _, _ in spans} == {"removed", "generalised"} and len(rows) == len(texts)
    for r in rows:
        assert sorted((t.kind, t.start, t.end) for t in r.terms) == want[r.doc_id], texts[r.doc_id]
    put = lambda kind, word: "[REMOVED]" if kind == "removed" else "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]" if kind == "generalised" else f"[{kind.upper()}]"
    for r in pii.sanitise(docs(spark, texts)).collect():
        t, at, out = texts[r.doc_id], 0, []
        spans = [(s, e, f"[{k.upper()}]") for k, s, e in brute_pii(t or "")] + [(s, e, put(k, t[s:e])) for k, s, e in want[r.doc_id]]
        for s, e, word in sorted(spans, key=lambda x: (x[0], -x[1])):
            if s >= at:
                out += [t[at:s], word]
            at = max(at, e)
        assert r.text == (None if t is None else "".join([*out, t[at:]]))


def test_very_long_texts(spark):
    rng = np.random.default_rng(31)
    long = " ".join("".join(rng.choice(list("aeionrst"), int(k))) for k in rng.integers(2, 9, 220_000)) + " mail a@b.co token=abcdefgh1234 end" + "x" * 5_000
    assert len(long) > 1_300_000
    texts = [long, "short a@b.co", None]
    for r in pii.personal_data_digest(pii.find_personal_data(docs(spark, texts))).collect():
        assert r.base_sha256 == sha(brute_pii(texts[r.doc_id] or ""))
    for r in secrets.secret_digest(secrets.find_secrets(docs(spark, texts))).collect():
        assert r.base_sha256 == sha(brute_secrets(texts[r.doc_id] or ""))
    for r in quality.quality_rules(docs(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_words, r.word_chars) == (len(t.split()), sum(map(len, t.split())))
    kept = {r.doc_id: len(r.text or "") for r in pii.sanitise(docs(spark, texts)).collect()}
    assert kept[0] == len(long) - len("a@b.co") + len("[EMAIL]") and len(quality.clean(docs(spark, [long])).collect()) == 1


def test_copies_are_no_evidence(spark):
    texts = ["zorblax j@x.org quux"] * 20 + ["plain words"] * 5
    assert all(not r.terms for r in pii.find_personal_data(docs(spark, texts)).collect())


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_secrets(spark):
    texts = random_texts(["token", "=", " ", '"', "secret:", "PassWord", "api_key", "AKIA", "ABCD1234EFGH", "deadbeef" * 4, "0f", "é", "hunter22", "\n", "K", "ſ"], seed=2)
    for r in secrets.secret_digest(secrets.find_secrets(docs(spark, texts))).collect():
        assert r.base_sha256 == sha(brute_secrets(texts[r.doc_id] or "")), texts[r.doc_id]


def test_random_strings_are_found_and_words_left(spark):
    rng = np.random.default_rng(7)
    make = lambda a, n: "".join(rng.choice(list(a), n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = [make(base64, 40) for _ in range(30)] + [make("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 40) for _ in range(10)]
    texts = [f"the value {p} in use" for p in planted]
    texts += ["thernderinaningeation attireheerstshnd anthrererendanhe chapter2section3paragraph4appendix", "internationalization2024 version-release-candidate-2", "aaaaaaaaaaaaaaaa1111111111111111 abcabcabcabcabcabc123123123"] * 10
    rows = {r.doc_id: r.random for r in secrets.find_secrets(docs(spark, texts)).collect()}
    hit = sum(any(texts[i][s.start : s.end] == p for s in rows[i]) for i, p in enumerate(planted))
    assert hit >= 36 and not any(rows[i] for i in range(len(planted), len(texts)))


def by_chance(kind, symbols):
    return secrets.random_p(kind, len(symbols), *secrets.statistics(kind, symbols))


def test_battery_rejects_what_is_not_random():
    assert by_chance("hex", "0123456789abcdef" * 4) < 0.001  # a run up the alphabet
    assert by_chance("base64", "aB" * 20) < 0.001
    rng = np.random.default_rng(1)
    for kind, n in (("hex", 40), ("base64", 16), ("base32", 20)):
        p = [by_chance(kind, "".join(rng.choice(list(secrets.ALPHABETS[kind][:62]), n))) for _ in range(300)]
        assert np.mean(np.array(p) < 0.001 / 3) < 0.02, kind


def test_secrets_equal_brute_force(spark):
    rng = np.random.default_rng(17)
    make = lambda a, n: "".join(rng.choice(list(a), n))
    b64 = secrets.ALPHABETS["base64"]
    texts = []
    for i in range(150):
        words = [make("aeionrtsl", int(k)) for k in rng.integers(2, 24, 30)]
        words[2] = [make(b64, int(rng.integers(16, 50))), make("0123456789abcdef", 24), words[2].title() + "2x", "camelCaseNameOfSomething", make("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), "/usr/lib/python3/site-packages/x"][i % 6]
        texts.append(" ".join(words))
    place = {c: i for i, c in enumerate(b64)}
    kind = lambda c: "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else ""

    def stats(symbols, alphabet):
        n = len(symbols)
        equal = sum(symbols[i] == symbols[j] for i in range(n) for j in range(i)) / (n * (n - 1) / 2)
        kinds = [kind(c) for c in symbols if kind(c)]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (len(kinds) - 1)
        x = [alphabet.index(c) for c in symbols]
        m = sum(x) / n
        spread = sum((v - m) ** 2 for v in x)
        return equal, changes, sum((a - m) * (b - m) for a, b in zip(x, x[1:], strict=False)) / spread if spread else 1.0

    per = {}
    for t in texts:
        for w in t.split():
            if 12 <= len(w) < 64 and all(c in place and c not in "+/" for c in w) and sum(kind(a) != kind(b) for a, b in zip(w, w[1:], strict=False)) <= 3:
                per.setdefault(int(math.log2(len(w))), []).append(stats(w, b64))
    everything = [x for xs in per.values() for x in xs]
    found = {}
    for i, t in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
            body = m[0].rstrip("=")
            if len({kind(c) for c in body} - {""}) < 2:
                continue
            enc = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body) else "base32" if re.fullmatch("[A-Z2-7]+", body) else "base64"
            body = body.lower() if enc == "hex" else body.replace("-", "+").replace("_", "/")
            s = stats(body, secrets.ALPHABETS[enc])
            if secrets.random_p(enc, len(body), *s) >= 0.001 / 3:
                own = per.get(int(math.log2(len(body))), [])
                own = own if len(own) >= 30 else everything
                nulls = [f for k in range(3) for f in (max((0, 0.05, -1)[k], np.mean([x[k] for x in own])), max((0.02, 0.08, 0.1)[k], np.std([x[k] for x in own])))]
                p = secrets.ordinary_p(len(body), *s, nulls)
                found[i, m.start(), m.end()] = int(math.log2(len(body))), min(secrets.GRID, int(-4 * math.log10(max(p, 1e-300))))
    want = set()
    for c in {c for c, _ in found.values()}:
        steps = sorted((s for k, s in found.values() if k == c), reverse=True)
        ok = [s for s in set(steps) if 10 ** (-s / 4) <= 0.01 * sum(x >= s for x in steps) / len(steps)]
        want |= {k for k, (d, s) in found.items() if d == c and ok and s >= min(ok)}
    got = {(r.doc_id, x.start, x.end) for r in secrets.find_secrets(docs(spark, texts)).collect() for x in r.random}
    base = {(i, s, e) for i, t in enumerate(texts) for _, s, e in brute_secrets(t)}
    want = {w for w in want if not any(b[0] == w[0] and b[1] < w[2] and w[1] < b[2] for b in base)}
    assert len(want) > 20 and got == want


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, g in enumerate(runs) if runs.count(g) > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark):
    texts = random_texts(["a", "b ", "c\n", " a b c ", "é ", "#", "|", "\t", " ", "x y z\n"], seed=5)
    for r in quality.quality_rules(docs(spark, texts)).collect():
        want = brute_quality(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good if i % 20 == 0 else "short", "en", "bad", 0) for i in range(200)] + [(1000 + i, good, "en", f"g{i % 9}", 0) for i in range(300)] + [(2000, good, "en", None, 0), (None, good, None, "g1", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    v = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert not v[0].kept and v[0].host_rate > 0.6 and v[1000].kept and v[2000].kept and v[None].kept
    out = quality.clean(df.withColumn("host_kept", F.lit("clash")).drop("host_kept"))
    assert out.columns == df.columns and out.count() == 302


def test_empty_tables(spark):
    none = docs(spark, [])
    assert pii.find_personal_data(none).count() == 0 and secrets.find_secrets(none).count() == 0 and quality.quality_rules(none).count() == 0 and quality.clean(none).count() == 0


@pytest.mark.parametrize("op", [lambda d: pii.find_personal_data(d), lambda d: secrets.find_secrets(d), lambda d: quality.quality_rules(d)])
def test_one_row_for_each_row(spark, op):
    df = docs(spark, ["same a@b.co " * 3] * 4).withColumn("doc_id", F.lit(5).cast("long"))
    assert op(df).count() == 4
