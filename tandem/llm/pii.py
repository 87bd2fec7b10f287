"""Operator 2: information-theoretic sanitisation.

Fixed patterns find the protected entities (e-mail addresses, IP addresses, card and
phone numbers). A term reveals an entity e as far as knowing the term t lowers the
information of e: PMI(t; e) = IC(e) + log2 P(e|t). P(e|t) is estimated from corpus
co-occurrence: texts in which t stands within `window` words of e, over all texts that
hold t. Terms with PMI >= IC(e) + log2(`remove`) are removed, those with
PMI >= IC(e) + log2(`generalise`) are replaced by their kind, wherever in the corpus
they occur. Estimates rest on at least `support` different texts, so copies of a text
count once.

Null texts are empty. Rows of equal id and text give equal rows. Empty tables give no
rows. Only contexts of entities are shuffled; of the other documents only the terms
that a bitmap of the candidates lets through, which has eight bits per candidate at least
(up to 2**30 bits, 128 MB). Very long texts are searched whole, in time linear in their
length. Spans that tie in their start are ordered by kind. Other columns are not read, and
are kept by `sanitise`, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import bitmap, cut, in_bitmap, salted_join
from tandem.llm.textkit import Words, signed, span_hashes, sub_batches

KINDS = ("email", "ip", "card", "phone")
# Fixed values of the contract.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a match never starts inside a run of digits: linear
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LEAST_BITS, MOST_BITS = 22, 30
SPANS = "array<struct<kind:string,start:long,end:long>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) in code points, by kind, then start."""
    found = [(0, s, e) for s, e in emails(text)]
    if any(c in text for c in "0123456789"):
        if "." in text:
            found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def terms_of(texts: pa.Array) -> Words:
    """Words in lower case (A-Z), without ASCII punctuation at either end; those under 3 bytes are left with no length."""
    words = Words(texts, lower=True)
    mark = np.zeros(256, bool)
    mark[33:127] = True
    mark[48:58] = mark[65:91] = mark[97:123] = False
    live = np.arange(len(words))
    while len(live):
        live = live[(words.start[live] < words.end[live]) & mark[words.data[np.minimum(words.start[live], len(words.data) - 1)]]]
        words.start[live] += 1
    live = np.arange(len(words))
    while len(live):
        live = live[(words.start[live] < words.end[live]) & mark[words.data[words.end[live] - 1]]]
        words.end[live] -= 1
    return words


def entities(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text_id, spans (base), near: for each entity of the text its hash and the hashes of the terms around it."""

    def find(batches):
        for b in sub_batches(batches):
            texts = b.column(2)
            found = [base_spans(t) for t in texts.to_pylist()]
            near: list[list[dict]] = [[] for _ in found]
            rows = [i for i, f in enumerate(found) if f]
            if rows:
                own = pa.array([texts[i].as_py() for i in rows], pa.string())
                words = terms_of(own)
                keys = signed(span_hashes(words.data, words.start, words.end))
                first, last = words.code_point_offsets()
                for k, i in enumerate(rows):
                    a, z = words.first[k], words.first[k + 1]
                    f, e, text = first[a:z], last[a:z], own[k].as_py()
                    usable = (words.end[a:z] - words.start[a:z]) >= 3
                    for _, s, t in found[i]:
                        usable[np.searchsorted(e, s, side="right") : np.searchsorted(f, t)] = False
                    around: dict[str, set[int]] = {}
                    for kind, s, t in found[i]:
                        lo, hi = np.searchsorted(e, s, side="right"), np.searchsorted(f, t)
                        take = np.concatenate([np.arange(max(0, lo - window), lo), np.arange(hi, min(len(f), hi + window))])
                        around.setdefault(f"{kind}{text[s:t].lower()}", set()).update(keys[a + take[usable[take]]].tolist())
                    near[i] = [{"entity": e_, "terms": sorted(ts)} for e_, ts in around.items()]
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, SPAN_TYPE), pa.array(near, pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.int64()))])))], names=["doc_id", "text_id", "spans", "near"])

    return docs.mapInArrow(find, f"doc_id long, text_id long, spans {SPANS}, near array<struct<entity:string,terms:array<long>>>")


def occurrences(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, text_id, term, start, end: each place in the corpus of a term that may be a candidate."""
    held = docs.sparkSession.sparkContext.broadcast(bits)  # 2**MOST_BITS bits at most

    def places(batches):
        for b in sub_batches(batches):
            words = terms_of(b.column(2))
            keys = span_hashes(words.data, words.start, words.end)
            hit = np.flatnonzero((words.end - words.start >= 3) & in_bitmap(held.value, keys))
            if len(hit):
                first, last = words.code_point_offsets()
                doc = pa.array(words.doc[hit])
                yield pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(1).take(doc), pa.array(signed(keys[hit])), pa.array(first[hit]), pa.array(last[hit])], names=["doc_id", "text_id", "term", "start", "end"])

    return docs.mapInArrow(places, "doc_id long, text_id long, term long, start long, end long")


def disclosures(found: DataFrame, places: DataFrame, candidates: DataFrame, n_texts: int, remove: float, generalise: float) -> DataFrame:
    """term, action, disclosure (bits of the entity that the term gives away): terms beyond the thresholds."""
    texts = places.groupBy("term").agg(F.countDistinct("text_id").alias("n_t"))
    rated = candidates.join(texts.hint("merge"), "term").withColumn("share", F.least(F.lit(1.0), F.col("n_te") / F.col("n_t")))
    pmi = F.log2(F.lit(float(max(n_texts, 1))) / F.col("n_e")) + F.log2("share")
    best = rated.groupBy("term").agg(F.max("share").alias("share"), F.max(pmi).alias("disclosure"))
    return best.where(F.col("share") >= generalise).select("term", "disclosure", F.when(F.col("share") >= remove, "removed").otherwise("generalised").alias("action"))


def find_personal_data(docs: DataFrame, window: int = 12, support: int = 3, remove: float = 0.95, generalise: float = 0.75) -> DataFrame:
    """doc_id, text_id, spans (base) and terms (spans of revealing terms, kind removed or generalised), one row for each row of `docs`."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    found = cut(entities(source, window))
    held = cut(found.where(F.size("near") > 0).select("text_id", "near").dropDuplicates(["text_id"]))
    near = held.select("text_id", F.explode("near").alias("n")).select("text_id", F.xxhash64("n.entity").alias("entity"), "n.terms")
    # a term near entities of m texts stands in m texts at least; where that alone keeps P(e|t) low, its places are never looked up
    around = held.select(F.explode(F.array_distinct(F.flatten(F.transform("near", lambda n: n["terms"])))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    known = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support)
    pairs = salted_join(near, known, "entity", ["text_id"]).select("entity", "n_e", F.explode("terms").alias("term"))
    counted = pairs.groupBy("term", "entity", "n_e").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= support)
    candidates = cut(counted.join(around.hint("merge"), "term").where(F.col("n_te") >= generalise * F.col("n_near")).drop("n_near"))
    n_texts = found.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * candidates.count()).bit_length()))
    places = cut(salted_join(occurrences(source, bitmap(candidates, "term", bits)), candidates.select("term").distinct(), "term", ["text_id"], "left_semi"))
    flagged = disclosures(found, places, candidates, n_texts, remove, generalise)
    marks = (
        salted_join(places, flagged, "term", ["text_id"]).groupBy(F.col("doc_id").alias("d"), F.col("text_id").alias("x"))
        .agg(F.collect_set(F.struct(F.col("action").alias("kind"), "start", "end")).alias("terms"))
    )
    rows = found.join(marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_id") == F.col("x")), "left")
    own = F.expr("array_sort(filter(coalesce(terms, array()), t -> not exists(spans, s -> s.start < t.end and t.start < s.end)))")  # by kind, then start
    return rows.select("doc_id", "text_id", "spans", own.alias("terms"))


def personal_data_digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(text(F.col("spans")), 256).alias("base_sha256"),
        text(F.concat("spans", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """`docs` with personal data replaced by its kind in brackets, and revealing terms removed or generalised.

    All rows stay, with the columns as they were, whatever their names; a null text stays null, an empty table empty.
    Rows that share an id are treated each by its own text.
    """
    found = find_personal_data(docs, **options).where(F.size("spans") + F.size("terms") > 0)
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("text_id").alias("x")).agg(F.first(F.concat("spans", "terms")).alias("marks"))  # of rows with equal id and text one
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    rows = rows.join(found.hint("merge"), F.col("own").eqNullSafe(F.col("d")) & (F.col("key") == F.col("x")), "left")

    def put_for(kind: str, word: str) -> str:
        if kind == "removed":
            return "[REMOVED]"
        if kind == "generalised":
            return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"
        return f"[{kind.upper()}]"

    @F.arrow_udf("string")
    def masked(texts: pa.Array, marks: pa.Array) -> pa.Array:
        touched = pc.and_(marks.is_valid(), texts.is_valid())
        out = []
        for t, own in zip(texts.filter(touched).to_pylist(), marks.filter(touched).to_pylist(), strict=True):
            parts, at = [], 0
            for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [t[at : s["start"]], put_for(s["kind"], t[s["start"] : s["end"]])]
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]))
        return pc.replace_with_mask(texts, touched, pa.array(out, texts.type))

    rows = rows.select("row", "marks", masked("row.text", "marks").alias("text"))
    new = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(F.col("marks").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return rows.select(new.alias("row")).select("row.*")
