"""Operator 11: conversations repaired by the cheapest audit, a dynamic programme over persistent edits.

A conversation's turns are read in order and each is kept, given another role, or deleted; empty
user and assistant turns may be inserted anywhere. The roles that result must be nothing, or
user and assistant in turn with at most a system turn before them. For each state of that
grammar the programme holds its cheapest edits so far as a node of a tree of linked edits, so
prefixes are shared. A node knows its ancestors 1, 2, 4, ... edits back and a rolling hash of
its whole string; of equally cheap edits the ASCII-least stay, found by a search for the longest
common prefix over hashes of ancestors. What hashes call equal is verified node by node (up to
the shared one), and compared letter by letter if that fails.

Turns are shuffled and sorted by conversation and stream through: a conversation's memory is its
edits and a digest per distinct turn, its texts go into running hashes, and it may be cut over
any number of batches. As the result holds one hash of a whole conversation, that is a task's
work, whatever its length. Turns of one number are ordered by role and text. Null roles and texts
are one space, so such a turn is blank; null turn numbers come first; turns of a null conv_id
are one conversation. Empty texts are blank, repeated rows are duplicates, very long texts are
hashed whole. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEXT = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}  # what may stand before
MODULUS, BASE = (1 << 61) - 1, 911


class Edit:
    """A string of edits: its last letter, and the strings 1, 2, 4, ... letters shorter."""

    __slots__ = ("letter", "depth", "hash", "up")

    def __init__(self, before: Edit | None = None, letter: str = ""):
        self.letter = letter
        self.depth = before.depth + 1 if before else 0
        self.hash = (before.hash * BASE + ord(letter)) % MODULUS if before else 0
        up = [before] if before else []
        while up and len(up) <= len(up[-1].up):
            up.append(up[-1].up[len(up) - 1])
        self.up = tuple(up)

    def spelled(self) -> str:
        letters, node = [], self
        while node.depth:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))


def ancestor(node: Edit, depth: int) -> Edit:
    while node.depth > depth:
        node = node.up[(node.depth - depth).bit_length() - 1]
    return node


def truly_same(a: Edit, b: Edit) -> bool:
    """Whether two strings of one length are equal, by their letters down to a node that both share."""
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def precedes(a: Edit, b: Edit) -> bool:
    """Whether `a` is less than `b` in ASCII order."""
    depth = min(a.depth, b.depth)
    x, y = ancestor(a, depth), ancestor(b, depth)
    if x is y or x.hash == y.hash:
        return a.depth < b.depth if truly_same(x, y) else a.spelled() < b.spelled()
    for k in reversed(range(depth.bit_length())):
        if k < len(x.up) and x.up[k] is not y.up[k] and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    return x.letter < y.letter if truly_same(x.up[0], y.up[0]) else a.spelled() < b.spelled()


class Repair:
    """The programme over one conversation: `add` its turns in order, then `result`."""

    def __init__(self):
        self.best: list[tuple | None] = [(0, Edit(), hashlib.sha256()), None, None, None]
        self.seen: set[bytes] = set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.least, self.last_turn, self.role = 0, None, None, None
        self.insert()

    def extended(self, state: int, letter: str, more: int = 0) -> tuple | None:
        """(cost, edits, state before) of one more edit."""
        held = self.best[state]
        return held and (held[0] + COSTS[letter] + more, Edit(held[1], letter), state, letter)

    @staticmethod
    def least_of(options: list[tuple | None]) -> tuple | None:
        least = None
        for x in options:
            if x and (least is None or x[0] < least[0] or (x[0] == least[0] and precedes(x[1], least[1]))):
                least = x
        return least

    def hashed(self, choice: tuple | None, turn: dict[str, bytes]) -> tuple | None:
        """The choice as a state: what it adds to the repaired text goes into its hash."""
        if choice is None or len(choice) == 3:
            return choice
        cost, edits, state, letter = choice
        digest = self.best[state][2]
        if letter != DELETE:
            digest = digest.copy()
            digest.update((b"" if state == START else b"\n") + turn[letter])
        return cost, edits, digest

    def insert(self) -> None:
        """Empty turns of a user and an assistant, before the next turn or after the last; a third would come back to a state at a higher cost."""
        for state in (USER, ASSISTANT):
            chosen = self.least_of([self.best[state], *(self.extended(before, INSERT) for before in NEXT[state])])
            self.best[state] = self.hashed(chosen, {INSERT: f"{NAMES[state]}:".encode()})

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn
        initial = role[:1]
        if self.role is not None and self.role + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.role = initial
        body, whole = text.rstrip(BLANKS), f"{role}:{text}".encode("utf-8", "surrogatepass")
        digest = hashlib.sha256(len(role).to_bytes(8, "big") + whole).digest()
        fault = "blank" if not body else "duplicate" if digest in self.seen else "truncated" if body[-1] not in ".!?" else None
        self.seen.add(digest)
        if fault:
            self.counts[fault] += 1
        stays, more = fault not in ("blank", "duplicate"), int(fault == "truncated")
        new = []
        for state, letter in enumerate(("", "s", "u", "a")):
            options = [self.extended(state, DELETE)]
            if stays and initial == letter and letter:
                options += [self.extended(before, KEEP, more) for before in NEXT.get(state, (START,))]
            elif stays and state in NAMES:
                options += [self.extended(before, REROLE, more) for before in NEXT[state]]
            new.append(self.hashed(self.least_of(options), {KEEP: whole, REROLE: f"{NAMES.get(state, '')}:{text}".encode("utf-8", "surrogatepass")}))
        self.best = new
        self.insert()

    def result(self) -> dict:
        """Faults, cost, audit and the hash of the repaired turns; `gaps` counts missing turn numbers."""
        accepted = [x for x in (self.best[START], self.best[ASSISTANT]) if x]
        cost, edits, digest = self.least_of(accepted)
        gaps = self.last_turn - self.least + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": edits.spelled(), "repaired_sha256": digest.hexdigest()}


FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: each conversation together and in order."""
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    turns: conv_id, turn, role, text; and copies, where a turn stands 0 or more times (1 without that column). A
    conversation of no turns has an empty audit.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, done = None, None, []

        def out():
            return pa.record_batch([pa.array([c for c, _ in done], id_type), *(pa.array([r[f] for _, r in done], pa.int64() if f not in ("audit", "repaired_sha256") else pa.string()) for f in FOUND)], names=["conv_id", *FOUND])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv != now:
                    if own is not None:
                        done.append((now, own.result()))
                    now, own = conv, Repair()
                for _ in range(copies):
                    own.add(turn, role, text)
            if len(done) >= 1000:
                yield out()
                done = []
        if own is not None:
            done.append((now, own.result()))
            yield out()

    return ordered(turns).mapInArrow(over, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the turns of the repaired conversations.

    An audit stands before its conversation's turns, which then stream past it.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    found = audits(turns).select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), F.lit(0).alias("kind"))
    rows = ordered(turns).withColumn("kind", F.lit(1)).unionByName(found).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, before, now = "", 0, 0, "", None
        for batch in batches:
            out = []

            def put(role, text):
                nonlocal place, before
                out.append((now, place, role, text))
                place, before = place + 1, role[:1]

            def inserts():
                nonlocal at
                while at < len(audit) and audit[at] == INSERT:
                    at += 1
                    put("assistant" if before == "u" else "user", "")

            for conv, _, role, text, copies, what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if what == 0:
                    now, audit, at, place, before = conv, text, 0, 0, ""
                    inserts()
                    continue
                for _ in range(copies):
                    letter, at = audit[at], at + 1
                    if letter != DELETE:
                        put(role if letter == KEEP else "assistant" if before == "u" else "user", text)
                    inserts()
            yield pa.record_batch([pa.array([x[0] for x in out], batch.schema.field(0).type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.string())], names=["conv_id", "place", "role", "text"])

    return rows.mapInArrow(over, f"conv_id {kind}, place long, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the turns with the faults of the contract, dealt by crc32 of `conv_id:turn` modulo 20."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


REPAIR_SQL = r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([ascii(c) FOR c IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')], lambda crc, b:
      list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(crc, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE kind <> 0
), faulty AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS earlier,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), steps(conv_id, i, b) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {'n': {'c': 0::BIGINT, 'a': '', 't': ''}, 's': NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), 'u': {'c': 2::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}, 'v': {'c': 4::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} FROM conversations
  UNION ALL
  SELECT conv_id, i, {'n': n, 's': s, 'u': u2, 'v': list_min([v, CASE WHEN u2 IS NOT NULL THEN {'c': u2.c + 2, 'a': u2.a || 'I', 't': u2.t || chr(10) || 'assistant:'} END])} FROM (
    SELECT *, list_min([u, CASE WHEN n IS NOT NULL THEN {'c': n.c + 2, 'a': n.a || 'I', 't': n.t || chr(10) || 'user:'} END, CASE WHEN s IS NOT NULL THEN {'c': s.c + 2, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'} END, CASE WHEN v IS NOT NULL THEN {'c': v.c + 2, 'a': v.a || 'I', 't': v.t || chr(10) || 'user:'} END]) AS u2
    FROM (SELECT conv_id, i, {'c': b.n.c + 3, 'a': b.n.a || 'D', 't': b.n.t} AS n,
        list_min([CASE WHEN b.s IS NOT NULL THEN {'c': b.s.c + 3, 'a': b.s.a || 'D', 't': b.s.t} END, CASE WHEN ok AND initial = 's' THEN {'c': b.n.c + cut, 'a': b.n.a || 'K', 't': b.n.t || chr(10) || role || ':' || text} END]) AS s,
        list_min(list_concat([CASE WHEN b.u IS NOT NULL THEN {'c': b.u.c + 3, 'a': b.u.a || 'D', 't': b.u.t} END], list_transform([b.n, b.s, b.v], lambda x: CASE WHEN ok AND x IS NOT NULL THEN {'c': x.c + cut + CASE initial WHEN 'u' THEN 0 ELSE 2 END, 'a': x.a || CASE initial WHEN 'u' THEN 'K' ELSE 'R' END, 't': x.t || chr(10) || CASE initial WHEN 'u' THEN role ELSE 'user' END || ':' || text} END))) AS u,
        list_min([CASE WHEN b.v IS NOT NULL THEN {'c': b.v.c + 3, 'a': b.v.a || 'D', 't': b.v.t} END, CASE WHEN ok AND b.u IS NOT NULL THEN {'c': b.u.c + cut + CASE initial WHEN 'a' THEN 0 ELSE 2 END, 'a': b.u.a || CASE initial WHEN 'a' THEN 'K' ELSE 'R' END, 't': b.u.t || chr(10) || CASE initial WHEN 'a' THEN role ELSE 'assistant' END || ':' || text} END]) AS v
      FROM (SELECT f.conv_id, f.i, s.b, f.initial, f.role, f.text, coalesce(f.fault NOT IN ('blank', 'duplicate'), true) AS ok, (coalesce(f.fault, '') = 'truncated')::BIGINT AS cut FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)))
), summed AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id
), ended AS (
  SELECT conv_id, list_min([b.n, b.v]) AS best FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ended e LEFT JOIN summed s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""
