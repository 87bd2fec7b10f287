"""Scalar expressions for run tables. Columns in, columns out; all stay inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of booleans.
TRUE_WORDS, STRICT_TRUE, STRICT_FALSE = ("1", "true", "yes", "y"), ("true", "1", "yes"), ("false", "0", "no")
# Markup of answers that means nothing, and what stands for what.
BOXED = r"\\boxed\{(.*)\}"
NO_MEANING = r"\\left|\\right|\\!|\\,|\\ |\\?\$|\\?%|\^\{\\circ\}|\^\\circ|\\text\{[^}]*\}|\\mbox\{[^}]*\}"
ANSWER_FORMS = (
    (r"\\(cdot|times)", "*"),
    (r"\\d?frac\{([^{}]+)\}\{([^{}]+)\}", "($1)/($2)"),
    (r"\\sqrt\{([^{}]+)\}", "sqrt($1)"),
    (r"\\sqrt([0-9A-Za-z_])", "sqrt($1)"),
    (r"\\pi", "pi"),
    (r"\\infty", "oo"),
    (r"[dt]frac", "frac"),
    (r"[ ,]", ""),
)
NUMBER_FORMS = ((r"\.+$", ""), (r"^(-?[0-9]+)\.0+$", "$1"), (r"^0(\.[0-9]+)$", "$1"))
# Characters that count as white space at the ends of a text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Empty and repeated commands, ends of a text that breaks off, and keys that wrap a reply.
EMPTY_TEXTS, REPEATED_SPACES = r"(?:\\+\s*text\s*\{\s*\}\s*){3,}", r"(?:\\+\s*,\s*){8,}"
BROKEN_END = r"\\$|\\(?:text|frac|dfrac|sqrt)\{[^}\n]*$"
SENTENCES = r"""(?s)^(.*[.!?])["')\]]*(?:\s.*)?$"""
PLAIN_ESCAPES = (('\\"', '"'), ("\\\\", "\\"), ("\\/", "/"), ("\\n", "\n"), ("\\r", "\r"))
WRAPPING_KEYS = ("continuation", "output", "content", "answer")
# Control characters that stand for lost escapes, and commands with a stray slash.
LOST_ESCAPES = (("\x08", "\\b"), ("\t", "\\t"), ("\x0c", "\\f"), ("\x0b", "\\v"))
SLASHED = ("geq", "leq", "neq", "times", "rightarrow")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(_c(c), F.lit(WHITE))


def as_float(c) -> Column:
    """Trimmed number, NULL for empty or unreadable text; NaN is never kept."""
    v = F.nullif(strip(c), F.lit("")).try_cast("double")
    return F.when(~F.isnan(v), v)


def as_int(c, default: int | None = None) -> Column:
    """Truncated number; `default` where there is none."""
    v = as_float(c)
    v = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("long")
    return v if default is None else F.coalesce(v, F.lit(default).cast("long"))


def as_bool(c) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*TRUE_WORDS), F.lit(False))


def parse_bool_strict(c) -> Column:
    """Only the strict spellings; anything else is an error when the row is computed."""
    v = F.lower(strip(c))
    return F.when(v.isin(*STRICT_TRUE), True).when(v.isin(*STRICT_FALSE), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(_c(c), F.lit("NULL")))).cast("boolean"))


def normalize_space(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def stable_hash(c, seed: int | str) -> Column:
    """16 hex digits of sha256('seed|text'); their text order is the order of the 64-bit number."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), _c(c).cast("string")), 256), 1, 16)


def hash_mod(hex16: Column, n: int) -> Column:
    """The 64-bit number of a stable hash, modulo n."""
    return (F.conv(hex16, 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("long")


def hash_hex(seed, *parts) -> Column:
    """8 hex digits of md5 of the parts, whose text order is the order of `hash_unit`."""
    text = F.concat_ws("|", F.lit(str(seed)), *(_c(p).cast("string") for p in parts))
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def hash_unit(seed, *parts) -> Column:
    """A uniform draw in [0, 1) from md5 of the parts: the same in any engine."""
    return F.conv(hash_hex(seed, *parts), 16, 10).cast("double") / F.lit(float(1 << 32))


def stable_id(prefix: str, *parts) -> Column:
    """prefix-16 hex digits of sha256 of the parts joined by '|'."""
    text = F.concat_ws("|", *(_c(p).cast("string") for p in parts))
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, 16))


def position_ratio(i, n, at_least_one: bool = False) -> Column:
    last = F.greatest(_c(n) - 1, F.lit(1)) if at_least_one else _c(n) - 1
    return F.when(_c(n) <= 1, F.lit(0.0)).otherwise(_c(i) / last)


def position_bin(i, n, at_least_one: bool = False) -> Column:
    """early, middle or late third of a sequence of n."""
    r = position_ratio(i, n, at_least_one)
    return F.when(r < 1 / 3, "early").when(r < 2 / 3, "middle").otherwise("late")


def transition(control, target) -> Column:
    c, t = _c(control) == 1, _c(target) == 1
    return F.when(~c & t, "wrong_to_correct").when(c & ~t, "correct_to_wrong").when(c & t, "still_correct").otherwise("still_wrong")


def transition_code(control, target) -> Column:
    return F.concat(F.when(_c(control) == 1, "C").otherwise("W"), F.when(_c(target) == 1, "C").otherwise("W"))


def stability_class(wc, cw, strong: int = 2) -> Column:
    """Direction of a unit's changes, strong from `strong` changes on."""
    wc, cw = _c(wc), _c(cw)
    return (
        F.when((wc > 0) & (cw > 0), "mixed").when(wc >= strong, "strongly_beneficial").when(wc > 0, "weakly_beneficial")
        .when(cw >= strong, "strongly_harmful").when(cw > 0, "weakly_harmful").otherwise("stable")
    )


def conditional_rate(num, den) -> Column:
    return F.try_divide(_c(num).cast("double"), F.nullif(_c(den), F.lit(0)))


def normalize_answer(c) -> Column:
    """An answer in plain form: what is boxed, without markup, units, blanks and thousands marks, fractions and roots flat, whole numbers without decimals."""
    v = strip(c)
    v = F.when(F.rlike(v, F.lit(BOXED)), F.regexp_extract(v, BOXED, 1)).otherwise(v)
    v = F.regexp_replace(v, NO_MEANING, "")
    for pattern, plain in ANSWER_FORMS:
        v = F.regexp_replace(v, pattern, plain)
    v = F.lower(v)
    for pattern, plain in NUMBER_FORMS:
        v = F.regexp_replace(v, pattern, plain)
    return v


def grade_exact(candidate, truth) -> Column:
    a = normalize_answer(candidate)
    return F.when(_c(candidate).isNull() | (a == ""), "no_answer").when(a == F.coalesce(normalize_answer(truth), F.lit("")), "string_match").otherwise("mismatch")


def extract_answer(c) -> Column:
    """The last flat boxed answer, else what follows 'answer is'."""
    boxed = F.regexp_extract_all(_c(c), F.lit(r"\\boxed\{([^{}]*)\}"), F.lit(1))
    said = F.regexp_extract(_c(c), r"(?i)answer is:?\s*([^\s.,;]+)", 1)
    return F.coalesce(F.try_element_at(boxed, F.lit(-1)), F.nullif(said, F.lit("")))


def extract_answer_balanced(c) -> Column:
    """The last boxed answer with balanced braces; NULL where it is not closed.

    A running sum over the braces that follow the last mark: what follows is cut behind each brace, and a fold over the
    pieces holds the depth and the characters so far, until the depth falls below that of the mark.
    """
    mark = "\\boxed{"
    rest = F.substring_index(_c(c), mark, -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("chars"), F.lit(-1).alias("end"))

    def fold(state: Column, piece: Column) -> Column:
        step = F.when(F.endswith(piece, F.lit("{")), 1).when(F.endswith(piece, F.lit("}")), -1).otherwise(0)
        depth, chars = state["depth"] + step, state["chars"] + F.char_length(piece)
        return F.when(state["end"] >= 0, state).otherwise(F.struct(depth.alias("depth"), chars.alias("chars"), F.when(depth < 0, chars - 1).otherwise(F.lit(-1)).alias("end")))

    end = F.aggregate(F.split(rest, r"(?<=[{}])"), start, fold)["end"]
    return F.when(F.contains(_c(c), F.lit(mark)) & (end >= 0), F.substring(rest, F.lit(1), end))


def extract_json_object(c, schema: str) -> Column:
    """The JSON object in a model's reply: reasoning blocks and code fences off, then the outermost braces, with illegal escapes doubled on a second try."""
    v = F.regexp_replace(_c(c), r"(?s)<think>.*?</think>", "")
    v = F.regexp_replace(v, r"```(?:json)?", "")
    v = F.regexp_extract(v, r"(?s)(\{.*\})", 1)
    first = F.try_parse_json(v) if hasattr(F, "try_parse_json") else None
    repaired = F.regexp_replace(v, r'\\(?!["\\/bfnrtu])', r"\\\\\\\\")
    parsed = lambda x: F.from_json(x, schema, {"mode": "PERMISSIVE"})
    ok = first.isNotNull() if first is not None else F.get_json_object(v, "$").isNotNull()
    return F.when(F.nullif(v, F.lit("")).isNotNull(), F.when(ok, parsed(v)).otherwise(parsed(repaired)))


def normalize_status(status, answer) -> Column:
    """completed, cannot_continue or logical_break, whatever the spelling; a reply with an answer is completed where its status says nothing."""
    v = F.translate(F.lower(strip(F.coalesce(_c(status), F.lit("")))), "- ", "__")
    says = lambda *words: F.rlike(v, F.lit("|".join(words)))
    return (
        F.when(v.isin("completed", "cannot_continue", "logical_break"), v).when(says("logical", "break"), "logical_break").when(says("cannot", "unable"), "cannot_continue")
        .when(says("complete") | (strip(F.coalesce(_c(answer), F.lit(""))) != ""), "completed").otherwise("cannot_continue")
    )


def unwrapped_reply(c) -> dict[str, Column]:
    """text and cut of a reply that may be a JSON object: its text under the first of the known keys; of an object that breaks off in its `continuation`, what there is of that text, and cut is true."""
    v = _c(c)
    parsed = F.when(F.startswith(strip(v), F.lit("{")), F.try_parse_json(strip(v)))
    whole = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    value = lambda k: F.try_variant_get(parsed, f"$.{k}", "variant")
    said = F.coalesce(*(F.when(F.schema_of_variant(value(k)) == "STRING", F.try_variant_get(parsed, f"$.{k}", "string")) for k in WRAPPING_KEYS))
    opening = r'^\s*\{\s*"continuation"\s*:\s*"'
    broken = ~whole & F.rlike(v, F.lit(opening))
    rest = F.regexp_replace(F.regexp_replace(v, opening, ""), r'"\}$', "")
    return {"text": F.when(whole & said.isNotNull(), said).when(broken, unescaped(rest)).otherwise(v), "cut": F.coalesce(broken, F.lit(False))}


def unescaped(c) -> Column:
    """The text of a JSON string that may break off: code points, quotes, slashes and line ends are decoded, other escapes are left as they are."""
    tokens = F.regexp_extract_all(_c(c), F.lit(r"(?s)((?:\\u[0-9a-fA-F]{4})+|\\.|[^\\]+|\\)"), F.lit(1))

    def read(t: Column) -> Column:
        points = F.decode(F.unhex(F.replace(t, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        plain = F.when(F.rlike(t, F.lit(r"^\\u[0-9a-fA-F]{4}")), points)
        for escape, char in PLAIN_ESCAPES:
            plain = plain.when(t == escape, char)
        return plain.otherwise(t)

    return F.array_join(F.transform(tokens, read), "")


def repair_text(c, unwrap: bool = False) -> Column:
    """Control characters that stand for lost escapes restored, stray slashes off, long runs of empty commands collapsed; a tail that breaks off inside a formula is cut at the last sentence end, or before the formula.

    With `unwrap`, a JSON object around the text is taken off first, and the text of an object that breaks off has its tail cut.
    """
    reply = unwrapped_reply(c) if unwrap else {"text": _c(c), "cut": F.lit(False)}
    v = reply["text"]
    for char, escape in LOST_ESCAPES:
        v = F.replace(v, F.lit(char), F.lit(escape))
    v = F.regexp_replace(v, rf"\\/({'|'.join(SLASHED)})", r"\\$1")
    v = F.regexp_replace(v, EMPTY_TEXTS, r"\\;")
    v = F.regexp_replace(v, REPEATED_SPACES, r"\\,")
    end = F.regexp_replace(v, r"\s+$", "")
    open_formula = (F.regexp_count(end, F.lit(r"\$")) - F.regexp_count(end, F.lit(r"\\\$"))) % 2 == 1
    broken = reply["cut"] | (open_formula & F.rlike(end, F.lit(BROKEN_END)))
    sentences = F.regexp_extract(end, SENTENCES, 1)
    before = F.when(open_formula, F.regexp_replace(F.regexp_extract(end, r"(?s)^(.*[^\\]|)\$", 1), r"[ \t\r\n,:;]+$", "")).otherwise(end)
    return F.when(broken, F.when(sentences != "", sentences).otherwise(before)).otherwise(v)


def excerpt(c, n: int) -> Column:
    v = normalize_space(c)
    return F.when(F.char_length(v) > n, F.concat(F.substring(v, 1, n - 1), F.lit("…"))).otherwise(v)


def visible_prefix(steps, last, substitute=None, empty: str = "(no steps)") -> Column:
    """Steps 0..last, numbered and joined by blank lines; `substitute` maps an index to other text."""
    own = F.when(_c(last) >= 0, F.slice(_c(steps), 1, _c(last) + 1)).otherwise(F.slice(_c(steps), 1, 0))

    def line(x: Column, i: Column) -> Column:
        text = F.coalesce(F.try_element_at(_c(substitute), i), x) if substitute is not None else x
        return F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), text)

    return F.when(F.size(own) == 0, empty).otherwise(F.array_join(F.transform(own, line), "\n\n"))


def split_context(steps, k) -> dict[str, Column]:
    """prefix, target and downstream text around step k."""
    s, k = _c(steps), _c(k)
    join = lambda a: F.array_join(a, "\n")
    return {"prefix": join(F.slice(s, 1, k)), "target": F.get(s, k), "downstream": join(F.slice(s, k + 2, F.greatest(F.size(s), F.lit(1))))}


def wilson_upper(rate, n, z: float = 1.645) -> Column:
    """One-sided upper bound of a share; 1 without observations."""
    p, n, z2 = _c(rate), _c(n).cast("double"), z * z
    bound = (p + z2 / (2 * n) + z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return F.when(n > 0, bound).otherwise(F.lit(1.0))


def blind_id(c, seed, width: int = 8) -> Column:
    return F.lpad(hash_mod(stable_hash(c, seed), 10**width).cast("string"), width, "0")


def hash_jitter(c, seed, width: float = 0.22) -> Column:
    return (hash_mod(stable_hash(c, seed), 1000) / 1000.0 - 0.5) * width


def scale_pp(c, digits: int = 2) -> Column:
    return F.round(_c(c) * 100, digits)


def length_ratio_ok(original, rewritten, lo: float = 0.5, hi: float = 1.7) -> Column:
    """A rewrite counts if it is there, differs, and its length is between lo and hi times the original's."""
    a, b = strip(original), strip(rewritten)
    ratio = F.char_length(b) / F.nullif(F.char_length(a), F.lit(0))
    return F.coalesce((b != "") & (a != b) & (ratio >= lo) & (ratio <= hi), F.lit(False))


def snake(name: str) -> str:
    return re.sub(r"\W+", "_", name).strip("_").lower()
