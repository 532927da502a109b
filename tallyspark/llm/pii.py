"""Personal data: candidate spans from high-recall patterns, judged by boosted trees; all in SQL functions.

Generators propose spans, overlapping ones too: the four base kinds, and looser forms of them, ids
and secrets. Each candidate gets a code of a few format and context features, and each kind has a
check that its values may fail (Luhn, mod 97, octets, name forms, address ranges ...). How many
candidates of a code pass is counted over all rows, apart for two halves dealt by a hash of the
candidate's place. Boosted trees are fitted to the counts of one half, of which there are at most
`CODES`, and so judge a format in its context rather than a single value: where most matches fail,
a pass is chance. For each kind the lowest threshold is kept at which nine of ten candidates of the
other half pass. As the trees see nothing but the code, their decision is a set of codes, and rows
are scored by plain expressions: a looser candidate is selected if its code is and it passes its
check. Base spans that pass their rule always stay.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import materialise

KINDS = ("email", "ip", "card", "phone", "id", "secret")

# The base patterns. Matches start where a run starts (or right after the last match)
# and take it whole, which finds the same spans as plain greedy search but never searches a run twice.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must hold for a base pattern to be worth a search.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
# Looser forms.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,}+)++", r"[\[(]at[\])]"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    ("secret", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", r"AKIA"),
    ("secret", r"(?i)(?<![a-z0-9])(?:password|passwd|token|secret|api_?key)[\"']? ?[:=] ?[\"']?[a-z0-9+/_-]{8,}+", r"[:=]"),
)
# Words that go before personal data.
CONTEXT = r"(?i)mail|phone|call|tel|card|visa|iban|address|ssn|password|token|secret|key|account"
CONTEXT_CHARS = 24
#: Bounds of the digit counts' buckets.
DIGITS = (1, 9, 10, 13, 14, 17)
CODES = len(KINDS) * (len(DIGITS) + 1) * 2**4
PRECISION = 0.9
#: Working columns, under names that no table will have.
CANDIDATES, BASE_SPANS, ALL_SPANS = (f"__tallyspark_pii_{x}" for x in ("candidates", "base", "all"))

EMPTY = "CAST(array() AS array<struct<kind: int, start: int, end: int, code: int, valid: boolean, base: boolean>>)"


#: Elements that one step of a fold handles, so that folds copy little however many there are, and
#: characters of a block of text that is cut out at places.
FOLD, BLOCK = 256, 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Fold an array from the left with a running value: `step(value, item)` gives the next value and
    an array that is put out. Returns the last `value` and all that was put `out`, of SQL type `kind`."""
    empty = F.expr(f"CAST(array() AS array<{kind}>)")
    blocks = F.expr(f"CAST(array() AS array<array<{kind}>>)")

    def add(have: Column, item: Column) -> Column:
        value, out = step(have["value"], item)
        return F.struct(value.alias("value"), F.concat(have["out"], out).alias("out"))

    def whole(items: Column) -> Column:
        def block(have: Column, i: Column) -> Column:
            done = F.aggregate(F.slice(items, i * FOLD + 1, FOLD), F.struct(have["value"].alias("value"), empty.alias("out")), add)
            return bound(done, lambda x: F.struct(x["value"].alias("value"), F.concat(have["out"], F.array(x["out"])).alias("out")))

        count = F.greatest(F.ceil(F.size(items) / FOLD).cast("int"), F.lit(1))
        done = F.aggregate(F.sequence(F.lit(0), count - 1), F.struct(first.alias("value"), blocks.alias("out")), block)
        return bound(done, lambda x: F.struct(x["value"].alias("value"), F.flatten(x["out"]).alias("out")))

    return bound(items, whole)


HIT = "struct<start: int, end: int, value: string, before: string, after: string>"


def found(text: Column, pattern: str, hint: str) -> Column:
    """Array of (start, end, value, before, after) of all matches, in code points, end exclusive;
    `before` is what the text holds before the match, up to CONTEXT_CHARS, and `after` the next character."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.expr(f"CAST(NULL AS {HIT})")

    def add(have: Column, piece: Column) -> tuple[Column, Column]:
        gap, hit, last = piece["gap"], piece["hit"], have["last"]  # the last gap has no hit
        start = have["at"] + F.char_length(gap)
        here = F.struct(
            start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("value"), F.right(F.concat(have["tail"], gap), F.lit(CONTEXT_CHARS)).alias("before"), F.lit("").alias("after"),
        )
        after = F.left(F.when(gap != "", gap).otherwise(F.coalesce(hit, F.lit(""))), F.lit(1))
        done = F.when(last.isNull(), F.expr(f"CAST(array() AS array<{HIT}>)")).otherwise(F.array(F.struct(*(last[c].alias(c) for c in ("start", "end", "value", "before")), after.alias("after"))))
        tail = F.right(F.concat(have["tail"], gap, F.coalesce(hit, F.lit(""))), F.lit(CONTEXT_CHARS))
        at = start + F.coalesce(F.char_length(hit), F.lit(0))
        return F.struct(at.alias("at"), tail.alias("tail"), F.when(hit.isNotNull(), here).otherwise(none).alias("last")), done

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("last"))
    return F.when(text.rlike(hint), folded(pieces, first, add, HIT)["out"]).otherwise(F.expr(f"CAST(array() AS array<{HIT}>)"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.char_length(digits) - i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c > 64, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), add) == 1


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def base_rule(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n = F.char_length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return F.when(_between(n, 14, 19), luhn(_digits(value))).otherwise(F.lit(False))
    return _between(n, 10, 15) if kind == "phone" else F.lit(True)


def loose_rule(kind: str, value: Column) -> Column:
    """The check that a looser match of a kind may pass or not."""
    n = F.char_length(_digits(value))
    if kind == "card":
        return F.when(_between(n, 13, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "id":
        return F.when(value.rlike("^[A-Z]"), mod97(value)).otherwise(~value.rlike("^(?:000|666|9)|-00-|-0000$"))
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    if kind == "email":
        return ~value.rlike(_BAD_NAME) & value.rlike(_TOP_NAME)
    if kind == "ip":
        return value.rlike(_ADDRESS) & value.rlike("[0-9A-Fa-f]{3}")
    return _between(n, 10, 15)


# What no mail address has (a dot at either end of its name or twice), how one ends, and
# how addresses start that are in use: global, local to a site, to a link.
_BAD_NAME = r"^\.|\.\.|\. ?[\[(]at|^-"
_TOP_NAME = r"(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]{2,24}$"
_ADDRESS = r"^(?i)(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):"


def _code(kind: str, hit: Column) -> Column:
    """Format and context of a match as one number."""
    value, n = hit["value"], F.char_length(_digits(hit["value"]))
    bucket = sum((F.when(n >= bound, 1).otherwise(0) for bound in DIGITS), F.lit(0))
    flags = (
        value.rlike("[0-9][ .()-]+[0-9]"),
        value.rlike("[0-9]") & value.rlike("[A-Za-z]"),
        hit["before"].rlike(CONTEXT),
        hit["before"].rlike(r"[A-Za-z0-9]\z") | hit["after"].rlike("[A-Za-z0-9]"),
    )
    code = F.lit(KINDS.index(kind)) * (len(DIGITS) + 1) + bucket
    for flag in flags:
        code = code * 2 + F.when(flag, 1).otherwise(0)
    return code.cast("int")


def _features(code: np.ndarray) -> np.ndarray:
    """What a code was made from, one column each."""
    flags = [(code >> i) & 1 for i in range(4)]
    rest = code >> 4
    kind = rest // (len(DIGITS) + 1)
    return np.stack([*(kind == k for k in range(len(KINDS))), rest % (len(DIGITS) + 1), *flags], axis=1).astype(float)


def candidates(text: Column) -> Column:
    """All proposed spans: kind, start, end, code, valid (passes its check), base (by a base pattern)."""

    def judged(kind: str, pattern: str, hint: str, rule: Callable[[str, Column], Column], base: bool) -> Column:
        def one(hit: Column) -> Column:
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), hit["start"].alias("start"), hit["end"].alias("end"), _code(kind, hit).alias("code"), rule(kind, hit["value"]).alias("valid"), F.lit(base).alias("base"))

        return F.transform(found(text, pattern, hint), one)

    base = [judged(k, p, HINTS[k], base_rule, True) for k, p in BASE.items()]
    return F.concat(*base, *(judged(k, p, h, loose_rule, False) for k, p, h in LOOSE))


def fit_codes(candidates_: DataFrame) -> list[int]:
    """The codes that the boosted trees select, learned from the candidates (column CANDIDATES) of all
    rows: fitted to one half of them, and thresholds set by the other."""
    each = candidates_.select(F.explode(CANDIDATES).alias("c"), F.pmod(F.xxhash64("c.start", "c.end", F.size(CANDIDATES)), F.lit(2)).alias("half"))
    rows = each.groupBy("c.code", "half").agg(F.count(F.lit(1)).alias("n"), F.count_if("c.valid").alias("valid")).orderBy("code").collect()  # 2 * CODES rows at most
    code = np.unique(np.array([r["code"] for r in rows], dtype=np.int64))
    n, valid = np.zeros((2, len(code))), np.zeros((2, len(code)))
    for r in rows:
        at = np.searchsorted(code, r["code"])
        n[r["half"], at], valid[r["half"], at] = r["n"], r["valid"]
    return select_codes(code, n, valid)


def select_codes(code: np.ndarray, n: np.ndarray, valid: np.ndarray) -> list[int]:
    """Codes above their kind's threshold. `n` and `valid`: candidates of each code, and those that
    pass their check, in the half to fit (row 0) and in the half to calibrate (row 1)."""
    x = _features(code)
    y = np.concatenate((np.ones(len(code)), np.zeros(len(code))))
    model = boosting.fit(np.concatenate((x, x)), y, np.concatenate((valid[0], n[0] - valid[0])), trees=40, depth=3, rate=0.3, least=1.0)
    score = model.probabilities(x) if len(x) else np.empty(0)
    chosen: list[int] = []
    kind = code // (16 * (len(DIGITS) + 1))
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        levels = np.unique(score[own])[::-1]  # codes of one score go together
        for threshold in levels[::-1]:  # the lowest threshold that is precise enough
            above = own[score[own] >= threshold]
            # A kind so rare that this half has none of it is judged by the other half.
            half = 1 if n[1, above].sum() else 0
            if valid[half, above].sum() >= PRECISION * n[half, above].sum():
                chosen += code[above].tolist()
                break
    return sorted(chosen)


SPAN = "struct<start: int, kind: int, end: int>"


def with_spans(candidates_: DataFrame, codes: list[int]) -> DataFrame:
    """Rows with BASE_SPANS and ALL_SPANS in place of CANDIDATES: arrays of (start, kind, end),
    ordered, base rules applied."""

    def bare(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))

    base = F.filter(CANDIDATES, lambda x: x["base"] & x["valid"])
    more = F.filter(CANDIDATES, lambda x: x["valid"] & (x["base"] | (x["code"].isin(codes) if codes else F.lit(False))))

    def once(last: Column, span: Column) -> tuple[Column, Column]:  # of equal spans, neighbours in order, one stays
        return span, F.when(last.eqNullSafe(span), F.expr(f"CAST(array() AS array<{SPAN}>)")).otherwise(F.array(span))

    distinct = folded(F.array_sort(F.transform(more, bare)), F.expr(f"CAST(NULL AS {SPAN})"), once, SPAN)["out"]
    return candidates_.withColumns({BASE_SPANS: F.array_sort(F.transform(base, bare)), ALL_SPANS: distinct}).drop(CANDIDATES)


def _named(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base rules alone; `spans` lists all selected spans as
    kind:start:end by start, then kind, in code points with the end exclusive. Null and empty texts
    have none. Texts are read whole, once; what stays of them are the candidates. Rows of a null or
    repeated id are rows like any other. Spans that start together are ordered by kind, then end. An
    empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), candidates(F.coalesce(text_col, F.lit(""))).alias(CANDIDATES))
    rows = materialise(rows, "candidates")
    out = with_spans(rows, fit_codes(rows))

    def count(kind: str) -> Column:
        return F.size(F.filter(BASE_SPANS, lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return out.select("doc_id", *counts, F.sha2(_named(BASE_SPANS), 256).alias("base_sha256"), _named(ALL_SPANS).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every selected span replaced by its kind in brackets; overlapping spans become one,
    named by the first. Null texts stay null; repeated rows and all columns stay; an empty table
    stays empty. Texts may have any length."""
    rows = materialise(docs.withColumn(CANDIDATES, candidates(F.coalesce(text_col, F.lit("")))), "redaction")
    out = with_spans(rows, fit_codes(rows.select(CANDIDATES)))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col(text_col)

    def replaced(blocks: Column) -> Column:
        """The text, given as blocks of BLOCK characters, so that no place is counted from its start."""

        def cut(start: Column, end: Column) -> Column:
            first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
            part = lambda i, at, n: F.substring(F.coalesce(F.get(blocks, i), F.lit("")), at, n)
            inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            across = F.concat(part(first, start % BLOCK + 1, F.lit(BLOCK)), inner, part(last, F.lit(1), end % BLOCK))
            return F.when(first == last, part(first, start % BLOCK + 1, end - start)).otherwise(across)

        def add(at: Column, span: Column) -> tuple[Column, Column]:
            parts = F.when(span["start"] >= at, F.array(cut(at, span["start"]), F.get(names, span["kind"]))).otherwise(F.expr("CAST(array() AS array<string>)"))
            return F.greatest(at, span["end"]), parts

        done = folded(F.col(ALL_SPANS), F.lit(0), add, "string")
        return bound(done, lambda x: F.concat(F.array_join(x["out"], ""), cut(x["value"], F.char_length(text))))

    whole = bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), replaced)
    return out.withColumn(text_col, F.when(F.size(ALL_SPANS) > 0, whole).otherwise(text)).select(*docs.columns)
