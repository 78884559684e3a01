"""Personal data in texts, with DataFrame functions only: patterns propose, checksums confirm, context adjusts.

Each pattern marks its matches in the text with two control characters (any that the text itself has are replaced by a
third beforehand, which no pattern can match); splitting at the marks gives every match and, by adding up lengths, its
place in code points. The lengths are added up in blocks, so a text of many thousand matches costs little more than its
length. The plan is one projection over the scan: no shuffle, no state, whole texts.

Two patterns need care to stay linear on long runs that lead nowhere (an endless word without an @): a start inside such
a run can match only if the start of the run could, so starts are tried only where the run begins or the last match
ended. Repeated groups are possessive, which changes no match here and keeps the matcher's stack flat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillset.llm.common import select_text

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"

#: The kinds in output order, with their patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9_])",
    "secret": r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|(?i:api_?key|secret|token|passwd|password)\x20?[=:]\x20?[\x22\x27]?[A-Za-z0-9+/_-]{16,}+)",
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: A span's score before context, and what a context word nearby adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.7}
CONTEXT_BONUS = 0.1
CONTEXT_CHARS = 40
MASK_CHUNK = 2048
CONTEXT = {
    "email": r"mail|contact|write to|kontakt|correo|courriel",
    "ip": r"(?:^|[^a-z0-9_])ip(?:[^a-z0-9_]|$)|address|server|host|adresse|direcci",
    "card": r"card|visa|mastercard|payment|credit|karte|tarjeta|carte",
    "phone": r"phone|call|mobile|(?:^|[^a-z0-9_])tel|fax|anruf|tel[eé]f|t[eé]l[eé]ph",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "secret": r"key|secret|token|credential|login|auth",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit counts double."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(_chars(F.reverse(digits)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10: first four characters last, letters as 10 to 35, remainder 1."""
    turned = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(_chars(turned), F.lit(0), step) == 1


def _part_ok(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(bare) > 3, F.lit(False)).when(F.length(bare) == 0, F.lit(True)).otherwise(bare.cast("int") <= 255)


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _part_ok)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.translate(value, " ", ""))
    return F.lit(True)


def _marked(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN)


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """[0, step(0, v0), ...] of an array of longs, in blocks of about its root, so that n values cost n ** 1.5 copied numbers."""
    n = F.size(values)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), width), lambda a: F.slice(values, a + 1, width))

    def within(out: Column, block: Column) -> Column:
        ends = F.aggregate(block, F.array(F.element_at(out, -1)), lambda x, v: F.concat(x, F.array(step(F.element_at(x, -1), v))))
        return F.concat(out, F.slice(ends, F.lit(2), F.size(block)))

    return F.aggregate(blocks, F.array(F.lit(0).cast("long")), within)


def _spans(kind: str, parts: Column, ends: Column) -> Column:
    """Confirmed spans from the marked text's parts (the text before the first match, then each match with what follows) and their ends."""
    some = F.greatest(F.size(parts) - 1, F.lit(0))

    def raw(before: Column, part: Column) -> Column:
        size = F.instr(part, CLOSE) - 1
        rest = F.substring(part, size + 2, F.lit(2147483647))
        near = F.concat(F.right(F.substring_index(before, CLOSE, -1), F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(rest, F.lit(CONTEXT_CHARS)))
        return F.struct(size.cast("long").alias("size"), F.substring_index(part, CLOSE, 1).alias("value"), near.alias("near"))

    found = F.zip_with(F.slice(parts, F.lit(1), some), F.slice(parts, F.lit(2), some), raw)
    placed = F.zip_with(found, F.slice(ends, F.lit(2), some), lambda m, at: F.struct(m["value"].alias("value"), m["near"].alias("near"), at.alias("start"), (at + m["size"]).alias("end")))

    def scored(m: Column) -> Column:
        bonus = F.when(F.lower(m["near"]).rlike(CONTEXT[kind]), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.round(F.lit(SCORES[kind]) + bonus, 3).alias("score"))

    confirmed = F.transform(F.filter(placed, lambda m: _valid(kind, m["value"])), scored)
    return F.when(F.size(parts) > 1, confirmed).otherwise(F.array()).cast(SPANS)


def with_spans(df: DataFrame, text_col: str = "text", out: str = "spans", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """df with one more column: the confirmed spans of its text column, an array of (kind, start, end, value, score)."""
    columns, plain = [F.col(f"`{c}`") for c in df.columns], "__pii_plain"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = df.select(*columns, F.translate(text, OPEN + CLOSE, OTHER + OTHER).alias(plain))
    marked = marked.select(*columns, *[_marked(F.col(plain), PATTERNS[k]).alias(f"__pii_{k}") for k in kinds])
    sizes = [F.transform(f"__pii_{k}", lambda p, i: (F.length(p) - F.when(i > 0, 1).otherwise(0)).cast("long")).alias(f"__pii_sizes_{k}") for k in kinds]
    marked = marked.select(*columns, *[f"__pii_{k}" for k in kinds], *sizes)
    ends = [F.when(F.size(f"__pii_{k}") > 1, _running(F.col(f"__pii_sizes_{k}"), lambda at, size: at + size)).alias(f"__pii_ends_{k}") for k in kinds]
    marked = marked.select(*columns, *[f"__pii_{k}" for k in kinds], *ends)
    return marked.select(*columns, F.concat(*[_spans(k, F.col(f"__pii_{k}"), F.col(f"__pii_ends_{k}")) for k in kinds]).alias(out))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """One row per row: doc_id, text and spans, an array of (kind, start, end, value, score) by kind as listed, then start.

    Places are code points, end exclusive; matches of one kind don't overlap, those of different kinds may (a phone number
    inside a card). A match that its checksum or length refuses is dropped and not tried again shorter. Context words within
    CONTEXT_CHARS raise a span's score and never drop it. A null text counts as empty and has no spans; repeated rows are
    scanned each; an empty table gives no rows.
    """
    return with_spans(select_text(docs, id_col, text_col), "text", "spans", kinds)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (kind:start:end, comma-joined) and their scores of find_pii's rows."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(F.concat_ws(",", F.transform(base, label)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", label)).alias("spans"),
        F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string"))).alias("scores"),
    )


def with_masked(df: DataFrame, text_col: str = "text", spans_col: str = "spans", out: str = "masked") -> DataFrame:
    """df with one more column: its text with every span replaced by its kind in angle brackets.

    Of overlapping spans the one that starts first is shown, and what the others cover goes too. A text without spans, null
    included, stays as it is. The text is cut into chunks once, so that a span's surroundings are found without walking the
    text from its start.
    """
    columns, text = [F.col(f"`{c}`") for c in df.columns], F.col(f"`{text_col}`")
    ordered = F.array_sort(F.transform(F.col(f"`{spans_col}`"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    chunks = F.transform(F.sequence(F.lit(0), F.length(text), F.lit(MASK_CHUNK)), lambda a: F.substring(text, a + 1, F.lit(MASK_CHUNK)))
    step = df.select(*columns, ordered.alias("__pii_ordered"), chunks.alias("__pii_chunks"))
    covered = _running(F.transform("__pii_ordered", lambda s: s["end"]), lambda at, end: F.greatest(at, end))
    step = step.select(*columns, "__pii_ordered", "__pii_chunks", covered.alias("__pii_covered"))

    def cut(a: Column, b: Column) -> Column:
        first = F.floor(a / MASK_CHUNK).cast("int")
        near = F.slice("__pii_chunks", first + 1, F.floor(b / MASK_CHUNK).cast("int") - first + 1)
        return F.substring(F.array_join(near, ""), (a - first * MASK_CHUNK + 1).cast("int"), (b - a).cast("int"))

    def shown(s: Column, at: Column) -> Column:
        return F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))

    pieces = F.zip_with("__pii_ordered", F.slice("__pii_covered", F.lit(1), F.size("__pii_ordered")), shown)
    masked = F.concat(F.array_join(pieces, ""), cut(F.element_at("__pii_covered", -1), F.length(text).cast("long")))
    return step.select(*columns, F.when(F.size("__pii_ordered") > 0, masked).otherwise(text).alias(out))
