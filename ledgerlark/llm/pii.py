"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score. DataFrame functions only.

Kinds: email, ip, card and phone (the base: kept whatever their score), then iban (mod 97) and national_id, which are kept at a score
of 0.5 or more. A score is the kind's own plus CONTEXT for each side of the span on which a word of the kind stands within NEAR
characters, at most 1.

Quantifiers are possessive wherever giving back could not help, so very long runs neither recurse nor go quadratic. \\G admits a span
that begins where the one before has ended, inside a run that a look-behind would refuse.

Defined results: a null text counts as empty, an empty text has no spans; repeated rows each get their result; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPAN, find_spans, free, let, written

# The kinds' expressions.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# Conditions that any text with such a span meets, cheaper than the expression; of card, the shortest run that can pass.
MANY_DIGITS = r"[0-9](?:[ -]?[0-9]){12}"
PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
# Own score, context words.
KINDS = {
    "email": (0.9, "mail|contact|write|courriel|correo"),
    "ip": (0.6, "ip|address|host|server|adresse"),
    "card": (0.7, "card|visa|credit|carte|karte|tarjeta"),
    "phone": (0.7, "phone|call|tel|mobile|fax"),
    "iban": (0.8, "iban|account|bank|konto|compte|cuenta"),
    "national_id": (0.3, "ssn|social|security|national"),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT, NEAR, LEAST = 0.2, 40, 0.5


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """True if a string of digits passes: from the right, every second digit doubled, less 9 if over 9; the sum a multiple of 10."""
    ds = F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), lambda c: c.cast("int"))
    value = lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.transform(ds, value), F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(s: Column) -> Column:
    """True if an account number without blanks passes: first four characters last, letters as 10 to 35, remainder 1."""
    moved = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))
    step = lambda acc, c: F.when(c < "A", acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike(PART))
    if kind == "card":
        return let(digits(hit), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    if kind == "iban":
        return let(F.replace(hit, F.lit(" "), F.lit("")), lambda s: F.length(s).between(15, 34) & mod97(s))
    return F.lit(True)


def finders(text: Column) -> dict[str, tuple[Column, str, Column | None]]:
    """By kind: a cheap condition and the expression."""
    return {
        "email": (F.contains(text, F.lit("@")), EMAIL),
        "ip": (F.contains(text, F.lit(".")), IP),
        "card": (text.rlike(MANY_DIGITS), CARD),
        "phone": (F.contains(text, F.lit("+")), PHONE),
        "iban": (text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), IBAN),
        "national_id": (F.contains(text, F.lit("-")), NATIONAL_ID),
    }


def score(text: Column, kind: str, s: Column) -> Column:
    own, words = KINDS[kind]
    word = rf"(?i)(?<![a-z])(?:{words})"
    left = F.substring(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR)))
    right = F.substring(text, s["end"] + 1, F.lit(NEAR))
    return F.least(F.lit(1.0), F.lit(own) + F.when(left.rlike(word), CONTEXT).otherwise(0.0) + F.when(right.rlike(word), CONTEXT).otherwise(0.0))


SCORED = "array<struct<kind:string,start:int,end:int,score:double>>"


def scored(text: Column, spans: Column, kind: str) -> Column:
    """The spans that the kind's checksum confirms, with scores."""
    good = F.filter(spans, lambda s: valid(kind, s["hit"]))
    rows = F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(text, kind, s).alias("score")))
    if kind not in BASE:
        rows = F.filter(rows, lambda x: x["score"] >= LEAST)
    return F.when(F.size(spans) > 0, rows).otherwise(F.array().cast(SCORED)).cast(SCORED)


def detect(df: DataFrame, text: str = "text", out: str = "pii", kinds=tuple(KINDS)) -> DataFrame:
    """Add `out`, an array of (kind, start, end, score), by kind as listed, then start; code points, end exclusive. The text of each
    span is substring(text, start + 1, end - start). A column named `out` is replaced."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    of, found = free(["__t"], df.columns)[0], free([f"__{k}" for k in kinds], df.columns)
    base = df.withColumn(of, t)
    find = finders(F.col(of))
    base = base.withColumns({c: find_spans(F.col(of), find[k][1], find[k][0]) for k, c in zip(kinds, found, strict=True)})
    parts = [scored(F.col(of), F.col(c), k) for k, c in zip(kinds, found, strict=True)]
    return base.withColumn(out, F.concat(*parts)).drop(of, *found)


def cut(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap all go, and the first by start (of equals the
    longest) gives the kind."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("at"))

    def step(acc, s):
        piece = F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.when(s["start"] >= acc["at"], F.concat(acc["done"], piece)).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], -s["back"]).alias("at"))

    return F.aggregate(ranked, none, step, lambda acc: F.array_join(F.concat(acc["done"], F.array(F.substr(text, acc["at"] + 1))), ""))


def redact(df: DataFrame, text: str = "text", kinds=tuple(KINDS)) -> DataFrame:
    """Cut out what detect finds, again and again until it finds nothing: a span that is gone may leave one that it had spoilt (a card beside
    another number in one run of digits). Only rows with spans go through a round, as a scratch table, and leave with the first that
    finds none in them, so rows without spans are neither written nor read again. A null text stays null."""
    found = free(["__found"], df.columns)[0]
    some = F.size(found) > 0
    looked = detect(df, text, found, kinds)
    done = looked.where(~some)
    while True:
        table = written(looked.where(some).withColumn(text, cut(F.col(text), F.col(found))).drop(found), "redacted")
        if table.isEmpty():
            return done.drop(found)
        looked = detect(table, text, found, kinds)
        done = done.unionByName(looked.where(~some))


__all__ = ["SPAN", "detect", "redact", "luhn", "mod97"]
