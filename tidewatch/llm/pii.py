"""Finds personal data: regular expressions propose spans, checksums confirm them, context words near a span adjust its score.

All of it is made of SQL functions. Spans are code point positions, end exclusive. A pattern is searched twice, once for the matches and once
for the text between them, whose lengths add up to the positions; texts without a match are only searched once.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.columns import free


class Kind(NamedTuple):
    """``valid`` judges a match; ``score`` is its own weight and ``context`` what one of ``words`` near it adds; kept from ``THRESHOLD`` on.

    With ``shorten`` the pattern takes only the head of a match and looks ahead at what may follow, its first group; ``shorten`` gives the
    part of both that is the match, or null. So what follows a match, and what is in a wrong one, is searched as well.
    """

    name: str
    pattern: str
    valid: object
    score: float
    context: float
    words: tuple[str, ...]
    shorten: object = None


#: A span is kept when its score is at least this much.
THRESHOLD = 0.5
#: Code points on either side in which context words count.
NEAR = 40


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a bank account code (two letters, two check digits, letters and digits) has the remainder 1."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest, c):
        v = F.ascii(c)
        return F.when(v >= 65, (rest * 100 + v - 55) % 97).otherwise((rest * 10 + v - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


#: Characters of a bank account code by country; others are judged as a whole.
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "IR IS TR DZ", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _bank_code(m: Column) -> Column:
    """The bank account code that ``m`` starts with: as long as its country's are and the checksum holds, or else all of ``m``; null if there is none."""
    valid = lambda c: mod97(F.regexp_replace(c, "\\x20", ""))
    country = F.substring(m, 1, 2)
    length = F.coalesce(*[F.when(country.isin(*names.split()), n) for n, names in _IBAN.items()])
    own = F.regexp_substr(m, F.concat(F.lit(r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){"), (length - 4).cast("string"), F.lit("}(?![A-Za-z0-9])")))
    return F.when(own.isNotNull() & valid(own), own).when(valid(m), m)


def _small_parts(m: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, "\\."), lambda p: F.when(F.length(bare(p)) <= 3, bare(p).cast("int") <= 255).otherwise(False))


#: The possessive forms and the looks behind find the same matches as the plain patterns, without searching a long run again from each of its places.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.8, 0.1,
         ("mail", "contact", "write", "kontakt", "correo")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _small_parts, 0.6, 0.2, ("ip", "address", "host", "server", "login")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", lambda m: F.length(_digits(m)).between(13, 19) & luhn(_digits(m)), 0.8, 0.2,
         ("card", "visa", "credit", "karte", "carte", "tarjeta")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.6, 0.3, ("phone", "call", "tel", "mobile", "fax")),
)
#: Found besides the base kinds: a bank code by its checksum alone, a social security number only beside a context word.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))",
         lambda m: F.lit(True), 0.9, 0.1, ("iban", "bank", "account", "konto", "compte", "cuenta"), _bank_code),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(000|666|9..)|-00-|-0000$"), 0.3, 0.4, ("ssn", "social security")),
)
_SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def _spans(text: Column, kind: Kind) -> Column:
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found)), lambda g: F.length(g).cast("long"))
    after = F.regexp_extract_all(text, pattern, F.lit(1)) if kind.shorten else F.transform(found, lambda m: F.lit(""))
    pieces = F.arrays_zip(found.alias("m"), gaps.alias("g"), after.alias("a"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<m:string,start:long,end:long>>").alias("all"))

    def place(acc, p):
        begin = acc["at"] + p["g"]
        end = begin + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(F.struct(F.concat(p["m"], p["a"]).alias("m"), begin.alias("start"), end.alias("end")))).alias("all"))

    placed = F.aggregate(pieces, start, place)["all"]
    if kind.shorten:
        cut = F.filter(F.transform(placed, lambda s: F.struct(kind.shorten(s["m"]).alias("m"), s["start"].alias("start"))), lambda s: s["m"].isNotNull())
        cut = F.transform(cut, lambda s: F.struct(s["m"].alias("m"), s["start"].alias("start"), (s["start"] + F.length(s["m"])).alias("end")))
        none = F.array().cast("array<struct<m:string,start:long,end:long>>")
        apart = lambda all_, s: F.when(F.coalesce(F.try_element_at(all_, F.lit(-1))["end"], F.lit(0)) <= s["start"], F.concat(all_, F.array(s))).otherwise(all_)
        placed = F.aggregate(cut, none, apart)
    placed = F.filter(placed, lambda s: kind.valid(s["m"]))

    def scored(s):
        left = F.greatest(s["start"] - NEAR, F.lit(0))
        around = F.concat_ws(" ", F.substring(text, (left + 1).cast("int"), (s["start"] - left).cast("int")), F.substring(text, (s["end"] + 1).cast("int"), F.lit(NEAR)))
        near = F.lower(around).rlike(r"(?<![a-z])(" + "|".join(kind.words) + ")")
        score = F.lit(kind.score) + F.when(near, F.lit(kind.context)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score, 3).alias("score"))

    kept = F.filter(F.transform(placed, scored), lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(kind.pattern), kept).otherwise(F.array().cast(_SPANS))


def with_spans(docs: DataFrame, kinds: tuple[Kind, ...] = BASE + ADDED, column: str = "spans") -> DataFrame:
    """``docs`` with a column of (kind, start, end, score), by kind as listed, then start.

    ``docs`` needs a text; every other column stays as it is, but one named ``column`` is replaced. A null or empty text has no spans. Matches of one kind do not overlap, spans of
    different kinds may. The base kinds stay whatever their context; it only raises their score.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(column, F.concat(*[_spans(text, k) for k in kinds]))


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = BASE + ADDED) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; spans that overlap become one, named after the first."""
    spans, = free(docs, "pii_spans")
    found = with_spans(docs, kinds, spans)
    text = F.col("text")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def replace(acc, s):
        ahead = s["start"] >= acc["at"]
        before = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(ahead, F.concat(acc["done"], before, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["done"]).alias("done"))

    state = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done")), replace,
                        lambda acc: F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.size(spans) > 0, state).otherwise(text)
    return found.withColumn("text", clean).drop(spans)
