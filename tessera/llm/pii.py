"""Personal data: regular expressions propose spans, checksums confirm them,
words nearby adjust their score. Built-in functions only.

Kinds, in the order they are listed: ``email``, ``ip``, ``card`` (Luhn) and
``phone`` are the base kinds, whose passing matches are always spans. Two more
kinds add spans: ``iban`` (its country's length, mod-97 must hold) and ``ssn`` (ddd-dd-dddd), both only
when their score reaches ``threshold``. A score starts at the kind's own value
and rises by ``near`` when one of the kind's context words stands within
``window`` characters before or after the span, on either side.

Defined cases: a null text is an empty one and has no spans. Every row is judged
on its own, so repeated rows give repeated results and a null doc_id is kept.
Extra columns are ignored (``find_pii``) or kept as they are (``redact``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .spans import blocks, count_of, cut, find, joined, later, let, running

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length of an account number -> the countries that use it: the IBAN registry, then those that use one unregistered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST AO CV GW MZ", 26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}
_KNOWN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_OTHER = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
#: Group 1 is the number: as long as its country's are, or up to the last word's end for other codes.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_KNOWN}|{_OTHER})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: kind -> (own score, words that raise it)
CONTEXT = {
    "email": (0.6, "e-?mail|mail|contact|write|kontakt|courriel|correo"),
    "ip": (0.5, "ip|address|host|server|login"),
    "card": (0.6, "card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta"),
    "phone": (0.5, "phone|call|tel|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono"),
    "iban": (0.7, "iban|bank|account|konto|compte|cuenta"),
    "ssn": (0.2, "ssn|social|security|insurance"),
}
BASE = ("email", "ip", "card", "phone")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, digits summed, divisible by 10."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return (total + F.when((n - i) % 2 == 1, twice).otherwise(d)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """An IBAN without blanks: first four characters moved to the end, letters
    read as 10 to 35, the number leaves 1 when divided by 97."""
    moved = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substr(account, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.substr(moved, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise(
            (rest * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


def _iban(m: Column) -> Column:
    plain = F.regexp_replace(m, r"\x20", "")
    return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)


def base_spans(text: Column) -> Column:
    return F.concat(
        find(text, EMAIL, "email", 0, lambda m: F.lit(True)),
        find(text, IP, "ip", 1, lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        find(text, CARD, "card", 2, _card),
        find(text, PHONE, "phone", 3, lambda m: F.length(_digits(m)).between(9, 15)))


def scored(text: Column, spans: Column, window: int = 40, near: float = 0.3) -> Column:
    """Array of structs: the span's fields and ``score``."""

    def rate(s: Column, pieces: Column) -> Column:
        before = F.greatest(s["start"] - window, F.lit(0))
        around = F.concat(cut(pieces, before, s["start"]), F.lit(" \n "), cut(pieces, s["end"], s["end"] + window))
        own, helped = F.lit(0.0), F.lit(False)
        for kind, (value, words) in CONTEXT.items():
            own = F.when(s["kind"] == kind, F.lit(value)).otherwise(own)
            helped = F.when(s["kind"] == kind, around.rlike(rf"(?i)(?<![a-z])(?:{words})(?![a-z])")).otherwise(helped)
        return F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"),
                        s["kind"].alias("kind"), s["value"].alias("value"),
                        (own + F.when(helped, near).otherwise(0.0)).alias("score"))

    # a text without spans isn't cut into blocks
    return let(F.when(F.size(spans) > 0, blocks(text)), lambda pieces: F.transform(spans, lambda s: rate(s, pieces)))


def with_spans(docs: DataFrame, base: str, all_spans: str, window: int = 40, near: float = 0.3,
               threshold: float = 0.5) -> DataFrame:
    """``docs`` with two columns: the base spans, and all spans with scores."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = F.concat(find(text, IBAN, "iban", 4, _iban, ahead=True), find(text, SSN, "ssn", 5, lambda m: F.lit(True)))
    added = free_name(docs, "more")
    return (docs.withColumn(base, base_spans(text)).withColumn(added, more)
            .withColumn(all_spans, F.concat(
                scored(text, F.col(base), window, near),
                F.filter(scored(text, F.col(added), window, near), lambda s: s["score"] >= threshold)))
            .drop(added))


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``base`` and ``found`` (arrays of spans, the second scored)."""
    return with_spans(docs.select("doc_id", "text"), "base", "found", **options).select("doc_id", "base", "found")


def summary(found: DataFrame) -> DataFrame:
    """Counts, digest and text form of ``find_pii``'s result."""
    return found.select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        F.array_join(F.transform(F.array_sort("found"), lambda s: F.format_string("%.1f", s["score"])), ",")
        .alias("scores"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle
    brackets (``<email>``); of overlapping spans the first names the whole
    stretch. ``n_chars``, where present, follows the new text."""
    base, found, fresh_text = (free_name(docs, stem) for stem in ("base", "found", "clean"))
    marked = with_spans(docs, base, found, **options)
    text = F.col("text")

    def cleaned(spans: Column) -> Column:
        stops = running(F.transform(spans, lambda s: s["end"]), later)
        return let(blocks(text), lambda pieces: let(stops, lambda stops: put(spans, stops, pieces)))

    def put(spans: Column, stops: Column, pieces: Column) -> Column:
        """Spans that start behind all before them, each with the text in front of it."""
        after = F.transform(spans, lambda s, i: F.struct(
            F.coalesce(F.get(stops, i - 1), F.lit(0)).alias("pos"), s["start"].alias("start"), s["kind"].alias("kind")))
        parts = F.transform(F.filter(after, lambda x: x["start"] >= x["pos"]), lambda x: F.concat(
            cut(pieces, x["pos"], x["start"]), F.lit("<"), x["kind"], F.lit(">")))
        end = F.get(stops, F.size(stops) - 1)
        return F.concat(F.array_join(parts, ""), cut(pieces, end, F.length(text)))

    clean = let(F.array_sort(found), cleaned)
    changed = F.size(found) > 0
    out = marked.withColumn(fresh_text, F.when(changed, clean).otherwise(text))
    columns = {"text": F.col(fresh_text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.length(fresh_text).cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])
