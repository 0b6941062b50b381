"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Everything is computed inside the row. Positions come from the pieces between the matches, so they are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, a character that every match holds, words that speak for it, score without such words.
# The first four are the base kinds; runs are possessive and start at the head of a run, which keeps the scan linear.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
     "mail|contact|write", 0.8),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "address|host|server|client|login", 0.6),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+", "", "card|visa|master|amex|payment|expir", 0.7),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|call|mobile|fax|tel", 0.6),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "",
     "iban|account|konto|bank|cuenta|compte", 0.6),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn|social security|tax id", 0.3),
]
BASE_KINDS = ("email", "ip", "card", "phone")
# Words that speak against a span, and what words for and against it are worth.
AGAINST, FOR_WORTH, AGAINST_WORTH = "example|sample|version|test|order|invoice", 0.2, -0.2
#: Code points before and after a span that are searched for such words, and the least score of a span of an added kind.
NEARBY, LEAST = 40, 0.5
_BLOCK = 64


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def _propose(texts: DataFrame) -> DataFrame:
    """texts with a column for each kind: an array of start, end, match of every leftmost match.

    Each step is columns of its own that the next one reads more than once, so that Spark does not repeat it for every element.
    A match starts after the pieces and matches before it; these are added up by blocks first, then within a block.
    """
    kinds, sign_of = [k for k, *_ in KINDS], {k: sign for k, _, sign, *_ in KINDS}
    pattern_of = {k: p for k, p, *_ in KINDS}

    def matches(k):
        found = F.regexp_extract_all("text", F.lit(pattern_of[k]), 0)
        return F.when(F.contains("text", F.lit(sign_of[k])), found) if sign_of[k] else found

    def each(df, name, value):
        return df.withColumns({f"{k}_{name}": value(k) for k in kinds})

    df = each(texts, "matches", matches)
    df = each(df, "pieces", lambda k: F.when(F.size(f"{k}_matches") > 0, F.split("text", pattern_of[k], -1)))
    df = each(df, "lengths", lambda k: F.transform(f"{k}_matches", lambda m, i: F.length(F.get(f"{k}_pieces", i)) + F.length(m)))
    df = each(df, "blocks", lambda k: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(f"{k}_lengths") / _BLOCK).cast("int")), lambda b: _total(F.slice(f"{k}_lengths", b * _BLOCK + 1, F.lit(_BLOCK)))
    ))
    df = each(df, "before", lambda k: F.transform(f"{k}_blocks", lambda _, b: _total(F.slice(f"{k}_blocks", F.lit(1), b))))

    def spans(k):
        def span(m, i):
            before = F.get(f"{k}_before", F.floor(i / _BLOCK).cast("int")) + _total(F.slice(f"{k}_lengths", i - i % _BLOCK + 1, i % _BLOCK))
            start = (before + F.length(F.get(f"{k}_pieces", i))).cast("long")
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"))

        return F.transform(f"{k}_matches", span)

    return df.select("id", "text", *[spans(k).alias(k) for k in kinds])


def luhn(digits: Column) -> Column:
    """True if the digits of a number, without separators, pass the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))
    digit = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(places, F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i))) % 10 == 0


def mod97(number: Column) -> Column:
    """True if an IBAN without blanks passes the mod-97 check."""
    turned = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    step = lambda a, c: F.when(c >= 65, a * 100 + c - 55).otherwise(a * 10 + c - 48) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda a, i: step(a, code(i))) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(match, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and spans, an array of start, kind_no, end, kind, text, score by start and kind.

    Spans of the base kinds always stay, those of added kinds from a score of LEAST. Null text counts as empty: no
    spans. Repeated rows give repeated rows, a null id stays null, an empty table gives an empty result, other columns
    are left out. Spans of different kinds may overlap; of one kind the leftmost counts.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    proposed = _propose(texts)

    def scored(number, kind, words, prior):
        def span(s):
            near = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - NEARBY).cast("int"), (F.least(s["start"], F.lit(NEARBY)) + s["end"] - s["start"] + NEARBY).cast("int")))
            score = F.lit(prior) + F.when(near.rlike(words), FOR_WORTH).otherwise(0.0) + F.when(near.rlike(AGAINST), AGAINST_WORTH).otherwise(0.0)
            return F.struct(s["start"].alias("start"), F.lit(number).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("text"), F.round(score, 3).alias("score"))

        spans = F.transform(F.filter(kind, lambda s: _valid(kind, s["match"])), span)
        spans = spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= LEAST)
        return F.coalesce(spans, F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string,text:string,score:double>>"))

    kinds = [scored(i, kind, words, prior) for i, (kind, _, _, words, prior) in enumerate(KINDS)]
    return proposed.select(F.col("id").alias(id_col), F.sort_array(F.concat(*kinds)).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    return found.select(id_col, *map(of, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
