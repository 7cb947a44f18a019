"""Personal data in DataFrame operations only: patterns, checksums, context.

Regular expressions propose spans. Ranges of the parts (IP), Luhn (cards),
mod-97 (IBAN) and digit counts confirm them, with higher-order functions. Words
near a span raise or lower its score; they never remove a span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import Rule, find, label


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits, every second from the last but one doubled, sum to a multiple of ten."""
    each = F.split(F.reverse(digits(value)), "")
    number = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(number, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    moved = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))
    number = F.transform(F.split(moved, ""), lambda c: F.ascii(c))

    def step(rest: Column, code: Column) -> Column:
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(number, F.lit(0), step) == 1


def _count(low: int, high: int, value: Column) -> Column:
    n = F.char_length(digits(value))
    return (n >= low) & (n <= high)


def _card(hit: Column, part: Column) -> Column:
    return F.when(_count(13, 19, hit), luhn(hit)).otherwise(F.lit(False))


#: A part of an IP address: at most 255, zeros before it included.
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

BASE = [
    Rule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    Rule("ip", r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0, lambda hit, part: hit.rlike(rf"^{_PART}(\.{_PART}){{3}}$")),
    Rule("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+", 0, _card),  # a shorter run hides no longer one
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, lambda hit, part: _count(9, 15, hit)),
]
MORE = [Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", 0, lambda hit, part: mod97(hit))]



def _printed(hit: Column, part: Column) -> Column:
    """How many groups of a printed IBAN, its first and those after it, pass mod-97: each such count, the largest first."""
    groups = F.split(F.concat(hit, part), r"[\x20-]")
    return F.filter(F.sequence(F.size(groups), F.lit(4), F.lit(-1)), lambda k: mod97(F.array_join(F.slice(groups, F.lit(1), k), "")))


#: IBANs in groups of four; the groups after the first are looked ahead at, so that none hides the next IBAN.
PRINTED = Rule("printed", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:[\x20-][A-Z0-9]{4}){2,7}(?:[\x20-][A-Z0-9]{1,3})?)(?![A-Za-z0-9]))", 1, lambda hit, part: F.when(F.size(F.split(part, r"[\x20-]")) > 3, F.size(_printed(hit, part)) > 0).otherwise(F.lit(False)))

#: What a text must contain for a rule to match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}


@dataclass(frozen=True)
class Context:
    """prior: the score of a confirmed span. near, against: words within 40
    characters of it that raise the score by ``gain`` or lower it by ``loss``."""

    prior: float
    near: str
    against: str = r"version|invoice|order|isbn|serial"
    gain: float = 0.2
    loss: float = 0.3


CONTEXT = {
    "email": Context(0.75, r"mail|contact|correo|courriel|write to"),
    "ip": Context(0.5, r"\bip\b|host|server|address|adresse|login"),
    "card": Context(0.7, r"card|visa|credit|karte|tarjeta|carte"),
    "phone": Context(0.5, r"tel|phone|call|mobile|fax|llam"),
    "iban": Context(0.75, r"iban|bank|account|konto|cuenta|compte"),
}


def score(kind: str, span: Column) -> Column:
    c = CONTEXT[kind]
    near = F.lower(F.concat_ws(" ", span["before"], span["after"]))
    total = F.lit(c.prior) + F.when(near.rlike(c.near), c.gain).otherwise(0.0) - F.when(near.rlike(c.against), c.loss).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) with the spans ``s_<kind>`` of every rule in each whole text.

    A null text is empty and has none. Rows that repeat get a row each, an
    empty table gives an empty one. Columns that bear the names of the new ones
    give way.
    """
    rules = BASE + MORE if rules is None else rules
    new = {f"s_{r.kind}" for r in rules}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = find(own, "text", rules, lambda r: F.contains("text", F.lit(NEEDS[r.kind])) if r.kind in NEEDS else None)
    return found.select(*(F.col(f"row.`{c}`") for c in keep), *(f"s_{r.kind}" for r in rules))


def digest(found: DataFrame, base: list[Rule] = BASE, more: list[Rule] = MORE) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, all spans, and all with scores, by kind and then start."""

    def listed(rules: list[Rule], scored: bool = False) -> Column:
        def texts(kind: str) -> Column:
            return F.transform(f"s_{kind}", lambda x: F.concat_ws(":", label(kind, x), score(kind, x).cast("string")) if scored else label(kind, x))

        return F.array_join(F.concat(*(texts(r.kind) for r in rules)), ",")

    counts = [F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(base + more).alias("spans"), listed(base + more, True).alias("scored_spans"))


def redact(docs: DataFrame, *, text: str = "text", least: float = 0.0) -> DataFrame:
    """All rows and columns, the spans that score at least ``least`` in ``text`` (all, unless given) replaced by ``<kind>``.

    Where spans overlap, the one that starts first (the longer, if both do)
    is replaced and the other one, too, if it reaches further: its rest goes
    with it. A null text stays null.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.col(text).cast("string").alias("__value"))
    found = scan(rows, text="__value", rules=[*BASE, *MORE, PRINTED])

    def cuts(kind: str) -> Column:
        high = F.filter(f"s_{kind}", lambda x: score(kind, x) >= least)
        return F.transform(high, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), F.lit(f"<{kind}>").alias("by")))

    def last(x: Column) -> Column:
        groups = F.slice(F.split(F.concat(x["hit"], x["part"]), r"[\x20-]"), F.lit(1), F.element_at(_printed(x["hit"], x["part"]), 1))
        return x["start"] + F.char_length(F.array_join(groups, " "))

    printed = F.transform(F.filter("s_printed", lambda x: score("iban", x) >= least), lambda x: F.struct(x["start"].alias("start"), (-last(x)).alias("end"), F.lit("<iban>").alias("by")))
    found = found.select("__row", "__value", F.array_sort(F.concat(*(cuts(r.kind) for r in BASE + MORE), printed)).alias("__cuts"))
    value = F.col("__value")

    def step(acc: Column, x: Column) -> Column:
        end = -x["end"]
        piece = F.concat(acc["out"], F.substring(value, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), x["by"])
        inside = x["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(inside, acc["out"]).otherwise(piece).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("__cuts", start, step, lambda acc: F.concat(acc["out"], F.substring(value, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    masked = F.when(F.size("__cuts") > 0, clean).otherwise(value)
    return found.select(*((masked if c == text else F.col(f"__row.`{c}`")).alias(c) for c in columns))
