"""Secret scans with a trigram index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams that every
match must contain: all of some clauses, each any of some alternatives, each
all of some trigrams. The index holds, for the trigrams that any rule asks for,
whether a text is on the trigram's posting list, as bits beside the text:
``index`` gives it as a table to keep. Intersecting posting lists is comparing
masks of those bits, so nothing is shuffled, gathered or sent around, and what
is left of a rule's texts has its expression run on it. Rules without such
trigrams scan all.

Of an alternative with many trigrams the ``_EACH`` rarest are asked for, by how
common their letters are: more would only cost.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import Rule, find, label

BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, lambda hit, part: F.char_length(part) >= 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # a shorter match hides no longer one
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
]
MORE = [
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]

#: More literal strings than this at one place are not followed; a class of more characters is any character.
_MOST, _CLASS = 32, 8
#: Trigrams asked for of one alternative, and letters from common to rare.
_EACH, _COMMON = 2, "etaoinshrdlcumwfgypbvkjxqz"
_BITS = 62
Query = list[list[frozenset[str]]]  # all of: any of: all of these trigrams
Node = tuple  # ("chars", characters or None), ("group", alternatives), ("repeat", node, least, most)


def _class(body: str) -> frozenset[str] | None:
    """The characters of a class, lower-case, or None if they are many."""
    if body.startswith("^"):
        return None
    out, i = set(), 0
    while i < len(body):
        c, i = _char(body, i)
        if c is None:
            return None
        last = c
        if body[i : i + 1] == "-" and i + 1 < len(body):
            last, i = _char(body, i + 1)
        if last is None or ord(last) - ord(c) >= _CLASS:
            return None
        out |= {chr(k).lower() for k in range(ord(c), ord(last) + 1)}
    return frozenset(out) if len(out) <= _CLASS else None


def _char(pattern: str, i: int) -> tuple[str | None, int]:
    """A character, escaped or not, and where what follows it begins; None for a kind of characters."""
    if pattern[i] != "\\":
        return pattern[i], i + 1
    if pattern[i + 1] == "x":
        return chr(int(pattern[i + 2 : i + 4], 16)), i + 4
    return (None if pattern[i + 1].isalnum() else pattern[i + 1]), i + 2


def _times(pattern: str, i: int) -> tuple[tuple[int, int | None] | None, int]:
    """How often what is before stands, if that is said, and where what follows begins."""
    most: int | None
    if pattern[i : i + 1] == "{":
        end = pattern.index("}", i)
        low, _, high = pattern[i + 1 : end].partition(",")
        least, most, i = int(low), int(high) if high else None if "," in pattern[i:end] else int(low), end + 1
    elif pattern[i : i + 1] in ("?", "*", "+") and i < len(pattern):
        least, most, i = int(pattern[i] == "+"), 1 if pattern[i] == "?" else None, i + 1
    else:
        return None, i
    return (least, most), i + (pattern[i : i + 1] in ("?", "+") and i < len(pattern))


def _parse(pattern: str, i: int = 0) -> tuple[list[list[Node]], int]:
    """Alternatives from i up to a closing bracket or the end. What stands without width is nothing."""
    out: list[list[Node]] = [[]]
    while i < len(pattern) and pattern[i] != ")":
        c = pattern[i]
        node: Node | None
        if c == "|":
            out.append([])
            i += 1
            continue
        if c == "(":
            bare = pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i)
            if pattern.startswith("(?", i):
                i = pattern.index(":", i) if not bare else i + 2 + (pattern[i + 2] == "<")
            inner, i = _parse(pattern, i + 1)
            node, i = (None if bare else ("group", inner)), i + 1
        elif c == "[":
            end = i + 2
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            node, i = ("chars", _class(pattern[i + 1 : end])), end + 1
        elif c in "^$" or pattern.startswith(("\\b", "\\B"), i):
            node, i = None, i + 1 + (c == "\\")
        elif c == ".":
            node, i = ("chars", None), i + 1
        else:
            one, i = _char(pattern, i)
            node = ("chars", None if one is None else frozenset(one.lower()))
        times, i = _times(pattern, i)
        if node:
            out[-1].append(("repeat", node, *times) if times else node)
    return out, i


def _literals(node: Node) -> list[str] | None:
    """All strings that a node matches, lower-case, or None if they are many."""
    if node[0] == "chars":
        return None if node[1] is None else sorted(node[1])
    if node[0] == "group":
        each = [_strings(x) for x in node[1]]
        return None if None in each else sorted({s for x in each for s in x})
    if node[3] != 1:
        return None
    inner = _literals(node[1])
    return None if inner is None else sorted({*inner, ""} if node[2] == 0 else inner)


def _strings(nodes: list[Node]) -> list[str] | None:
    out = [""]
    for node in nodes:
        more = _literals(node)
        if more is None or len(out) * len(more) > _MOST:
            return None
        out = [a + b for a, b in product(out, more)]
    return out


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> Query:
    """What the trigrams of a lower-cased text must fulfil for a match; empty: nothing is known."""
    clauses: Query = []

    def close(run: list[str]) -> None:
        each = {_grams(s) for s in run}
        if frozenset() not in each:
            clauses.append(sorted((x for x in each if not any(y < x for y in each)), key=sorted))

    def walk(nodes: list[Node]) -> None:
        run = [""]
        for node in nodes:
            more = _literals(node)
            if more is not None and len(run) * len(more) <= _MOST:
                run = [a + b for a, b in product(run, more)]
                continue
            close(run)
            run = more if more is not None else [""]
            if more is None:
                inner = node[1] if node[0] == "repeat" and node[2] > 0 else node
                if inner[0] == "group" and len(inner[1]) == 1:
                    walk(inner[1][0])
                elif inner is not node and (once := _literals(inner)) is not None:
                    close(once)
        close(run)

    parsed, _ = _parse(pattern)
    if len(parsed) > 1:
        parsed = [[("group", parsed)]]
    walk(parsed[0])
    return clauses


def _asked(alternative: frozenset[str]) -> list[str]:
    """The trigrams of an alternative that are looked at."""
    return sorted(alternative, key=lambda g: (-sum(_COMMON.find(c) if c in _COMMON else len(_COMMON) for c in g), g))[:_EACH]


class Trigrams:
    """The queries of some rules and the bit of each trigram that they ask for."""

    def __init__(self, rules: list[Rule]) -> None:
        self.queries = {r.kind: [[_asked(x) for x in clause] for clause in q] for r in rules if (q := trigram_query(r.pattern))}
        self.grams = sorted({g for q in self.queries.values() for clause in q for x in clause for g in x})
        self.place = {g: divmod(k, _BITS) for k, g in enumerate(self.grams)}
        self.columns = [f"w{k}" for k in range(-(-len(self.grams) // _BITS))]

    def bits(self, low: str) -> list[Column]:
        """On which posting lists a lower-cased text is: a bit for each trigram."""
        out = []
        for w, name in enumerate(self.columns):
            here = [F.when(F.contains(low, F.lit(g)), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for g, (at, k) in self.place.items() if at == w]
            out.append(reduce(lambda a, b: a.bitwiseOR(b), here).alias(name))
        return out

    def holds(self, kind: str) -> Column | None:
        """Whether the bits fulfil the rule's query; None where it has none."""

        def every(grams: list[str]) -> Column:
            masks = {w: sum(1 << self.place[g][1] for g in grams if self.place[g][0] == w) for w in range(len(self.columns))}
            return reduce(Column.__and__, (F.col(f"w{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items() if m))

        if kind not in self.queries:
            return None
        return reduce(Column.__and__, (reduce(Column.__or__, map(every, clause)) for clause in self.queries[kind]))


def _indexed(docs: DataFrame, text: str, grams: Trigrams) -> DataFrame:
    """``docs`` with the bits of each text; a projection of its own lowers the text once."""
    keep = docs.columns
    return docs.withColumn("low", F.lower(text)).select(*keep, *grams.bits("low"))


def index(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, trigram): the posting lists of all trigrams that the rules ask for, a row for each entry. A null text is on none."""
    grams = Trigrams(BASE + MORE if rules is None else rules)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    on = [F.when((F.col(f"w{w}").bitwiseAND(F.lit(1 << k))) != 0, F.lit(g)) for g, (w, k) in grams.place.items()]
    listed = F.filter(F.array(*on), lambda x: x.isNotNull()) if on else F.array().cast("array<string>")
    return _indexed(own, "text", grams).select("doc_id", F.explode(listed).alias("trigram"))


def scan(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, s_<kind> for each rule): the spans of every rule in each whole text.

    A null text is empty and has none; empty tables give empty ones; rows that
    repeat get a row each; a null id stays null. Other columns are not read.
    """
    rules = BASE + MORE if rules is None else rules
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    grams = Trigrams(rules)
    return find(_indexed(own, "text", grams), "text", rules, lambda rule: grams.holds(rule.kind)).select("doc_id", *(f"s_{r.kind}" for r in rules))


def digest(found: DataFrame, base: list[Rule] = BASE, more: list[Rule] = MORE) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text, by start and then kind."""

    def ordered(order: int, kind: str) -> Column:
        return F.transform(f"s_{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), label(kind, x).alias("label")))

    def listed(rules: list[Rule]) -> Column:
        each = F.concat(*(ordered(k, r.kind) for k, r in enumerate(rules)))
        return F.array_join(F.transform(F.array_sort(each), lambda x: x["label"]), ",")

    counts = [F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base]
    return found.select("doc_id", *counts, listed(base).alias("base"), listed(base + more).alias("spans")).select("doc_id", *(f"n_{r.kind}" for r in base), F.sha2("base", 256).alias("base_sha256"), "spans")
