"""SQL that the native span queries and the substring query equal, over whole tables."""

from __future__ import annotations

from tidemark.llm import pii, secrets

#: Patterns without look-around, where the registered ones use it only to scan faster.
_PLAIN = {
    "hex": "[0-9a-f]{24,}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}",
    "iban": "[A-Za-z0-9]+",
}
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(c AS INTEGER) + 1] END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0, list_transform(string_split(hit[5:] || hit[1:4], ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (CASE WHEN c >= 65 THEN a * 100 + c - 55 ELSE a * 10 + c - 48 END) % 97) = 1"
_HOLDS = {
    "assign": "length(part) >= 6",
    "ip": f"regexp_full_match(hit, '{pii._PART}(\\.{pii._PART}){{3}}')",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE FALSE END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"CASE WHEN regexp_full_match(hit, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') THEN {_MOD97} ELSE FALSE END",
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _spans(rules: list) -> str:
    found = []
    for order, rule in enumerate(rules):
        p = _text(_PLAIN.get(rule.kind, rule.pattern))
        found.append(
            f"SELECT doc_id, {_text(rule.kind)} AS kind, {order} AS ord, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS h, regexp_extract_all(t, {p}, {rule.part}) AS p FROM d WHERE regexp_matches(t, {p})"
        )
    holds = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _HOLDS.items())
    return f"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(found)}), s AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m),
 x AS (SELECT doc_id, kind, ord, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, h[i] AS hit, p[i] AS part,
 right(g[i], 40) || ' ' || left(g[i + 1], 40) AS near FROM s), y AS (SELECT *, kind || ':' || a || ':' || (a + length(hit)) AS label FROM x WHERE CASE kind {holds} ELSE TRUE END)"""


def _digest(base: list, more: list, order: str, extra: str = "") -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    return f"""WITH {_spans(base + more)} SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(label, ',' ORDER BY {order}) FILTER (ord < {len(base)}), '')) AS base_sha256,
 coalesce(string_agg(label, ',' ORDER BY {order}), '') AS spans{extra} FROM d LEFT JOIN y USING (doc_id) GROUP BY d.doc_id"""


_SCORE = "CASE kind " + " ".join(
    f"WHEN '{k}' THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c.prior}::DOUBLE + CASE WHEN regexp_matches(lower(near), {_text(c.near)}) THEN {c.gain}::DOUBLE ELSE 0.0 END - CASE WHEN regexp_matches(lower(near), {_text(c.against)}) THEN {c.loss}::DOUBLE ELSE 0.0 END)), 3)"
    for k, c in pii.CONTEXT.items()
) + " END"

SECRETS = _digest(secrets.BASE, secrets.MORE, "a, ord")
PERSONAL = _digest(pii.BASE, pii.MORE, "ord, a", f", coalesce(string_agg(label || ':' || ({_SCORE}), ',' ORDER BY ord, a), '') AS scored_spans")

REPEATS = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
 dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
 cov AS (SELECT DISTINCT doc_id, i + j AS pos FROM dup, (SELECT unnest(range(0, 20)) AS j)), gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
 ws AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d), kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t FROM ws ANTI JOIN cov USING (doc_id, pos) GROUP BY doc_id)
 SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""
