"""SQL counterpart of the personal data query."""

from __future__ import annotations

from larder.llm.pii import AGAINST, AGAINST_WORTH, BASE_KINDS, FOR_WORTH, KINDS, LEAST, NEARBY

# The same languages without possessive runs and looks behind, which this dialect lacks.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_IBAN = "replace(m, ' ', '')"
_CHECKS = {
    "email": "true",
    "ip": r"regexp_full_match(m, '(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])')",
    "card": f"""length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT
             WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4 THEN substr(reverse({_DIGITS}), i, 1)::INT * 2 - 9
             ELSE substr(reverse({_DIGITS}), i, 1)::INT * 2 END)) % 10 = 0""",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"""length({_IBAN}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(
        string_split(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
        lambda a, d: CASE WHEN d >= 10 THEN (a * 100 + d) % 97 ELSE (a * 10 + d) % 97 END) = 1""",
    "ssn": "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
}


def oracle() -> str:
    """Positions are sums of the lengths of pieces and matches; added kinds are kept by their score."""
    found = []
    for number, (kind, _, _, words, prior) in enumerate(KINDS):
        near = f"lower(substr(text, greatest(1, s + 1 - {NEARBY})::BIGINT, (least(s, {NEARBY}) + e - s + {NEARBY})::BIGINT))"
        score = (f"round({prior} + CASE WHEN regexp_matches({near}, '{words}') THEN {FOR_WORTH} ELSE 0 END"
                 f" + CASE WHEN regexp_matches({near}, '{AGAINST}') THEN {AGAINST_WORTH} ELSE 0 END, 3) >= {LEAST}")  # fmt: skip
        found.append(f"""
  SELECT rid, '{kind}' AS kind, {number} AS kind_no, s, e FROM (
    SELECT rid, text, ms[i] AS m, e - length(ms[i]) AS s, e FROM (
      SELECT *, list_sum(list_transform(range(1, i + 1), lambda j: length(ps[j]) + length(ms[j])))::BIGINT AS e FROM (
        SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT rid, text, regexp_extract_all(text, '{PATTERNS[kind]}') AS ms, regexp_split_to_array(text, '{PATTERNS[kind]}') AS ps FROM t))))
  WHERE {_CHECKS[kind]} AND {"true" if kind in BASE_KINDS else score}""")
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in BASE_KINDS)
    base = f" FILTER (kind_no < {len(BASE_KINDS)})"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256({listed.format(base)}) AS base_sha256, {listed.format("")} AS spans
FROM t LEFT JOIN found USING (rid) GROUP BY rid"""
