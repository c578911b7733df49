"""Oracle SQL for spans of personal data: positions, overlap removal, masks and replacement."""

from __future__ import annotations

from rampart.functions.regexes import sql_regex, sql_str
from rampart.operators import pii as P
from rampart.operators.privacy import RISK_WEIGHTS


def luhn_sql(x: str) -> str:
    digit = f"CAST(substring({x}, length({x}) - i + 1, 1) AS INT)"
    return (f"list_sum(list_transform(generate_series(1, length({x})), lambda i: CASE WHEN i % 2 = 1 THEN {digit} "
            f"WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0")


def span_ctes(table: str, key: str) -> str:
    """CTEs `found` (all matches, with rn by position) and `kept` (what overlap removal leaves) of a table with
    `text`; `key` lists the columns that name a row."""
    rows = []
    for i, p in enumerate(P.PATTERNS):
        rx = sql_str(sql_regex(p.pattern, ignore_case=True))
        rows.append(f"""SELECT {key}, {i} AS ord, '{p.kind}' AS type, {p.confidence}::DOUBLE AS confidence, unnest(list_zip(gaps, hits)) AS z, generate_subscripts(hits, 1) AS k
          FROM (SELECT *, string_split_regex(text, {rx})[1:len(hits)] AS gaps FROM (SELECT {key}, text, regexp_extract_all(text, {rx}) AS hits FROM {table}) WHERE len(hits) > 0)""")
    on = " AND ".join(f"o.{k.strip()} = g.{k.strip()}" for k in key.split(","))
    own = ", ".join(f"o.{k.strip()}" for k in key.split(","))
    return f""", matched AS ({' UNION ALL '.join(rows)}), pieced AS (SELECT {key}, ord, type, confidence, z[1] AS gap, z[2] AS hit, k FROM matched),
   placed AS (SELECT {key}, ord, type, confidence, hit, (sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY {key}, ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start,
      replace(replace(hit, '-', ''), ' ', '') AS digits FROM pieced WINDOW w AS (PARTITION BY {key}, ord ORDER BY k ROWS UNBOUNDED PRECEDING)),
   found AS (SELECT *, (start + length(hit))::INT AS stop, row_number() OVER (PARTITION BY {key} ORDER BY start, confidence DESC, ord, length(hit)) AS rn FROM placed
      WHERE CASE WHEN type <> 'credit_card' THEN true WHEN NOT regexp_full_match(digits, '[0-9]{{13,19}}') THEN false ELSE {luhn_sql('digits')} END),
   kept AS (WITH RECURSIVE g AS (SELECT {key}, rn, type, confidence, start, stop, hit, stop AS last, true AS keep FROM found WHERE rn = 1
      UNION ALL SELECT {own}, o.rn, o.type, o.confidence, o.start, o.stop, o.hit, CASE WHEN o.start < g.last THEN g.last ELSE o.stop END, o.start >= g.last FROM g JOIN found o ON {on} AND o.rn = g.rn + 1)
      SELECT * FROM g WHERE keep)"""


def replaced_ctes(table: str, key: str, replacement: str) -> str:
    """CTE `replaced` (key, changed, n) for every row of the table; `replacement` is SQL over type and hit."""
    return f""", gaps AS (SELECT {key}, start, stop, {replacement} AS repl, lag(stop, 1, 0) OVER (PARTITION BY {key} ORDER BY start, rn) AS prev, rn FROM kept),
   joined AS (SELECT {key}, string_agg(substring(t.text, prev + 1, start - prev) || repl, '' ORDER BY start, rn) AS body, max(stop) AS tail, count(*) AS n FROM gaps JOIN {table} t USING ({key}) GROUP BY {key}),
   replaced AS (SELECT {key}, CASE WHEN body IS NULL THEN text ELSE body || substring(text, tail + 1) END AS changed, coalesce(n, 0)::INT AS n FROM {table} LEFT JOIN joined USING ({key}))"""


#: The mask of a hit.
SHOWN = """CASE WHEN length(hit) <= 4 THEN '****'
   WHEN type = 'email' AND length(hit) - length(replace(hit, '@', '')) = 1 THEN CASE WHEN length(split_part(hit, '@', 1)) > 2 THEN left(hit, 2) ELSE '' END || '***@' || split_part(hit, '@', 2)
   WHEN type = 'credit_card' AND length(replace(replace(hit, '-', ''), ' ', '')) >= 4 THEN '****-****-****-' || right(replace(replace(hit, '-', ''), ' ', ''), 4)
   WHEN type = 'ssn' THEN '***-**-****'
   WHEN type = 'phone' AND length(regexp_replace(hit, '[^0-9]', '', 'g')) >= 10 THEN left(regexp_replace(hit, '[^0-9]', '', 'g'), 3) || '-***-****'
   WHEN length(hit) > 6 THEN left(hit, 2) || repeat('*', length(hit) - 4) || right(hit, 2) ELSE repeat('*', length(hit)) END"""
HASHED = "'[' || upper(type) || '_' || left(sha256(hit), 8) || ']'"

_GENERIC = "'[' || upper(type) || ']'"
_H = "sha256(hit)"


def _digits(at: int, n: int) -> str:
    return f"translate(substring({_H}, {at}, {n}), 'abcdef', '012345')"


def _octet(at: int) -> str:
    return f"('0x' || substring({_H}, {at}, 2))::INT::VARCHAR"


#: Strategy -> what stands in for a hit.
MASKS = {
    "redact": _GENERIC,
    "hash": f"'[HASH:' || left({_H}, 16) || ']'",
    "tokenize": f"'[TOKEN_' || left({_H}, 24) || ']'",
    "remove": "''",
    "partial": f"""CASE type WHEN 'email' THEN left(hit, 2) || '***@***.***' WHEN 'phone' THEN '***-***-' || right(hit, 4) WHEN 'ssn' THEN '***-**-' || right(hit, 4)
       WHEN 'credit_card' THEN '****-****-****-' || right(hit, 4) WHEN 'ip_address' THEN array_to_string(string_split(hit, '.')[1:2], '.') || '.*.* '
       WHEN 'api_key' THEN left(hit, 8) || '...' || right(hit, 4) WHEN 'password' THEN repeat('*', least(length(hit), 8)) ELSE {_GENERIC} END""",
    "anonymize": f"""CASE type WHEN 'email' THEN 'user' || substring({_H}, 1, 8) || '@example.com' WHEN 'phone' THEN '555-' || substring({_H}, 4, 3) || '-' || substring({_H}, 7, 4)
       WHEN 'ssn' THEN substring({_H}, 1, 3) || '-' || substring({_H}, 4, 2) || '-' || substring({_H}, 6, 4)
       WHEN 'credit_card' THEN {_digits(1, 4)} || '-' || {_digits(5, 4)} || '-' || {_digits(9, 4)} || '-' || {_digits(13, 4)}
       WHEN 'ip_address' THEN {_octet(1)} || '.' || {_octet(3)} || '.' || {_octet(5)} || '.' || {_octet(7)}
       WHEN 'api_key' THEN 'sk-' || left({_H}, 32) WHEN 'password' THEN '[REMOVED]' ELSE {_GENERIC} END""",
}
RISK = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RISK_WEIGHTS.items()) + " ELSE 0.3 END"
