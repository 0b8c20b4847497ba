"""DuckDB SQL for the queries, from few building blocks."""

from __future__ import annotations

from lexloom.plans.corpus import CONTRACTS_SQL


def contracts(tail: str) -> str:
    """SQL over ``docs``, the contracts."""
    return f"WITH docs AS ({CONTRACTS_SQL}), {tail}"


def matches(name: str, pattern: str, source: str = "docs", extra: str = "") -> str:
    """A CTE of all matches with code-point offsets; ``text`` stays for contexts."""
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT doc_id, text, m[i] AS surface, i - 1 AS nth,
    (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS s{extra}
  FROM (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS g FROM {source})))"""


LINES = r"""lines AS (
  SELECT doc_id, trim(line, E' \t\r') AS line, (s + length(line) - length(ltrim(line, E' \t\r')))::INT AS s FROM (
    SELECT doc_id, l[i] AS line, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) AS s
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)))
  WHERE trim(line, E' \t\r') <> '')"""
