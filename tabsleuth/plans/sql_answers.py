"""DuckDB twins of the answer functions (oracle side only).

DuckDB's RE2 has no lookbehind; the tail patterns are rewritten as
'shortest non-empty prefix + removable tail', which agrees with the Spark
side on every text that does not start with a bracket or symbol.
"""

from __future__ import annotations

from ..functions.answers import FLOAT_TEXT, INT_TEXT
from ..functions.render import SQL_RENDER_DOUBLE


def sql_number(x: str) -> str:
    body = f"(CASE WHEN starts_with({x}, '$') THEN regexp_replace(substr({x}, 2), '^\\s+|\\s+$', '', 'g') ELSE {x} END)"
    return (f"(CASE WHEN regexp_matches({body}, '{INT_TEXT}') OR regexp_matches({body}, '{FLOAT_TEXT}') "
            f"THEN TRY_CAST(regexp_replace(replace({body}, '_', ''), '^\\s+|\\s+$', '', 'g') AS DOUBLE) END)")


def sql_number_print(a: str) -> str:
    return (f"(CASE WHEN abs({a} - round({a})) < 1e-6 THEN CAST(CAST(trunc({a}) AS BIGINT) AS VARCHAR) "
            f"ELSE {SQL_RENDER_DOUBLE.format(x=a)} END)")


def _sql_part(p: str, ph: str) -> str:
    return (f"(CASE WHEN {p} IN ({ph}) THEN -1 WHEN regexp_matches({p}, '{INT_TEXT}') "
            f"THEN TRY_CAST(regexp_replace(replace({p}, '_', ''), '^\\s+|\\s+$', '', 'g') AS INTEGER) END)")


def sql_date_parts(x: str) -> tuple[str, str, str, str]:
    parts = f"string_split(lower({x}), '-')"
    y = _sql_part(f"{parts}[1]", "'xx', 'xxxx'")
    m = _sql_part(f"{parts}[2]", "'xx'")
    d = _sql_part(f"{parts}[3]", "'xx'")
    ok = (f"(len({parts}) = 3 AND {y} IS NOT NULL AND {m} IS NOT NULL AND {d} IS NOT NULL "
          f"AND NOT ({y} = -1 AND {m} = -1 AND {d} = -1) AND ({m} = -1 OR {m} BETWEEN 1 AND 12) "
          f"AND ({d} = -1 OR {d} BETWEEN 1 AND 31))")
    return ok, y, m, d


def sql_normalize(x: str, passes: int = 8) -> str:
    e = f"translate({x}, '‘’´`“”‐‑‒–—−', '''''''\"\"------')"
    for _ in range(passes):
        e = f"regexp_replace(regexp_replace({e}, '^\\s+|\\s+$', '', 'g'), '(?s)^(.+?)((\\[[^\\]]*\\]|\\[\\d+\\]|[•♦†‡*#+])*)$', '\\1')"
        e = f"regexp_replace(regexp_replace({e}, '^\\s+|\\s+$', '', 'g'), '(?s)^(.+?)(( \\([^)]*\\))*)$', '\\1')"
        e = f"regexp_replace(regexp_replace({e}, '^\\s+|\\s+$', '', 'g'), '^\"([^\"]*)\"$', '\\1')"
    e = f"regexp_replace({e}, '\\.$', '')"
    return f"regexp_replace(lower(regexp_replace({e}, '\\s+', ' ', 'g')), '^\\s+|\\s+$', '', 'g')"


def sql_value_printed(x: str) -> str:
    n = sql_number(x)
    ok, y, m, d = sql_date_parts(x)
    return (f"(CASE WHEN {n} IS NOT NULL THEN {sql_number_print(n)} "
            f"WHEN {ok} AND {m} = -1 AND {d} = -1 THEN CAST({y} AS VARCHAR) "
            f"WHEN {ok} THEN CAST({y} AS VARCHAR) || ',' || CAST({m} AS VARCHAR) || ',' || CAST({d} AS VARCHAR) "
            f"ELSE {sql_normalize(x)} END)")


def sql_normalize_answer(a: str) -> str:
    s = f"coalesce(CAST({a} AS VARCHAR), 'None')"
    br = f"(starts_with({s}, '[') AND ends_with({s}, ']'))"
    parsed = f"TRY_CAST(TRY_CAST(replace({s}, '''', '\"') AS JSON) AS VARCHAR[])"
    text = f"(CASE WHEN {br} THEN regexp_replace(regexp_replace({s}, '^\\[', ''), '\\]$', '') ELSE {s} END)"
    split = f"list_transform(string_split(replace(lower({text}), ' and ', ', '), ', '), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g'))"
    items = (f"(CASE WHEN {br} AND {parsed} IS NOT NULL THEN list_transform({parsed}, lambda q: lower(q)) "
             f"ELSE {split} END)")
    return (f"array_to_string(list_sort(list_distinct(list_transform({items}, lambda x: {sql_value_printed('x')}))), "
            f"'|')")
