"""DuckDB SQL twins of the registered queries (the correctness oracle).

The same span technique as ``functions.spans`` written in DuckDB SQL: all matches with
``regexp_extract_all``, gaps with ``string_split_regex``, start offsets from a running
sum over the match ordinal. DuckDB's RE2 has no look-around, so patterns that use it
are restated with the neighbouring character captured and checked in SQL.
"""

from __future__ import annotations

from veilspark.functions import fixed as X
from veilspark.sources.fixtures import planted_sql

PLANTED = f"({planted_sql('customer')})"


def q(s: str) -> str:
    return s.replace("'", "''")


def spans_sql(src: str, key: str, text: str, pattern: str, group: int = 0, extra: str = "") -> str:
    """Rows (k, i, start, end, value, mtext[, extra cols]) of all matches; start 0-based."""
    p = q(pattern)
    grp = f", regexp_extract_all({text}, '{p}', {group}) AS v" if group else ""
    vexpr = "v[i]" if group else "m[i]"
    return f"""(SELECT k, i, {extra} txt,
       CAST(ms + length(m[i]) - length({vexpr}) AS BIGINT) AS start,
       CAST(ms + length(m[i]) AS BIGINT) AS "end",
       {vexpr} AS value, m[i] AS mtext
  FROM (SELECT *, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)
                  - length(m[i]) AS ms
          FROM (SELECT *, unnest(generate_series(1, len(m))) AS i
                  FROM (SELECT {key} AS k, {text} AS txt, regexp_extract_all({text}, '{p}') AS m,
                               string_split_regex({text}, '{p}') AS g {grp} FROM {src}) a) b) c)"""


def luhn_sql(d: str) -> str:
    """Luhn on a digit string (13-19 digits, not all zero)."""
    body = (
        f"list_sum(list_transform(string_split(reverse({d}), ''), lambda x, i: "
        f"CASE WHEN i % 2 = 0 THEN (CASE WHEN CAST(x AS INT) * 2 > 9 THEN CAST(x AS INT) * 2 - 9 "
        f"ELSE CAST(x AS INT) * 2 END) ELSE CAST(x AS INT) END)) % 10 = 0"
    )
    return f"(length({d}) BETWEEN 13 AND 19 AND regexp_matches({d}, '[1-9]') AND {body})"


def verhoeff_sql(d: str) -> str:
    dt = str(X.VERHOEFF_D)
    pt = str(X.VERHOEFF_P)
    return (
        f"(length({d}) > 0 AND list_reduce(list_transform(string_split(reverse({d}), ''), lambda x, i: "
        f"{{'i': i - 1, 'x': CAST(x AS INT)}}), lambda c, e: {{'i': 0, 'x': ({dt})[c.x + 1][({pt})[(e.i % 8) + 1][e.x + 1] + 1]}}, "
        f"{{'i': 0, 'x': 0}}).x = 0)"
    )


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"
