"""The scalar functions under SQL names, for one session: plain SQL functions, which the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veilframe.functions import patterns as P

_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_AT = "element_at(split({d}, ''), {i})::INT"


def _sum(of) -> str:
    return " + ".join(_AT.format(d=_DIGITS, i=i + 1) for i in of)


FUNCTIONS = {
    "vf_digit_count": ("v STRING", "INT", f"length({_DIGITS})"),
    "vf_luhn_valid": ("v STRING", "BOOLEAN", f"length({_DIGITS}) BETWEEN 13 AND 19 AND aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN int(c) WHEN int(c) > 4 THEN int(c) * 2 - 9 ELSE int(c) * 2 END), 0, (a, x) -> a + x) % 10 = 0"),
    "vf_tckn_valid": ("v STRING", "BOOLEAN", f"CASE WHEN length({_DIGITS}) = 11 THEN {_AT.format(d=_DIGITS, i=1)} <> 0 AND {_AT.format(d=_DIGITS, i=10)} = pmod(({_sum((0, 2, 4, 6, 8))}) * 7 - ({_sum((1, 3, 5, 7))}), 10) AND {_AT.format(d=_DIGITS, i=11)} = ({_sum(range(10))}) % 10 ELSE false END"),
    "vf_is_placeholder": ("v STRING", "BOOLEAN", rf"v RLIKE r'(?U)\A{P.PLACEHOLDER}\z'"),
    "vf_digit_isolated": ("t STRING, s INT, e INT", "BOOLEAN", "NOT (CASE WHEN s > 0 THEN substring(t, s, 1) ELSE '' END) RLIKE '[0-9]' AND NOT substring(t, e + 1, 1) RLIKE '[0-9]'"),
    "vf_placeholders": ("t STRING", "ARRAY<STRING>", rf"regexp_extract_all(t, r'(?U)\b{P.PLACEHOLDER}\b', 0)"),
    "vf_restore": ("t STRING, m MAP<STRING, STRING>", "STRING", rf"array_join(zip_with(split(t, r'(?U)\b{P.PLACEHOLDER}\b', -1), regexp_extract_all(t, r'(?U)\b{P.PLACEHOLDER}\b', 0), (g, p) -> concat(g, coalesce(m[p], p, ''))), '')"),
    "vf_edit_once": ("t STRING, o STRING, n STRING", "STRING", "CASE WHEN o <> '' AND length(t) - length(replace(t, o, '')) = length(o) THEN replace(t, o, n) ELSE t END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; their names."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
