"""SQL for DuckDB that finds the same as the operators, by other means: matches from lists, overlaps by recursion."""

from __future__ import annotations

from veilframe.functions import patterns as P
from veilframe.kinds import BY_NAME, KINDS, Settings


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def re2(d: P.Detector) -> str:
    """The pattern for RE2, whose simple folding needs no care with i."""
    pattern = d.pattern.replace("(?-i:[iI])", "i").replace("(?-i:İ)", "İ").replace("(?-i:ı)", "ı")
    return ("(?i)" if d.ignore_case else "") + pattern


DIGITS = "regexp_replace({v}, '[^0-9]', '', 'g')"


def digits(v: str) -> str:
    return DIGITS.format(v=v)


def luhn(v: str) -> str:
    d = digits(v)
    return f"(length({d}) BETWEEN 13 AND 19 AND coalesce(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({d}), i, 1)::INT WHEN substr(reverse({d}), i, 1)::INT > 4 THEN substr(reverse({d}), i, 1)::INT * 2 - 9 ELSE substr(reverse({d}), i, 1)::INT * 2 END)), 1) % 10 = 0)"


def tckn(v: str) -> str:
    at = lambda i: f"substr({digits(v)}, {i + 1}, 1)::INT"
    total = lambda of: " + ".join(map(at, of))
    return f"CASE WHEN length({digits(v)}) = 11 THEN {at(0)} <> 0 AND {at(9)} = ((({total((0, 2, 4, 6, 8))}) * 7 - ({total((1, 3, 5, 7))})) % 10 + 10) % 10 AND {at(10)} = ({total(range(10))}) % 10 ELSE false END"


def credential(v: str) -> str:
    trimmed = f"ltrim(rtrim({v}, '{_quoted(P.TRIM_END)}'), '{_quoted(P.TRIM_START)}')"
    special = "[" + "".join("\\" + c for c in P.CREDENTIAL_SPECIALS) + "]"
    return f"(length({trimmed}) >= 6 AND NOT contains({trimmed}, '://') AND NOT starts_with(lower({trimmed}), 'www.') AND NOT regexp_full_match({trimmed}, '{P.PLACEHOLDER}') AND NOT regexp_matches({trimmed}, '{P.EMAIL}') AND regexp_matches({trimmed}, '\\pL') AND regexp_matches({trimmed}, '[0-9]') AND regexp_matches({trimmed}, '{special}'))"


def _valid(name: str) -> str:
    return {
        "labelled_password": "length(trim(v, '\"''')) >= 3", "credential": credential("v"), "credit_card": luhn("v"), "national_id": tckn("v"),
        "phone": f"length({digits('v')}) BETWEEN 10 AND 12", "phone_international": f"length({digits('v')}) BETWEEN 9 AND 14",
    }.get(name, "true")


def candidates(source: str, d: P.Detector) -> str:
    """SELECT of (key, start, end, kind_ord, value) from a relation (key, t)."""
    p = _quoted(re2(d))
    isolated = "AND NOT regexp_matches(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END, '[0-9]') AND NOT regexp_matches(substr(t, e + 1, 1), '[0-9]')" if d.kind == "phone" else ""
    return f"""SELECT key, s AS "start", e AS "end", {BY_NAME[d.kind].order} AS kind_ord, v AS value FROM (
  SELECT key, t, v, (sum(length(g) + length(m)) OVER w - length(v))::BIGINT AS s, (sum(length(g) + length(m)) OVER w)::BIGINT AS e
  FROM (SELECT key, t, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g
        FROM (SELECT key, t, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {d.group}) AS vs, string_split_regex(t, '{p}') AS gs FROM ({source})))
  WINDOW w AS (PARTITION BY key ORDER BY i)) WHERE {_valid(d.name)} {isolated}"""


def person_names(source: str, d: P.Detector) -> str:
    """The same for names. RE2's word boundary knows ASCII only, so it is asked about a text of the same length in which the
    pattern's other letters are spelled A and a, further letters, marks and digits _, and all else outside ASCII -."""
    upper, lower = "ÇĞİÖŞÜ", "çğıöşü"
    ascii_only = P.Detector(d.name, d.kind, d.pattern.replace(upper, "").replace(lower, ""))
    word = "|".join(rf"[^\x00-\x7F\P{{{c}}}]" for c in ("L", "M", "Nd", "Nl", "Pc"))
    spelled = f"regexp_replace(regexp_replace(translate(t, '{upper}{lower}', 'AAAAAAaaaaaa'), '{word}', '_', 'g'), '[^\\x00-\\x7F]', '-', 'g')"
    found = candidates(f"SELECT key, {spelled} AS t FROM ({source})", ascii_only)
    return f"""SELECT key, "start", "end", kind_ord, substr(t, ("start" + 1)::BIGINT, ("end" - "start")::BIGINT) AS value FROM ({found}) JOIN ({source}) USING (key)"""


def detected(source: str, settings: Settings) -> str:
    """CTEs up to `hits`: (key, pos, start, end, kind_ord, value), overlaps resolved."""
    every = "\nUNION ALL\n".join(f"({candidates('SELECT key, t FROM src', d)})" for d in P.detectors(settings))
    return f"""src AS ({source}),
cand AS (SELECT * FROM ({every}) WHERE NOT regexp_full_match(value, '{P.PLACEHOLDER}')),
{resolved('cand')}"""


def resolved(relation: str) -> str:
    """CTEs up to `hits` from (key, start, end, kind_ord, value): each row is kept unless it starts before the last kept one ends."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "start", "end" DESC, kind_ord, value) AS rn FROM {relation}),
walk AS (SELECT key, rn, "start", "end", kind_ord, value, true AS kept, "end" AS reached FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.key, r.rn, r."start", r."end", r.kind_ord, r.value, r."start" >= w.reached, CASE WHEN r."start" >= w.reached THEN r."end" ELSE w.reached END FROM walk w JOIN ranked r ON r.key = w.key AND r.rn = w.rn + 1),
hits AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY rn) - 1 AS pos, "start", "end", kind_ord, value FROM walk WHERE kept)"""


PREFIX = "[" + ", ".join(f"'{k.prefix}'" for k in KINDS) + "][kind_ord + 1]"
KIND = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "][kind_ord + 1]"


def minted(seen: str = "SELECT key AS ord, * FROM hits", known: str | None = None) -> str:
    """CTEs up to `mapping`: (placeholder, value, kind, idx) for the values seen, going on from a relation `known`."""
    old = known or "SELECT NULL::VARCHAR AS placeholder, NULL::VARCHAR AS value, NULL::VARCHAR AS kind, 0::BIGINT AS idx WHERE false"
    return f"""seen AS ({seen}),
known AS ({old}),
firsts AS (SELECT value, arg_min(kind_ord, (ord, "start")) AS kind_ord, min((ord, "start")) AS first FROM seen WHERE value NOT IN (SELECT value FROM known) GROUP BY value),
fresh AS (SELECT value, {KIND} AS kind, {PREFIX} AS prefix, row_number() OVER (PARTITION BY kind_ord ORDER BY first, value) + coalesce((SELECT max(idx) FROM known k WHERE k.kind = {KIND}), 0) AS idx FROM firsts),
mapping AS (SELECT * FROM known UNION ALL SELECT prefix || '_' || idx AS placeholder, value, kind, idx FROM fresh)"""


#: After `src`, `hits` and `mapping`: (key, masked).
MASKED = """pieces AS (SELECT key, pos, "start", "end", h.kind_ord, placeholder, coalesce(lag("end") OVER (PARTITION BY key ORDER BY pos), 0) AS before FROM hits h JOIN mapping USING (value)),
masked AS (SELECT s.key, coalesce(string_agg(substr(t, (before + 1)::BIGINT, ("start" - before)::BIGINT) || placeholder, '' ORDER BY pos), '') || substr(t, (coalesce(max("end"), 0) + 1)::BIGINT) AS masked
  FROM src s LEFT JOIN pieces p ON p.key = s.key GROUP BY s.key, t)"""
#: After those: (key, n_masked, summary), distinct placeholders counted by kind in the order the kinds were first seen.
SUMMARY = f"""distinct_ AS (SELECT key, placeholder, arg_min(kind_ord, pos) AS kind_ord, min(pos) AS pos FROM pieces GROUP BY key, placeholder),
by_kind AS (SELECT key, kind_ord, count(*) AS n, min(pos) AS pos FROM distinct_ GROUP BY key, kind_ord),
summaries AS (SELECT key, sum(n)::BIGINT AS n_masked, string_agg(n || ' ' || {PREFIX}, ', ' ORDER BY pos) AS summary FROM by_kind GROUP BY key)"""
