"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Per row: the base spans of three kinds (all matches of a pattern, left to right, that pass a length test) and the
opaque tokens that look like keys. Candidate hashes are counted over the corpus by distinct repository and distinct
owner. A candidate that few owners hold is live-looking, one that many hold is a copied example; an opaque token is
reported (kind "opaque") only if it is live-looking, base spans are always reported.

Shuffles carry candidates only, never texts: distinct (hash, owner, repository) with a partial aggregate, then the
join back on the hash, which adaptive execution can split when one example is everywhere.

Defined cases: null text is empty; null owner or repository, or a
missing column of either, counts as one owner or repository of its own; repeated
rows are separate rows; offsets are code points, end exclusive; columns of df may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.offsets import located, running
from veilframe.functions.validators import let
from veilframe.llm.shared import documents, free_names, materialize, named
from veilframe.operators.mask import splice

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The two kinds below keep only long matches; both classes end a run for good, so a longer minimum finds the same.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"


def _spans(text: Column, pattern: str, kind: int, keep=None, value: int = 0) -> Column:
    """All matches of pattern that keep() accepts, as (start, kind, end, value); the value is a group that ends the match."""
    found = located(text, pattern, value)
    if keep:
        found = F.filter(found, lambda x: keep(x["value"]))
    spans = F.transform(found, lambda x: F.struct((x["end"] - F.length(x["match"])).alias("s"), F.lit(kind).alias("k"), x["end"].alias("e"), x["value"].alias("v")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _apart(spans: Column, others: Column) -> Column:
    """Those of spans that overlap none of others (both in order): by the furthest end of all others that start before a span ends."""
    event = lambda x, of, span: F.struct(of.alias("at"), F.lit(span).alias("other"), x["e"].alias("e"), x["s"].alias("s"), x["k"].alias("k"), x["v"].alias("v"))
    events = F.array_sort(F.concat(F.transform(spans, lambda x: event(x, x["e"], 0)), F.transform(others, lambda x: event(x, x["s"], 1))))
    reach = lambda found: running(F.transform(found, lambda x: F.when(x["other"] == 1, x["e"]).otherwise(0)), F.greatest)
    free = lambda found: let(reach(found), lambda upto: F.filter(found, lambda x, i: (x["other"] == 0) & (F.get(upto, i) <= x["s"])))
    back = lambda found: F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v"))))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(back(let(events, free)))


def with_spans(df: DataFrame, text: Column) -> DataFrame:
    """df with _base (sorted spans of the base kinds) and _more (opaque tokens outside them)."""
    df = df.withColumn("_t", F.coalesce(text, F.lit("")))
    t = F.col("_t")
    looks = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    df = df.withColumn("_base", F.array_sort(F.concat(
        _spans(t, ASSIGN, 0, lambda v: F.length(v) >= 12, value=2),
        _spans(t, ACCESS_LONG, 1),
        _spans(t, HEX_LONG, 2),
    )))
    df = df.withColumn("_more", _spans(t, OPAQUE, 3, looks))
    return df.withColumn("_more", _apart(F.col("_more"), F.col("_base"))).drop("_t")


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _owned(candidates: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """candidates (_id, _h, _o, _r, _x) with _live: few distinct owners and repositories hold the hash."""
    held = candidates.select("_h", "_o", "_r").distinct()
    # First by owner, which leaves one row a (hash, owner), then by hash: no distinct sets are built in one task.
    by_owner = held.groupBy("_h", "_o").agg(F.count("*").alias("n"))
    counts = by_owner.groupBy("_h").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    return candidates.join(counts.select("_h", live.alias("_live")).hint("merge"), "_h")


def scan_secrets(df: DataFrame, text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), keep_cols: list[str] | None = None, max_owners: int = 1, max_repositories: int = 2) -> DataFrame:
    """One row per row of df: keep_cols (default: all), _base and _spans (all reported spans), n_live and n_copied.

    n_live and n_copied count the candidates of the row whose hash few, or many, owners hold. A repository is the
    combination of repository_cols. A result whose name is taken by a kept column gets an underscore after it.
    """
    cols = keep_cols if keep_cols is not None else df.columns
    given = lambda c: named(c) if c in df.columns else F.lit(None).cast("string")
    owner = F.coalesce(given(owner_col).cast("string"), F.lit("\0"))
    repository = F.to_json(F.struct(*[given(c).alias(f"c{i}") for i, c in enumerate(repository_cols)]))
    plain = df.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(cols)], owner.alias("_o"), repository.alias("_r"), named(text_col).alias("_text"))
    hashed = lambda spans: F.transform(spans, lambda x: F.struct(x["s"], x["k"], x["e"], F.unhex(F.sha2(x["v"].cast("binary"), 256)).alias("h")))
    found = with_spans(plain, F.col("_text")).drop("_text").withColumns({"_base": hashed(F.col("_base")), "_more": hashed(F.col("_more"))})
    found = materialize(found.withColumn("_id", F.monotonically_increasing_id()), "secrets")
    each = found.select("_id", "_o", "_r", F.explode(F.concat("_base", "_more")).alias("_x"))
    owned = _owned(each.select("_id", "_o", "_r", F.col("_x.h").alias("_h"), "_x"), max_owners, max_repositories)
    per_row = owned.groupBy("_id").agg(
        F.count_if("_live").alias("n_live"),
        F.count_if(~F.col("_live")).alias("n_copied"),
        F.collect_list(F.when(F.col("_live") & (F.col("_x.k") == 3), F.col("_x"))).alias("_add"),
    )
    out = found.drop("_o", "_r", "_more").join(per_row, "_id", "left")
    spans = F.array_sort(F.concat("_base", F.coalesce("_add", F.array().cast("array<struct<s:int,k:int,e:int,h:binary>>"))))
    results = (F.col("_base"), spans, F.coalesce("n_live", F.lit(0)), F.coalesce("n_copied", F.lit(0)))
    names = free_names(cols, "_base", "_spans", "n_live", "n_copied")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], *[r.alias(n) for r, n in zip(results, names, strict=True)])


def _united(spans: Column, mark: str) -> Column:
    """Spans in order that overlap, as one piece each with the mark to put there; spans that only touch stay apart."""
    def pieces(found: Column, upto: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i)["s"] >= F.get(upto, i - 1)))
        piece = lambda i, k, of: F.struct(F.get(found, i)["s"].alias("start"), F.get(upto, F.coalesce(F.get(of, k + 1), F.size(found)) - 1).alias("end"), F.lit(mark).alias("put"))
        return let(firsts, lambda of: F.transform(of, lambda i, k: piece(i, k, of)))

    return let(spans, lambda found: let(running(F.transform(found, lambda x: x["e"]), F.greatest), lambda upto: pieces(found, upto)))


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """df with every reported span of its text replaced; the columns stay as they were.

    Rows without any candidate pass through in place; only the others are written and joined with the verdicts.
    """
    cols = df.columns
    plain = df.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    at = f"_c{cols.index(text_col)}"
    any_candidate = F.coalesce(F.col(at).rlike("|".join((ASSIGN, ACCESS_LONG, HEX_LONG, OPAQUE))), F.lit(False))
    place = lambda c: f"_c{cols.index(c)}" if c in cols else "_missing"
    owner, repository = place(options.pop("owner_col", "source")), tuple(map(place, options.pop("repository_cols", ("source", "lang"))))
    some = scan_secrets(plain.filter(any_candidate), at, owner, repository, plain.columns, **options)
    text, spans = F.col(at), F.col("_spans")
    clean = F.when(F.size(spans) == 0, text).otherwise(splice(text, _united(spans, mark)))
    changed = some.withColumn(at, clean).select(*plain.columns)
    return plain.filter(~any_candidate).unionAll(changed).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])


def op1(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(documents(spark, sf_dir), keep_cols=["doc_id"])
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("bigint")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_text_of(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("_spans")).alias("spans"), "n_live", "n_copied")


def _sql_spans(kind: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind in SQL: gaps and matches of a text in turn give the offsets."""
    p = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, owner, repository, {kind} AS k, v,
             (sum(length(g) + length(m)) OVER w - length(m))::BIGINT AS s, (sum(length(g) + length(m)) OVER w)::BIGINT AS e, length(m) AS n
      FROM (SELECT doc_id, owner, repository, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g
            FROM (SELECT doc_id, owner, repository, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS gs FROM d))
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)
      QUALIFY length(v) >= {least}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner, concat_ws('|', source, lang) AS repository FROM documents),
base AS ({_sql_spans(0, ASSIGN, 2, 12)} UNION ALL {_sql_spans(1, ACCESS, 0, 18)} UNION ALL {_sql_spans(2, HEX, 0, 16)}),
opaque AS (SELECT * FROM ({_sql_spans(3, OPAQUE, 0, 24)}) o WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.e AND o.s < b.e)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
held AS (SELECT v, count(DISTINCT owner) <= 1 AND count(DISTINCT (owner, repository)) <= 2 AS live FROM cand GROUP BY v),
marked AS (SELECT c.*, live, ['assign', 'access', 'hex', 'opaque'][k + 1] || ':' || s || ':' || e AS said FROM cand c JOIN held USING (v))
SELECT d.doc_id,
       count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(said, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
       coalesce(string_agg(said, ',' ORDER BY s, k) FILTER (k < 3 OR live), '') AS spans,
       count(*) FILTER (live) AS n_live, count(*) FILTER (k IS NOT NULL AND NOT live) AS n_copied
FROM d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id
"""
