"""Queries by name over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import guard
from veilframe.folders import new_path
from veilframe.functions import patterns as P
from veilframe.functions import validators as V
from veilframe.kinds import Settings
from veilframe.operators import mapping as M
from veilframe.operators.detect import candidates, detect, kind_name, matches, resolve_overlaps
from veilframe.operators.mask import Masked, edit, has_restorable, mask, restore
from veilframe.plans import oracles as O
from veilframe.session import Session
from veilframe.sources import documents as D
from veilframe.sources import formats, ooxml, pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Without names, and with two words of the user's own.
DEFAULT, WORDS = Settings(), Settings(custom_words=("Apache License", "license", "the of"))
EMAIL, CONTACTS = Settings(("email",)), Settings(("email", "credit_card", "phone"))


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Texts. Kinds that the documents lack are spelled from keys of other tables, so that SQL can spell them as well:
# a relation is (key, t) on both sides.

TEXTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "documents": (lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("t")), "SELECT doc_id AS key, text AS t FROM documents"),
    "pages": (lambda s, d: table(s, d, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("t")), "SELECT page_id AS key, html AS t FROM pages"),
}


def _spelled(name: str, source: str, key: str, spark_sql: str, duck_sql: str | None = None) -> None:
    TEXTS[name] = (lambda s, d: table(s, d, source).selectExpr(f"{key} AS key", f"{spark_sql} AS t"), f"SELECT {key} AS key, {duck_sql or spark_sql} AS t FROM {source}")


_K = "lpad(cast(c_custkey * 7919 % 1000000000 AS STRING), 9, '1')"
_NINE = [f"cast(substr(lpad(cast(c_custkey * 7919 % 1000000000 AS STRING), 9, '1'), {i}, 1) AS INT)" for i in range(1, 10)]
_TEN = f"((({' + '.join(_NINE[0::2])}) * 7 - ({' + '.join(_NINE[1:8:2])})) % 10 + 10) % 10"
_ELEVEN = f"(({' + '.join(_NINE)}) + {_TEN} + c_custkey % 2) % 10"
_spelled("customers", "customer", "c_custkey", f"concat('no ', {_K}, cast({_TEN} AS STRING), cast({_ELEVEN} AS STRING), ' of ', c_name)")
_spelled("accounts", "customer", "c_custkey", "concat('IBAN TR', lpad(cast(c_custkey % 100 AS STRING), 2, '0'), ' 0006 1005 9786 ', lpad(cast(c_custkey AS STRING), 4, '0'), ' 4132 ', CASE WHEN c_custkey % 3 = 0 THEN '2' ELSE '26' END, ', TR', lpad(cast(c_custkey AS STRING), 24, '0'), '.')")
_spelled("credentials", "customer", "c_custkey", "concat('login ', c_name, ' ', CASE c_custkey % 5 WHEN 0 THEN 'trX' WHEN 1 THEN 'http:' WHEN 2 THEN 'www.' WHEN 3 THEN '(Ab' ELSE 'şĞ!' END, cast(c_custkey AS STRING), CASE c_custkey % 4 WHEN 0 THEN '&21.' WHEN 1 THEN 'plain' WHEN 2 THEN '@x.org' ELSE '!?)' END, ' end')")
_spelled("suppliers", "supplier", "s_suppkey", "concat('call +', cast(s_suppkey % 300 AS STRING), ' 20 7946 ', lpad(cast(s_suppkey AS STRING), 4, '0'), ' or 0', cast(200 + s_suppkey % 400 AS STRING), ' 555 12 ', lpad(cast(s_suppkey % 100 AS STRING), 2, '0'), CASE WHEN s_suppkey % 4 = 0 THEN '7' ELSE '' END, '.')")
_spelled("labels", "orders", "o_orderkey", "concat(CASE o_orderkey % 6 WHEN 0 THEN 'PASSWORD' WHEN 1 THEN 'sifre' WHEN 2 THEN 'Token' WHEN 3 THEN 'mypin' WHEN 4 THEN 'PIN' ELSE 'anahtar' END, CASE o_orderkey % 4 WHEN 0 THEN ' : ' WHEN 1 THEN '=' WHEN 2 THEN '-' ELSE ' ' END, CASE o_orderkey % 3 WHEN 0 THEN '\"a b\"' WHEN 1 THEN 'ab' ELSE o_orderpriority END, ' x')")

#: Detector -> (text, settings that switch it on).
_DETECTIONS = {
    "detect_email": ("email", "documents", DEFAULT), "detect_card_luhn": ("credit_card", "documents", DEFAULT), "detect_phone_isolated": ("phone", "documents", DEFAULT),
    "detect_labelled_password": ("labelled_password", "documents", DEFAULT), "detect_labels_spelled": ("labelled_password", "labels", DEFAULT), "detect_person_name": ("person_name", "documents", Settings(("person_name",))),
    "detect_credential_shape": ("credential", "credentials", DEFAULT), "detect_tckn": ("national_id", "customers", DEFAULT), "detect_iban": ("iban", "accounts", DEFAULT),
    "detect_intl_phone": ("phone_international", "suppliers", DEFAULT), "detect_domestic_phone": ("phone", "suppliers", DEFAULT), "detect_custom_words": ("custom_word", "documents", WORDS), "detect_email_html": ("email", "pages", DEFAULT), "detect_card_html": ("credit_card", "pages", DEFAULT),
}


def _detection(detector: P.Detector, text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = TEXTS[text][0](spark, sf_dir).select("key", F.explode(candidates(F.col("t"), detector)).alias("m"))
        return found.select("key", F.col("m.start").cast("bigint").alias("start"), (F.col("m.start") - F.col("m.neg_length")).cast("bigint").alias("end"), F.col("m.value").alias("value"))

    return run


for _name, (_detector, _text, _settings) in _DETECTIONS.items():
    _d = next(d for d in P.detectors(_settings) if d.name == _detector)
    QUERIES[_name] = _detection(_d, _text)
    ORACLES[_name] = f'SELECT key, "start", "end", value FROM ({(O.person_names if _detector == "person_name" else O.candidates)(TEXTS[_text][1], _d)})'

# Scalar functions.

_VALUES = "SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN '4111 1111 1111 ' || lpad((o_orderkey * 37 % 10000)::VARCHAR, 4, '0') WHEN 1 THEN lpad((o_orderkey * 7919 % 100000000000)::VARCHAR, 11, '1') WHEN 2 THEN 'TCKN_' || o_orderkey ELSE 'KART_' || o_orderkey || 'x' END AS v FROM orders"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "CASE o_orderkey % 4 WHEN 0 THEN concat('4111 1111 1111 ', lpad(cast(o_orderkey * 37 % 10000 AS STRING), 4, '0')) WHEN 1 THEN lpad(cast(o_orderkey * 7919 % 100000000000 AS STRING), 11, '1') WHEN 2 THEN concat('TCKN_', o_orderkey) ELSE concat('KART_', o_orderkey, 'x') END AS v")


for _name, _f, _sql in (("luhn_valid", V.luhn_valid, O.luhn("v")), ("tckn_valid", V.tckn_valid, O.tckn("v")), ("is_placeholder", V.is_placeholder, f"regexp_full_match(v, '{P.PLACEHOLDER}')"), ("digit_count", lambda v: V.digit_count(v).cast("bigint"), f"length({O.digits('v')})::BIGINT")):
    QUERIES[_name] = lambda s, d, f=_f: _values(s, d).select("key", f(F.col("v")).alias("result"))
    ORACLES[_name] = f"SELECT key, {_sql} AS result FROM ({_VALUES})"


@_query("digit_isolated", f"SELECT key, NOT regexp_matches(CASE WHEN s > 0 THEN substr(v, s, 1) ELSE '' END, '[0-9]') AND NOT regexp_matches(substr(v, s + 4, 1), '[0-9]') AS result FROM (SELECT *, key % 7 AS s FROM ({_VALUES}))")
def _digit_isolated(spark, sf_dir):
    start = (F.col("key") % 7).cast("int")
    return _values(spark, sf_dir).select("key", V.digit_isolated(F.col("v"), start, start + 3).alias("result"))


@_query("format_dispatch", "SELECT page_id, CASE WHEN e IN ('docx', 'xlsx', 'pptx', 'dotx', 'xltx', 'potx', 'xlsm', 'docm', 'pptm') THEN 'ooxml' WHEN e IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'gif', 'heic') THEN 'image' WHEN e = 'pdf' THEN 'pdf' ELSE 'text' END AS format FROM (SELECT page_id, ['docx', 'PNG', 'pdf', 'csv', 'heic', 'Xlsm'][page_id % 6 + 1] AS x, lower(regexp_extract(url || '/f.' || x, '[^/]\\.([^./]*)$', 1)) AS e FROM pages)")
def _format_dispatch(spark, sf_dir):
    ext = F.get(F.array(*map(F.lit, ("docx", "PNG", "pdf", "csv", "heic", "Xlsm"))), (F.col("page_id") % 6).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", formats.format_column(F.concat("url", F.lit("/f."), ext)).alias("format"))


# Detection with all kinds.

_ALL_HITS = f"WITH RECURSIVE {O.detected(TEXTS['documents'][1], DEFAULT)}"


@_query("detect_all", f'{_ALL_HITS} SELECT key AS doc_id, pos, "start", "end", {O.KIND} AS kind, value FROM hits')
def _detect_all(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents"), "text", ["doc_id"]).withColumns({c: F.col(c).cast("bigint") for c in ("pos", "start", "end")})


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(detect(F.col("text"))).alias("m")).select("doc_id", "lang", kind_name(F.col("m.kind_ord")).alias("kind"))


@_query("kind_counts", f"{_ALL_HITS} SELECT {O.KIND} AS kind, count(*) AS n_hits, count(DISTINCT key) AS n_docs FROM hits GROUP BY ALL")
def kind_counts(spark, sf_dir):
    return _kinds(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"))


@_query("kind_counts_by_lang", f"{_ALL_HITS} SELECT lang, {O.KIND} AS kind, count(*) AS n_hits FROM hits JOIN documents ON doc_id = key GROUP BY ALL")
def _kind_counts_by_lang(spark, sf_dir):
    return _kinds(spark, sf_dir).groupBy("lang", "kind").agg(F.count("*").alias("n_hits"))


@_query("docs_with_pii", f"{_ALL_HITS} SELECT doc_id, count(key) AS n_hits, count(key) > 0 AS has_pii FROM documents LEFT JOIN hits ON doc_id = key GROUP BY doc_id")
def _docs_with_pii(spark, sf_dir):
    n = F.size(detect(F.col("text"))).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_hits")).withColumn("has_pii", F.col("n_hits") > 0)


_SPANS = """SELECT l_orderkey AS key, l_partkey % 40 AS "start", l_partkey % 40 + l_suppkey % 12 + 1 AS "end", l_linenumber % 8 AS kind_ord, l_linestatus || l_partkey AS value FROM lineitem"""


@_query("overlap_resolution", f'WITH RECURSIVE {O.resolved(f"({_SPANS})")} SELECT key, pos, "start", "end", kind_ord::BIGINT AS kind_ord, value FROM hits')
def _overlap_resolution(spark, sf_dir):
    start, length = (F.col("l_partkey") % 40).cast("int"), (F.col("l_suppkey") % 12 + 1).cast("int")
    span = F.struct(start.alias("start"), (-length).alias("neg_length"), (F.col("l_linenumber") % 8).cast("int").alias("kind_ord"), F.concat("l_linestatus", "l_partkey").alias("value"))
    kept = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(span).alias("m")).select("key", F.posexplode(resolve_overlaps(F.col("m"))).alias("pos", "m"))
    return kept.select("key", F.col("pos").cast("bigint").alias("pos"), F.col("m.start").cast("bigint").alias("start"), (F.col("m.start") - F.col("m.neg_length")).cast("bigint").alias("end"), F.col("m.kind_ord").cast("bigint").alias("kind_ord"), F.col("m.value").alias("value"))


# Mapping.

_CONTACT_HITS = f"WITH RECURSIVE {O.detected(TEXTS['documents'][1], CONTACTS)}"


_last: list[Masked] = []


def _masked(spark: SparkSession, sf_dir: str, settings: Settings = CONTACTS, text: str = "documents", mapping: DataFrame | None = None) -> Masked:
    """What a query masks stays cached until another query masks; a query that goes on from another's mapping keeps both."""
    while mapping is None and _last:
        _last.pop().release()
    _last.append(mask(TEXTS[text][0](spark, sf_dir), "t", "key", settings=settings, mapping=mapping))
    return _last[-1]


@_query("mint_first_seen", f"{_CONTACT_HITS}, {O.minted()} SELECT * FROM mapping")
def _mint_first_seen(spark, sf_dir):
    return _masked(spark, sf_dir).mapping


def _second(sql: str, mark: str) -> str:
    """The CTEs of sql under other names, so that two sets fit in one statement."""
    return re.sub(r"\b(src|cand|ranked|walk|hits|seen|known|firsts|fresh|mapping)\b(?=(?: AS \(|$|\)| |\n|\.))", rf"\1_{mark}", sql)


_PAGES_MINTED = f"{_second(O.detected(TEXTS['pages'][1], CONTACTS), 'p')}, {_second(O.minted(), 'p')}"


@_query("mint_resume", f"WITH RECURSIVE {_PAGES_MINTED}, {O.detected(TEXTS['documents'][1], CONTACTS)}, {O.minted(known='SELECT * FROM mapping_p')} SELECT * FROM mapping")
def _mint_resume(spark, sf_dir):
    """The values of the pages first; then those of the documents go on from them."""
    return _masked(spark, sf_dir, mapping=_masked(spark, sf_dir, text="pages").mapping).mapping


@_query("value_keyed_mapping", f"""WITH {O.minted("SELECT c_mktsegment AS value, (c_custkey * 5 % 8)::INT AS kind_ord, c_custkey AS ord, 0 AS \"start\" FROM customer")} SELECT * FROM mapping""")
def _value_keyed_mapping(spark, sf_dir):
    """A value seen as several kinds gets one placeholder, of the kind it was first seen as."""
    seen = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value"), (F.col("c_custkey") * 5 % 8).cast("int").alias("kind_ord"), F.col("c_custkey").alias("ord"), F.lit(0).alias("start"))
    return M.mint(seen, M.empty_mapping(spark))


@_query("mapping_file_round_trip", f"{_CONTACT_HITS}, {O.minted()} SELECT * FROM mapping")
def _mapping_file_round_trip(spark, sf_dir):
    path = f"{new_path(spark, 'mapping')}/mapping.json"
    M.save_mapping(_masked(spark, sf_dir).mapping, path)
    return M.load_mapping(spark, path)


@_query("mapping_counters", f"{_CONTACT_HITS}, {O.minted()} SELECT kind, max(idx) AS last, count(*) AS n FROM mapping GROUP BY kind")
def _mapping_counters(spark, sf_dir):
    return _masked(spark, sf_dir).mapping.groupBy("kind").agg(F.max("idx").alias("last"), F.count("*").alias("n"))


# Masking and restoring.

for _name, _settings, _text in (("mask_text", DEFAULT, "documents"), ("mask_email", EMAIL, "documents"), ("mask_custom_words", WORDS, "documents"), ("mask_html_pages", CONTACTS, "pages")):
    QUERIES[_name] = lambda s, d, c=_settings, t=_text: _masked(s, d, c, t).df.select("key", "masked")
    ORACLES[_name] = f"WITH RECURSIVE {O.detected(TEXTS[_text][1], _settings)}, {O.minted()}, {O.MASKED} SELECT key, masked FROM masked"

_REPORTED = f"WITH RECURSIVE {O.detected(TEXTS['documents'][1], DEFAULT)}, {O.minted()}, {O.MASKED}, {O.SUMMARY}"


@_query("mask_summary", f"{_REPORTED} SELECT s.key, coalesce(n_masked, 0) AS n_masked, coalesce(summary, '') AS summary FROM src s LEFT JOIN summaries USING (key)")
def _mask_summary(spark, sf_dir):
    return _masked(spark, sf_dir, DEFAULT).df.select("key", F.col("n_masked").cast("bigint").alias("n_masked"), "summary")


@_query("mask_report", f"{_REPORTED} SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS place, placeholder, {O.KIND} AS kind FROM distinct_")
def _mask_report(spark, sf_dir):
    found = _masked(spark, sf_dir, DEFAULT).df.select("key", F.posexplode("report").alias("place", "r"))
    return found.select("key", F.col("place").cast("bigint").alias("place"), "r.placeholder", "r.kind")


@_query("round_trip_identity", "SELECT doc_id AS key, text AS restored FROM documents")
def _round_trip_identity(spark, sf_dir):
    m = _masked(spark, sf_dir, DEFAULT)
    return restore(m.df.select("key", "masked"), "masked", "key", m.mapping).select("key", "restored")


#: Texts with known, unknown and near-miss placeholders, for a mapping of regions' names.
_REFERRED = "concat('x TCKN_', cast(c_custkey % 9 AS STRING), ', TCKN_0', cast(c_custkey % 9 AS STRING), ' TCKN_', cast(c_custkey % 7 AS STRING), 'y KART_', cast(c_nationkey AS STRING), '. ', c_name)"
_spelled("referred", "customer", "c_custkey", _REFERRED)
_NAMES = "SELECT 'TCKN_' || r_regionkey AS placeholder, r_name AS value FROM region"


def _region_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.from_pairs(table(spark, sf_dir, "region").select(F.concat(F.lit("TCKN_"), "r_regionkey").alias("placeholder"), F.col("r_name").alias("value")))


_KNOWN = "(SELECT value FROM names WHERE placeholder = 'TCKN_' || c_custkey % 9)"


@_query("restore_text", f"WITH names AS ({_NAMES}) SELECT c_custkey AS key, concat('x ', coalesce({_KNOWN}, 'TCKN_' || c_custkey % 9), ', TCKN_0', c_custkey % 9, ' TCKN_', c_custkey % 7, 'y KART_', c_nationkey, '. ', c_name) AS restored, CASE WHEN {_KNOWN} IS NULL THEN 0 ELSE 1 END::BIGINT AS n_restored FROM customer")
def _restore_text(spark, sf_dir):
    out = restore(TEXTS["referred"][0](spark, sf_dir), "t", "key", _region_mapping(spark, sf_dir))
    return out.select("key", "restored", F.col("n_restored").cast("bigint").alias("n_restored"))


@_query("restore_idempotent", "SELECT c_custkey AS key, 0::BIGINT AS n_restored FROM customer")
def _restore_idempotent(spark, sf_dir):
    mapping = _region_mapping(spark, sf_dir)
    once = restore(TEXTS["referred"][0](spark, sf_dir), "t", "key", mapping).select("key", F.col("restored").alias("t"))
    return restore(once, "t", "key", mapping).select("key", F.col("n_restored").cast("bigint").alias("n_restored"))


@_query("restore_unknown", f"SELECT key, t AS restored FROM ({TEXTS['referred'][1]})")
def _restore_unknown(spark, sf_dir):
    return restore(TEXTS["referred"][0](spark, sf_dir), "t", "key", M.empty_mapping(spark)).select("key", "restored")


@_query("has_restorable", f"WITH names AS ({_NAMES}) SELECT c_custkey AS key, {_KNOWN} IS NOT NULL AS restorable FROM customer")
def _has_restorable(spark, sf_dir):
    return has_restorable(TEXTS["referred"][0](spark, sf_dir), "t", "key", _region_mapping(spark, sf_dir)).select("key", "restorable")


def _edit_sql(old: str) -> str:
    n = f"(CASE WHEN text IS NULL OR {old} IS NULL OR {old} = '' THEN 0 ELSE (length(text) - length(replace(text, {old}, ''))) // length({old}) END)::BIGINT"
    return f"SELECT conv_id, turn, {n} AS occurrences, CASE WHEN {old} = '' THEN 'empty' WHEN {n} = 0 THEN 'not found' WHEN {n} > 1 THEN 'ambiguous' ELSE 'edited' END AS status, CASE WHEN {n} = 1 THEN replace(text, {old}, 'EDITED') ELSE text END AS edited FROM conversations"


for _name, _old, _sql in (("edit_unique", lambda: F.col("text"), "text"), ("edit_ambiguous", lambda: F.lit("e "), "'e '"), ("edit_missing", lambda: F.lit("no such words"), "'no such words'"), ("edit_by_role", lambda: F.concat(F.substring("role", 1, 2), F.lit("")), "substr(role, 1, 2)")):
    def _edit(spark, sf_dir, old=_old):
        e = table(spark, sf_dir, "conversations").withColumn("e", edit(F.col("text"), old(), F.lit("EDITED")))
        return e.select("conv_id", "turn", F.col("e.occurrences").cast("bigint").alias("occurrences"), "e.status", "e.edited")

    QUERIES[_name] = _edit
    ORACLES[_name] = _edit_sql(_sql)


# Document formats: files made from the documents, in memory, then read.

_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def _rows(df: DataFrame, look: Callable[[int, str | None], tuple], schema: str) -> DataFrame:
    """Rows (key, ...) of the schema, by look(key, t) from a relation (key, t)."""
    fields = [x.split() for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [(key, *look(key, t)) for key, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])

    return df.mapInArrow(run, schema)


def _made(spark: SparkSession, sf_dir: str, make: Callable[[str], bytes], look: Callable[[str, bytes], tuple], schema: str) -> DataFrame:
    return _rows(TEXTS["documents"][0](spark, sf_dir), lambda _, t: look(t or "", make(t or "")), schema)


def make_docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types>the </Types>")
        z.writestr(zipfile.ZipInfo("word/media/image1.png"), b"the \x89PNG", zipfile.ZIP_STORED)
        z.writestr("word/document.xml", "<d>" + "\n ".join(f"<p><t>{escape(line)}</t></p>" for line in text.split("\n")) + "</d>")
    return out.getvalue()


def make_pdf(text: str) -> bytes:
    body = "".join(c if c.isalnum() and c.isascii() or c == " " else " " for c in text)
    stream = f"BT /F1 12 Tf 40 700 Td ({body}) Tj ET".encode()
    return b"%PDF-1.4\n3 0 obj\n<< /Type /Page /Contents 4 0 R >>\nendobj\n4 0 obj\n" + f"<< /Length {len(stream)} >>".encode() + b"\nstream\n" + stream + b"\nendstream\nendobj\n%%EOF\n"


def make_composite_pdf(text: str, table: bool) -> bytes:
    """The same page in a composite font whose codes are no characters, with or without the table that says what they are."""
    body = [c if c.isalnum() and c.isascii() else " " for c in text]
    code = {c: n for n, c in enumerate(sorted(set(body)), 1)}
    stream = ("BT /F1 12 Tf <" + "".join(f"{code[c]:04X}" for c in body) + "> Tj ET").encode()
    cmap = ("begincmap 1 beginbfchar " + " ".join(f"<{n:04X}> <{ord(c):04X}>" for c, n in code.items()) + " endbfchar endcmap").encode()
    parts = [b"<< /Type /Page /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>", b"<< >>\nstream\n" + stream + b"\nendstream", b"<< /Type /Font /Subtype /Type0" + b" /ToUnicode 6 0 R" * table + b" >>", b"<< >>\nstream\n" + cmap + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in enumerate(parts, 3)) + b"%%EOF\n"


_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')"


@_query("ooxml_extract", f"SELECT doc_id AS key, array_to_string({_LINES}, chr(10)) || CASE WHEN len({_LINES}) > 0 THEN chr(10) ELSE '' END AS extracted FROM documents")
def _ooxml_extract(spark, sf_dir):
    return _made(spark, sf_dir, make_docx, lambda t, b: (ooxml.extract_text(b),), "key bigint, extracted string")


@_query("ooxml_edit", "SELECT doc_id AS key, ((length(text) - length(replace(text, 'the ', ''))) // 4)::BIGINT AS replaced FROM documents")
def _ooxml_edit(spark, sf_dir):
    return _made(spark, sf_dir, make_docx, lambda t, b: (ooxml.replace_text(b, "the ", "a <b> ")[1],), "key bigint, replaced bigint")


def _untouched(before: bytes, after: bytes) -> bool:
    """Whether members, their order, their compression and the bytes of all but the text are the same."""
    with zipfile.ZipFile(io.BytesIO(before)) as a, zipfile.ZipFile(io.BytesIO(after)) as b:
        same = [(x.filename, x.compress_type) for x in a.infolist()] == [(x.filename, x.compress_type) for x in b.infolist()]
        return same and all(a.read(n) == b.read(n) for n in a.namelist() if n != "word/document.xml")


@_query("ooxml_rewritten", f"SELECT doc_id AS key, replace(array_to_string({_LINES}, chr(10)), 'the ', 'a <b> & ') || CASE WHEN len({_LINES}) > 0 THEN chr(10) ELSE '' END AS extracted, true AS untouched FROM documents")
def _ooxml_rewritten(spark, sf_dir):
    def look(t: str, made: bytes) -> tuple:
        done = ooxml.replace_text(made, "the ", "a <b> & ")[0]
        return ooxml.extract_text(done), _untouched(made, done)

    return _made(spark, sf_dir, make_docx, look, "key bigint, extracted string, untouched boolean")


@_query("ooxml_unread_pictures", "SELECT doc_id AS key, true AS warned FROM documents")
def _ooxml_unread_pictures(spark, sf_dir):
    return _made(spark, sf_dir, make_docx, lambda t, b: ("word/media/image1.png" in D.document_text("x.docx", b).rpartition("WARNING")[2],), "key bigint, warned boolean")


_MEMBERS = ("word/document.xml", "word/header.rels", "xl/sharedStrings.xml", "xl/worksheets/s1.xml", "xl/styles.xml", "xl/charts/c.XML", "ppt/slides/s.xml", "ppt/notesSlides/n.xml", "docProps/core.xml", "docProps/app.xml", "word/media/a.PNG", "ppt/media/b.heic", "xl/media/c.tiff", "other/media/d.png")
_spelled("members", "pages", "page_id", f"CASE page_id % {len(_MEMBERS)}" + "".join(f" WHEN {i} THEN '{m}'" for i, m in enumerate(_MEMBERS)) + " END")
_TEXT_PREFIX = " OR ".join(f"starts_with(t, '{m}')" for m in ooxml.TEXT_MEMBERS)


@_query("ooxml_members", f"SELECT key, t AS member, t LIKE '%.xml' AND ({_TEXT_PREFIX}) AS text, regexp_matches(t, '^(word|xl|ppt)/media/') AND regexp_matches(lower(t), '[.](png|jpe?g|tiff?|bmp|gif)$') AS picture FROM ({TEXTS['members'][1]})")
def _ooxml_members(spark, sf_dir):
    return _rows(TEXTS["members"][0](spark, sf_dir), lambda _, t: (t, ooxml.carries_text(t), ooxml.is_media(t)), "key bigint, member string, text boolean, picture boolean")


@_query("plain_text_scan", "SELECT doc_id AS key, CASE WHEN doc_id % 10 <> 3 THEN coalesce(text, '') END AS text, doc_id % 10 = 3 AS refused FROM documents")
def _plain_text_scan(spark, sf_dir):
    """Every tenth file ends in a byte that no UTF-8 text has."""
    content = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.when(F.col("doc_id") % 10 == 3, F.unhex(F.lit("FF"))).otherwise(F.lit("").cast("binary")))
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), D.plain_text(content).alias("p"))
    return found.select("key", "p.text", F.col("p.error").isNotNull().alias("refused"))


# Tools over single files and snippets.

def _refused(call: Callable[[], object]) -> bool:
    try:
        call()
    except guard.Refused:
        return True
    return False


_PATHS = ("/srv/in/a.txt", "/srv/in/../other/a.txt", "/srv/inner/a.txt", "/dev/null", "/proc/self/mem", "/srv/in/new folder/./b.txt", "relative.txt", "/srv/in")


@_query("path_guard", f"SELECT page_id AS key, page_id % {len(_PATHS)} NOT IN (0, 5, 7) AS refused, page_id % {len(_PATHS)} IN (3, 4) AS refused_anywhere FROM pages")
def _path_guard(spark, sf_dir):
    """Places for files within a root, beside it and on devices; and the same without any root."""
    def look(key: int, _) -> tuple:
        path = _PATHS[key % len(_PATHS)]
        return _refused(lambda: guard.check_path(path, ("/srv/in",))), _refused(lambda: guard.check_path(path))

    return _rows(TEXTS["pages"][0](spark, sf_dir), look, "key bigint, refused boolean, refused_anywhere boolean")


@_query("write_guard", "SELECT page_id AS key, page_id % 6 <> 3 AS whole_refused, page_id % 6 IN (1, 2, 4) AS edit_refused FROM pages")
def _write_guard(spark, sf_dir):
    names = ("a.docx", "b.PNG", "c.pdf", "d.csv", "e.heic", "f.Xlsm")
    def look(key: int, _) -> tuple:
        return tuple(_refused(lambda: guard.check_writable_format(names[key % 6], whole)) for whole in (True, False))

    return _rows(TEXTS["pages"][0](spark, sf_dir), look, "key bigint, whole_refused boolean, edit_refused boolean")


@_query("tool_calls", "SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 3 OR c_custkey % 3 = 1 OR (c_custkey % 4 = 1 AND c_custkey % 5 <> 0) THEN 'refused' WHEN c_custkey % 4 = 0 THEN 'EPOSTA_1' || chr(10) || chr(10) || '(1 masked: 1 EPOSTA)' WHEN c_custkey % 4 = 2 THEN 'plain ' || c_custkey ELSE '(none of the placeholders in it is known)' END AS said FROM customer")
def _tool_calls(spark, sf_dir):
    """Tools by name: unknown ones, missing arguments and answers that would reveal values are refused."""
    def look(key: int, _) -> tuple:
        name, text = (("anonymize_text", f"u{key}@example.com"), ("restore_text", "TCKN_1"), ("anonymize_text", f"plain {key}"), ("no_such_tool", ""))[key % 4]
        try:
            return (Session(allow_reveal=key % 5 == 0).dispatch(name, {} if key % 3 == 1 else {"text": text}),)
        except guard.Refused:
            return ("refused",)

    return _rows(TEXTS["referred"][0](spark, sf_dir), look, "key bigint, said string")


@_query("snippet_masked", f"SELECT event_id AS key, 'user EPOSTA_1 did ' || event_type || ', user EPOSTA_1' || chr(10) || chr(10) || '(1 masked: 1 EPOSTA)' AS said FROM events")
def _snippet_masked(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("event_id AS key", "concat('user u', cast(user_id AS STRING), '@example.com did ', event_type, ', user u', cast(user_id AS STRING), '@example.com') AS t")
    return _rows(events, lambda _, t: (Session().anonymize_text(t),), "key bigint, said string")


@_query("snippet_restored", f"WITH names AS ({_NAMES}) SELECT c_custkey AS key, CASE WHEN {_KNOWN} IS NULL THEN '(none of the placeholders in it is known)' ELSE concat('x ', {_KNOWN}, ', TCKN_0', c_custkey % 9, ' TCKN_', c_custkey % 7, 'y KART_', c_nationkey, '. ', c_name) END AS said FROM customer")
def _snippet_restored(spark, sf_dir):
    names = {f"TCKN_{r['r_regionkey']}": r["r_name"] for r in table(spark, sf_dir, "region").collect()}  # five rows

    def look(_, t: str) -> tuple:
        session = Session(allow_reveal=True)
        session.store.to_value.update(names)
        return (session.restore_text(t),)

    return _rows(TEXTS["referred"][0](spark, sf_dir), look, "key bigint, said string")


@_query("mapping_size", f"{_CONTACT_HITS}, {O.minted()} SELECT count(*) AS n FROM mapping")
def _mapping_size(spark, sf_dir):
    return _masked(spark, sf_dir).mapping.agg(F.count("*").alias("n"))


@_query("pdf_classify", "SELECT doc_id AS key, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < 16 AS scanned FROM documents")
def _pdf_classify(spark, sf_dir):
    return _made(spark, sf_dir, make_pdf, lambda t, b: (pdf.needs_ocr(pdf.extract_text(b)),), "key bigint, scanned boolean")


@_query("pdf_warning", "SELECT doc_id AS key, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < 16 AS warned FROM documents")
def _pdf_warning(spark, sf_dir):
    return _made(spark, sf_dir, make_pdf, lambda t, b: ("WARNING" in D.document_text("x.pdf", b),), "key bigint, warned boolean")


@_query("pdf_composite", "SELECT doc_id AS key, length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g'))::BIGINT AS readable, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < 16 AS warned, coalesce(text, '') <> '' AS warned_without FROM documents")
def _pdf_composite(spark, sf_dir):
    """Characters read with the font's table; whether the file is warned of with it, and without it."""
    def look(text: str, made: bytes) -> tuple:
        blind = D.document_text("x.pdf", make_composite_pdf(text, False))
        return sum(c.isalnum() for c in pdf.extract_text(made)), "WARNING" in D.document_text("x.pdf", made), bool(text) and "WARNING" in blind

    return _made(spark, sf_dir, lambda t: make_composite_pdf(t, True), look, "key bigint, readable bigint, warned boolean, warned_without boolean")


# Streaming.

_EVENT = "concat('user u', cast(user_id AS STRING), '@example.com did ', event_type)"
_spelled("events", "events", "event_id", _EVENT)


@_query("stream_mask_events", f"WITH RECURSIVE {O.detected(TEXTS['events'][1], EMAIL)}, {O.minted()}, {O.MASKED} SELECT key, masked FROM masked")
def _stream_mask_events(spark, sf_dir):
    from veilframe.streaming.mask_stream import mask_stream

    at = new_path(spark, "stream")
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).selectExpr("event_id AS key", f"{_EVENT} AS t")
    mask_stream(stream, "t", "key", "key", f"{at}/mapping", f"{at}/out", f"{at}/checkpoint", EMAIL).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("key", "masked")

