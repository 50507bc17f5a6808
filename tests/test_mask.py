import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from veilframe.functions.python_detect import detect
from veilframe.kinds import BY_NAME, Settings
from veilframe.operators import mapping as M
from veilframe.operators.mask import edit, has_restorable, mask, restore


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")


def reference(texts, known=(), settings=None):
    """Masking one text after another, with a dictionary."""
    to, counters, out = {v: p for p, v in known}, {}, []
    for p, _ in known:
        prefix, _, n = p.rpartition("_")
        counters[prefix] = max(counters.get(prefix, 0), int(n))
    for t in texts:
        done, at, report = "", 0, {}
        for s, e, kind, v in detect(t or "", settings):
            if v not in to:
                prefix = BY_NAME[kind].prefix
                counters[prefix] = counters.get(prefix, 0) + 1
                to[v] = f"{prefix}_{counters[prefix]}"
            report.setdefault(to[v], kind)
            done, at = done + t[at:s] + to[v], e
        out.append((t if t is None else done + t[at:], list(report.items())))
    return out, {p: v for v, p in to.items()}


def run(spark, texts, mapping=None, settings=None):
    m = mask(frame(spark, texts), "text", "id", settings=settings, mapping=mapping)
    rows = m.df.orderBy("id").collect()
    return [(r["masked"], [(x["placeholder"], x["kind"]) for x in r["report"]]) for r in rows], {r["placeholder"]: r["value"] for r in m.mapping.collect()}, m, rows


TEXTS = ["a@b.com ve c@d.com ve tckn 10000000146", None, "", "again c@d.com, new e@f.org; a@b.com a@b.com", "İstanbul’dan a.b@example.com adresine — şifre: Gtts@2020 son", "şifre: a@b.com", "plain", "kart 4111 1111 1111 1111 TR330006100519786457841326"]


def test_masking_equals_a_dictionary(spark):
    got, mapping, m, rows = run(spark, TEXTS)
    want, table = reference(TEXTS)
    assert got == want and mapping == table
    assert rows[0]["summary"] == "2 EPOSTA, 1 TCKN" and rows[0]["n_masked"] == 3 and rows[6]["summary"] == ""
    assert rows[5]["masked"] == "şifre: EPOSTA_1" and rows[5]["report"][0]["kind"] == "password"
    back = restore(m.df, "masked", "id", m.mapping).orderBy("id").collect()
    assert [r["restored"] for r in back] == TEXTS
    assert [r["n_restored"] for r in back] == [3, None, 0, 4, 2, 1, 0, 2]


def test_documents_equal_a_dictionary(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    settings = Settings(("email", "credit_card", "phone", "person_name", "password"))
    got, mapping, m, _ = run(spark, texts, settings=settings)
    want, table = reference(texts, settings=settings)
    assert got == want and mapping == table and len(table) > 10
    assert [r["restored"] for r in restore(m.df, "masked", "id", m.mapping).orderBy("id").collect()] == texts


def test_numbers_resume_and_values_keep_their_first_kind(spark):
    known = [("EPOSTA_4", "old@x.org"), ("TCKN_1", "seen"), ("CUSTOM_9", "odd"), ("EPOSTA_x", "odd2")]
    mapping = M.from_pairs(spark.createDataFrame(known, "placeholder string, value string"))
    texts = ["old@x.org new@x.org seen", "10000000146"]
    settings = Settings(custom_words=("seen",))
    got, table, m, _ = run(spark, texts, mapping, settings)
    assert [g[0] for g in got] == ["EPOSTA_4 EPOSTA_5 TCKN_1", "TCKN_2"]
    assert got[0][1][2] == ("TCKN_1", "custom_word")
    again, _, second, _ = run(spark, [texts[0]], m.mapping, settings)
    assert again == got[:1] and second.fresh.count() == 0


def test_restore_is_lexical(spark):
    mapping = M.from_pairs(spark.createDataFrame([("TCKN_1", "10000000146")], "placeholder string, value string"))
    texts = ["TCKN_1 TCKN_01 TCKN_9 xTCKN_1 TCKN_1x TCKN_1, ÖTCKN_1 (TCKN_1)", "none", None, "$1 \\ TCKN_1"]
    df = frame(spark, texts)
    rows = restore(df, "text", "id", mapping).orderBy("id").collect()
    assert [r["restored"] for r in rows] == ["10000000146 TCKN_01 TCKN_9 xTCKN_1 TCKN_1x 10000000146, ÖTCKN_1 (10000000146)", "none", None, "$1 \\ 10000000146"]
    assert [r["n_restored"] for r in rows] == [3, 0, None, 1]
    twice = restore(restore(df, "text", "id", mapping).select("id", F.col("restored").alias("text")), "text", "id", mapping).orderBy("id").collect()
    assert [r["n_restored"] for r in twice] == [0, 0, None, 0]
    assert [r["restorable"] for r in has_restorable(df, "text", "id", mapping).orderBy("id").collect()] == [True, False, False, True]


def test_edit_replaces_exactly_one(spark):
    df = spark.createDataFrame([("satır\nsatır\n", "satır", "x"), ("a.b a+b", "a+b", "$0"), ("abc", "z", "y"), ("abc", "", "y"), ("aaa", "aa", "b")], "t string, old string, new string")
    got = [tuple(r["e"]) for r in df.select(edit(F.col("t"), F.col("old"), F.col("new")).alias("e")).collect()]
    assert got == [("ambiguous", 2, "satır\nsatır\n"), ("edited", 1, "a.b $0"), ("not found", 0, "abc"), ("empty", 0, "abc"), ("edited", 1, "ba")]


def test_mapping_file(spark, tmp_path):
    path = tmp_path / "deep" / "map.json"
    assert M.load_mapping(spark, str(path)).count() == 0
    pairs = [("TCKN_2", 'quote " and ş'), ("EPOSTA_1", "a@b.com")]
    M.save_mapping(M.from_pairs(spark.createDataFrame(pairs, "placeholder string, value string")), str(path))
    assert json.loads(path.read_text(encoding="utf-8")) == {"values": dict(pairs)}
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    assert {(r["placeholder"], r["value"], r["kind"], r["idx"]) for r in M.load_mapping(spark, str(path)).collect()} == {("TCKN_2", 'quote " and ş', "national_id", 2), ("EPOSTA_1", "a@b.com", "email", 1)}
    path.write_text("{ not json")
    with pytest.raises(Exception):
        M.load_mapping(spark, str(path)).collect()


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_saved_mapping_is_found_again_and_resumed(spark, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/new folder/map.json"
    settings = Settings(("email",))
    for texts, want in ((["a@b.com"], {"EPOSTA_1": "a@b.com"}), (["c@d.com a@b.com"], {"EPOSTA_1": "a@b.com", "EPOSTA_2": "c@d.com"})):
        m = mask(frame(spark, texts), "text", "id", settings=settings, mapping=M.load_mapping(spark, path))
        M.save_mapping(m.mapping, path)
        m.release()
        assert json.loads((tmp_path / "new folder" / "map.json").read_text(encoding="utf-8"))["values"] == want
    assert [p.name for p in (tmp_path / "new folder").iterdir()] == ["map.json"]  # nothing is left beside it
    (tmp_path / "new folder" / "map.json").write_text('{"values": {"EPOSTA_7": "by@hand.org"}}')
    assert [r["value"] for r in M.load_mapping(spark, path).collect()] == ["by@hand.org"]


def test_columns_of_the_input_stay(spark):
    mapping = M.from_pairs(spark.createDataFrame([("EPOSTA_1", "old@x.org")], "placeholder string, value string"))
    df = spark.createDataFrame([(1, "mail a@b.com", "k", 5, "m", "p", "r", 2, "s", "x")], "id int, text string, _key string, _hash int, Masked string, _pieces string, report string, n_masked int, summary string, `odd.name` string")
    m = mask(df, "text", "id", mapping=mapping)
    assert m.df.columns == [*df.columns, "masked_", "report_", "n_masked_", "summary_"]
    row = m.df.first()
    assert tuple(row)[:10] == tuple(df.first()) and row["masked_"] == "mail EPOSTA_2" and row["n_masked_"] == 1
    back = restore(m.df, "masked_", "id", m.mapping)
    assert back.columns == [*m.df.columns, "restored", "n_restored"] and back.first()["restored"] == "mail a@b.com"
    assert restore(back, "masked_", "id", m.mapping).columns[-2:] == ["restored_", "n_restored_"]
    assert has_restorable(back, "masked_", "id", m.mapping).first()["restorable"]


def test_missing_and_repeated_keys_leak_nothing(spark):
    rows = [(None, "a@b.com"), (None, "x c@d.com"), (1, "y e@f.org a@b.com"), (1, "e@f.org"), (1, "e@f.org"), (None, None), (2, "plain")]
    m = mask(spark.createDataFrame(rows, "id bigint, text string"), "text", "id", mapping=None)
    got = [(r["id"], r["masked"], r["n_masked"]) for r in m.df.collect()]
    assert len(got) == len(rows) and not any("@" in (t or "") for _, t, _ in got)
    back = restore(m.df.select("id", "masked"), "masked", "id", m.mapping).collect()
    assert sorted(((r["id"], r["restored"]) for r in back), key=str) == sorted(rows, key=str)
    assert has_restorable(m.df.select("id", "masked"), "masked", "id", m.mapping).filter("restorable").count() == 5


def test_edit_queries_report_every_row(spark, tmp_path):
    from veilframe.plans import catalog

    rows = [(1, 0, "user", "the e us"), (1, 1, "user", ""), (1, 2, "user", None), (2, 0, "", "abc")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {n: sorted(map(tuple, catalog.QUERIES[n](spark, str(tmp_path)).select("conv_id", "turn", "occurrences", "status", "edited").collect()), key=lambda r: r[:2]) for n in ("edit_unique", "edit_ambiguous", "edit_missing", "edit_by_role")}
    missing = [(c, t, 0, "not found", x) for c, t, _, x in rows]
    assert got["edit_missing"] == missing
    assert got["edit_unique"] == [(1, 0, 1, "edited", "EDITED"), (1, 1, 0, "empty", ""), missing[2], (2, 0, 1, "edited", "EDITED")]
    assert got["edit_ambiguous"] == [(1, 0, 2, "ambiguous", "the e us"), *missing[1:]]
    assert got["edit_by_role"] == [(1, 0, 1, "edited", "the e EDITED"), *missing[1:3], (2, 0, 0, "empty", "abc")]
