import pytest

from veilframe.functions import python_detect
from veilframe.functions import validators as V
from veilframe.kinds import Settings, kind_from_name, split_placeholder
from veilframe.operators.detect import detect, matches
from pyspark.sql import functions as F

ALL = Settings(tuple(k for k in ("password", "national_id", "iban", "credit_card", "email", "phone", "person_name", "custom_word")))

#: Text -> (kind, value) pairs under the default settings.
VECTORS = {
    "kimlik 10000000146 ve 12345678901 var": [("national_id", "10000000146")],
    "kart 4111 1111 1111 1111 son": [("credit_card", "4111 1111 1111 1111")],
    "TR33 0006 1005 9786 4578 4132 26 · a.b@example.com · 0532 123 45 67": [("iban", "TR33 0006 1005 9786 4578 4132 26"), ("email", "a.b@example.com"), ("phone", "0532 123 45 67")],
    "password: Gtts@2020": [("password", "Gtts@2020")],
    "bu satırda hassas bir şey yok": [],
    "Ahmet Yılmaz geldi": [],
    "kullanici admin trX987&21": [("password", "trX987&21")],
    "User Name : admin01": [],
    "değer TCKN_1 ve EPOSTA_2": [],
    "253 5321234567": [],
    "10000000146 4111 1111 1111 1111": [("national_id", "10000000146")],
    "token-abc": [("password", "abc")],
    "sifre: password: Gtts@2020": [("password", "password:"), ("password", "Gtts@2020")],
    "x trX987&21.": [("password", "trX987&21.")],
    'password: "SIFRE_1"': [("password", '"SIFRE_1"')],
    "ŞIFRE: abc1": [("password", "abc1")],
    "ŞİFRE: abc1": [],
    "şıfre: abc1": [],
    "öpin: 1234": [],
    "+44 20 7946 0958 or +1 (743) 555-3824": [("phone", "+44 20 7946 0958")],
    "": [],
    "İstanbul’dan a.b@example.com adresine — şifre: Gtts@2020": [("email", "a.b@example.com"), ("password", "Gtts@2020")],
    "0532 123 45 670532 123 45 67": [],
    "SIFRE_1\n": [],
    "key = ١٢٣": [("password", "١٢٣")],
    "www.site1.com/a?b=1 http://x.y/z1?q ab12@": [("password", "//x.y/z1?q")],
}


def pairs(spark, texts, settings):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {i: [] for i in range(len(texts))}
    for r in matches(df, "t", ["i"], settings).orderBy("i", "pos").collect():
        out[r["i"]].append((r["start"], r["end"], r["kind"], r["value"]))
    return [out[i] for i in range(len(texts))]


def test_vectors(spark):
    texts = list(VECTORS)
    for t, got in zip(texts, pairs(spark, texts, None)):
        assert [(k, v) for _, _, k, v in got] == VECTORS[t], t
        assert got == python_detect.detect(t), t
        assert all(t[s:e] == v for s, e, _, v in got)


def test_custom_words_and_names(spark):
    words = Settings(custom_words=(" Acme Holding ", "acme", "", "i.x", "İzmir"))
    texts = ["acme holding raporu", "xACMEx", "I.X ı.x İ.x iax", "İZMİR izmir İzmir", "User Name : admin01"]
    got = [[v for *_, v in x] for x in pairs(spark, texts, words)]
    assert got == [["acme holding"], ["ACME"], ["I.X"], ["İzmir"], []]
    assert [[v for *_, v in python_detect.detect(t, words)] for t in texts] == got
    names = Settings(("person_name",))
    assert [[v for *_, v in x] for x in pairs(spark, ["Ahmet Yılmaz geldi", "Çağrı Öztürk Şahin Kaya"], names)] == [["Ahmet Yılmaz"], ["Çağrı Öztürk Şahin"]]
    # On an exact tie the earlier kind wins, so a custom word loses.
    assert pairs(spark, ["mail a.b@example.com"], Settings(custom_words=("a.b@example.com",)))[0][0][2] == "email"
    assert pairs(spark, ["abc"], Settings(())) == [[]]


def test_validators(spark):
    df = spark.createDataFrame([("10000000146",), ("12345678901",), ("00000000000",), ("4111 1111 1111 1111",), ("4111 1111 1111 1112",), ("",), ("TCKN_1",), ("TCKN_1\n",), ("TCKN_",), ("XX_1",), (None,)], "v string")
    got = df.select("v", V.luhn_valid(F.col("v")).alias("l"), V.tckn_valid(F.col("v")).alias("t"), V.is_placeholder(F.col("v")).alias("p"), V.digit_count(F.col("v")).alias("n")).collect()
    for r in got:
        if r["v"] is not None:
            assert (r["l"], r["t"], r["p"]) == (python_detect.luhn_valid(r["v"]), python_detect.tckn_valid(r["v"]), python_detect.is_placeholder(r["v"])), r["v"]
    assert [r["t"] for r in got[:2]] == [True, False] and [r["l"] for r in got[3:5]] == [True, False]


@pytest.mark.parametrize(("table", "column"), [("documents", "text"), ("pages", "html"), ("conversations", "text")])
def test_both_implementations_agree(spark, table, column):
    texts = [r[0] for r in spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select(column).collect()]
    settings = Settings(ALL.enabled, ("example", "the"))
    for t, got in zip(texts, pairs(spark, texts, settings)):
        assert got == python_detect.detect(t, settings)


def test_names_of_whole_texts_equal_plain_python(spark, tmp_path):
    import __spark_entry__ as entry

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-1, "Çağrı Öztürk geldi"), (-2, "x Çauxan Çauxan Çauxan, Enachsch Erachü"), (-3, "éAli Veli"), (-4, ""), (-5, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in entry.queries()["detect_person_name"](spark, str(tmp_path)).select("key", "start", "end", "value").collect()}
    assert got == {(k, s, e, v) for k, t in docs for s, e, _, v in python_detect.detect(t or "", Settings(("person_name",)))}
    assert {v for k, *_, v in got if k < 0} == {"Çağrı Öztürk", "Çauxan Çauxan Çauxan", "Enachsch Erachü"}


def test_null_text_and_configuration(spark):
    assert spark.createDataFrame([(None,)], "t string").select(detect(F.col("t"))).first()[0] is None
    assert [k.name if k else None for k in map(kind_from_name, ("TCKN", "credit-card", "garbage", " şifre "))] == ["national_id", "credit_card", None, "password"]
    assert split_placeholder("TCKN_12")[1] == 12 and split_placeholder("ACME_1") is None and split_placeholder("TCKN_x") is None
    env = {"VEILFRAME_WORDS": "a, b,", "VEILFRAME_DETECTORS": "nonsense"}
    assert Settings.from_env(env) == Settings(custom_words=("a", "b"))
    assert Settings.from_env({**env, "VEILFRAME_DETECTORS": "email,nonsense"}).enabled == ("email",)
