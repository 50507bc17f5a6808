"""Random texts from awkward pieces: the Column expressions against plain Python, and round trips."""

import random
import re

from hypothesis import assume, given
from hypothesis import settings as bounds
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import python_detect
from veilframe.kinds import Settings
from veilframe.operators.detect import matches
from veilframe.operators.mask import mask, restore
from veilframe.session import Session

PIECES = [
    "a.b@example.com", "@", "x@y.co", "10000000146", "4111 1111 1111 1111", "4111-1111-1111-1112", "TR33 0006 1005 9786 4578 4132 26", "0532 123 45 67", "+90 532 123 45 67", "+44 20 7946 0958", "532123", "password", "PIN", "şifre", "ŞİFRE",
    "token", ":", "=", "-", " - ", '"', "'", "trX987&21", "(Ab1!cd)", "www.a1b2!c", "http://x1.y/z?q", "TCKN_1", "EPOSTA_22", "SIFRE_", "Ahmet Yılmaz", "Çağrı", " ", "  ", "\n", "\t", "\xa0", " ", "😀", "é", "ß", "ı", "İ", ".", ",", "»", "_", "١٢٣", "7", "12", "ſ", "K", "acme", "ACME Holding", "\x85", "\x1c", "\\", "$1", "|",
]
SETTINGS = Settings(("password", "national_id", "iban", "credit_card", "email", "phone", "person_name", "custom_word"), ("acme holding", "acme", "i.x"))


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(n)]


def bounded(text):
    """Whether every match stands between characters that leave its placeholder a word of its own, as restoring asks."""
    word = lambda c: bool(re.match(r"\w", c))
    return "_" not in text and not any(word(text[max(0, s - 1):s]) or word(text[e:e + 1]) for s, e, _, _ in python_detect.detect(text, SETTINGS))


def test_both_implementations_agree(spark):
    made = texts(4000, 1)
    df = spark.createDataFrame(list(enumerate(made)), "i int, t string").repartition(4)
    got: dict[int, list] = {}
    for r in matches(df, "t", ["i"], SETTINGS).orderBy("i", "pos").collect():
        got.setdefault(r["i"], []).append((r["start"], r["end"], r["kind"], r["value"]))
    different = [(t, got.get(i, []), python_detect.detect(t, SETTINGS)) for i, t in enumerate(made) if got.get(i, []) != python_detect.detect(t, SETTINGS)]
    assert not different, different[:3]


def test_tables_and_sessions_mask_alike_and_restore(spark):
    made = [t for t in texts(1200, 2) if bounded(t)]
    df = spark.createDataFrame(list(enumerate(made)), "i int, t string")
    m = mask(df, "t", "i", settings=SETTINGS)
    session = Session(settings=SETTINGS)
    assert [r["masked"] for r in m.df.orderBy("i").collect()] == [session.mask(t)[0] for t in made]
    back = restore(m.df.select("i", "masked"), "masked", "i", m.mapping).orderBy("i")
    assert [r["restored"] for r in back.collect()] == made
    assert back.agg(F.count("*")).first()[0] == len(made)


@bounds(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([p for p in PIECES if "_" not in p]), max_size=12).map("".join))
def test_session_round_trip(text):
    session = Session(settings=SETTINGS)
    assume(bounded(text))
    masked, report = session.mask(text)
    assert session.restore(masked)[0] == text
    assert len(report) == len({p for p, _ in report}) and session.mask(text)[0] == masked
