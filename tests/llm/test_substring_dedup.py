import random
import re

import numpy as np
import pytest

from veilframe.llm import substring_dedup as D

DOCS = "doc_id bigint, text string, g int, bucket string"


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    key = [D.NO_ID if d is None else d for d, _ in rows]
    for d, w in zip(key, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for (doc, _), d, w in zip(rows, key, words):
        gone = {i + j for i in range(len(w) - window + 1) if least[tuple(w[i:i + window])] < d for j in range(window)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed, letters, n=120):
    rng = random.Random(seed)
    base = [rng.choices([f"w{i}" for i in range(letters)], k=rng.choice([5, 13, 14, 40, 200])) for _ in range(n)]
    for _ in range(n):
        a = list(rng.choice(base))
        b = rng.choice(base)
        i, j = rng.randrange(len(b)), rng.randrange(len(a) + 1)
        base.append(a[:j] + b[i:i + rng.choice([3, 12, 13, 14, 30])] + a[j:rng.randrange(len(a) + 1)])
    texts = [rng.choice([" ", "\n", "  \t"]).join(x) for x in base]
    return [(i, t) for i, t in enumerate(texts)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 3, "clash") for r in rows], DOCS).repartition(3)
    return sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), r["kept_text"]) for r in D.substring_dedup(df, **options).collect()), key=str)


@pytest.mark.parametrize(("letters", "options"), [(2, {}), (3, {"rounds": 2, "phrase": 2}), (40, {}), (1000, {"rounds": 2, "phrase": 2}), (50, {"window": 30, "rounds": 3, "phrase": 6})])
def test_matches_brute_force(spark, letters, options):
    rows = corpus(letters, letters)
    rows += [(500, None), (501, ""), (None, rows[150][1]), (None, "only " * 30), (502, "run " * 40), (503, "x " + "run " * 13 + "y"), (503, rows[20][1]), (503, rows[20][1]), (504, "run " * 20_000), (505, "é😀 \xa0z " * 20), (506, "é😀 \xa0z " * 9)]
    assert run(spark, rows, **options) == brute(rows, options.get("window", 13))


def test_empty_table(spark):
    assert run(spark, [])== []


def test_interiors_are_consistent():
    """Every copy of a window has an anchor inside, and the same ones whatever surrounds it."""
    rng = random.Random(9)
    for rounds, phrase in ((1, 5), (2, 2)):
        for _ in range(300):
            window = [f"w{x}".encode() for x in rng.choices(range(rng.choice([2, 3, 30])), k=13)]
            seen = None
            for _ in range(3):
                left, right = ([f"w{x}".encode() for x in rng.choices(range(3), k=20)] for _ in range(2))
                group = D.Group([b" ".join(left + window + right)], [1])
                keys, a, b = group.anchors(13, rounds, phrase)
                inside = {int(k) for k, s, e in zip(keys, a, b) if s >= 20 and e <= 33}
                assert inside
                seen = inside if seen is None else seen & inside
            assert seen


def test_columns_survive_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        ids = rng.integers(0, 2**63, n)
        assert (D.unpack(D.pack(keys, True), True) == keys).all() and (D.unpack(D.pack(ids)).view(np.int64) == ids).all()


def test_names_tell_words_apart():
    rng = random.Random(6)
    words = [bytes(rng.choices(b"ab\xc3\xa9", k=rng.choice([1, 2, 9]))) for _ in range(500)] + [b"z" * 1500, b"z" * 1501, b"y" * (1 << 21)]
    texts = [b" \t".join(rng.choices(words[:500], k=50)) + b"\x0b" for _ in range(20)] + [None, b"", b"  ", b" ".join(words), words[-1] + b" " + words[0]]
    found, sizes = D.names(texts)
    flat = [w for t in texts for w in (t or b"").split()]
    assert sizes.tolist() == [len((t or b"").split()) for t in texts]
    assert len(set(zip(flat, found.tolist()))) == len(set(flat)) == len(set(found.tolist()))


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_made_to_collide_stay_apart(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    found, _ = D.names([a.encode(), b.encode()])
    assert found[0] != found[1]
    for n in (32, 64, 128):
        short = thue_morse(n)
        x, _ = D.names([short.encode(), short.translate(str.maketrans("ab", "ba")).encode()])
        assert x[0] != x[1]
    rows = [(1, " ".join([a, *"cdefghijklmn"])), (2, " ".join([b, *"cdefghijklmn"])), (3, " ".join([b, *"cdefghijklmn"]))]
    assert run(spark, rows) == brute(rows, 13)


def test_windows_whose_words_were_made_to_collide_stay_apart():
    words = thue_morse(1024)
    group = D.Group([" ".join(words).encode(), " ".join(words.translate(str.maketrans("ab", "ba"))).encode()], [1, 2])
    assert len(np.unique(group.named(1024)[group.windows(1024)])) == 2


@pytest.mark.parametrize("collide", [lambda n: n & np.uint64(0), lambda n: n & np.uint64(3)])
def test_no_word_is_removed_for_a_name_alone(monkeypatch, collide):
    """Names that collide on purpose: what is removed is still what the words say."""
    named = D.Group.named
    monkeypatch.setattr(D.Group, "named", lambda self, window: collide(named(self, window)))
    rows = corpus(5, 6, 25)
    texts = [t.encode() for _, t in rows]
    own = len(rows) - 10
    group = D.Group(texts, [i for i, _ in rows])
    got = group.covered(D.repeated(group, 13, own, texts), 13)
    want = {r[0]: r[2] for r in brute(rows, 13)}
    for (doc, _), a, b in zip(rows[:own], group.ends - group.sizes, group.ends):
        assert got[a:b].sum() == want[doc]


def test_runs_and_pairs_become_symbols_named_alike():
    text = b"q r s t t t t u v w x y z"
    other = b"k l m n o " + text + b" f g h"
    found = []
    for t in (text, other):
        group = D.Group([t], [1])
        words = t.split()
        names, a, b = group.symbols(1)
        assert a[0] == 0 and (a[1:] == b[:-1]).all() and b[-1] == len(words)
        none, ra, rb = group.symbols(0)
        assert [b"t"] * 4 in [words[x:y] for x, y in zip(ra, rb)] and len(none) == len(words) - 3
        found.append({b" ".join(words[x:y]): int(n) for n, x, y in zip(names, a, b)})
    inner = [k for k in found[0] if not k.startswith(b"q") and not k.startswith(b"r") and not k.endswith((b"y", b"z"))]
    assert inner and all(found[1][k] == found[0][k] for k in inner)


def test_stretches_cover_windows_only():
    assert D.stretches(np.array([3, 4, 9, 30, 43]), 13).tolist() == [[3, 22], [30, 43], [43, 56]]
    assert D.stretches(np.array([], dtype=np.int64), 13).tolist() == []
