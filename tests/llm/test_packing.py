import random
import zlib
from collections import Counter

import numpy as np
import pytest

from veilframe.llm import bpe, packing as P


def check(rows, expected_pieces, capacity=P.CAPACITY):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(expected_pieces)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def expected(texts, encode):
    out = []
    for doc, text in texts:
        ids = np.array([*encode(text or "").ids, 0], dtype="<u4")
        n = len(ids)
        first = n % P.CAPACITY or P.CAPACITY
        starts = [0, *range(first, n, P.CAPACITY)]
        out += [(doc, k, a, min(n, b) - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n]))]
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    return lambda text: tokenizer.encode(text, add_special_tokens=False)


def test_ids_equal_the_library(library):
    own = bpe.load(None)
    for text in ["", " ", "a b\n\n  c", "<|endoftext|> x", "été 😀​\x00", " \t" * 5000, "x" * 20_000, "'s've 12345 ٣٤ ___", "\r\n \xa0z"]:
        assert own.ids(text) == library(text).ids, text[:20]
    letters = [chr(c) for c in range(0x10FFFF) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(letters), 5000):
        text = "".join(f"a{c}1 {c}" for c in letters[i:i + 5000])
        assert own.ids(text) == library(text).ids, hex(ord(letters[i]))


def test_both_ways_to_tokenise_agree_across_their_border(library):
    own = bpe.load(None)
    base = "The quick brown fox, 42 étés 😀\n\n  and 'more' words___ here; "
    for n in (bpe.FAST_CHARS - 1, bpe.FAST_CHARS, bpe.FAST_CHARS + 1, 2 * bpe.FAST_CHARS):
        text = (base * (n // len(base) + 1))[:n]
        assert own.ids(text) == own.fast.encode_ordinary(text) == library(text).ids, n


def test_pieces_and_sequences(spark, library):
    texts = [(1, None), (2, ""), (None, "null id"), (3, "same"), (3, "same"), (4, "word " * 2047), (5, "word " * 2048), (6, "long text here " * 3000), *[(i, "some words " * (i % 97)) for i in range(10, 400)]]
    df = spark.createDataFrame([(d, t, 5) for d, t in texts], "doc_id bigint, text string, length int")
    n, least = check(P.best_fit_packing(df).collect(), expected(texts, library))
    assert n <= least + 1
    assert P.best_fit_packing(df.limit(0)).count() == 0


def test_documents(spark, library):
    d = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    n, least = check(P.op7(spark, d).collect(), expected(texts, library))
    assert n <= 1.03 * least + 1


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    spread = [lambda: rng.randint(1, 2048), lambda: rng.randint(600, 1100), lambda: rng.choice([683, 1024, 1365, 2048, 1]), lambda: min(2048, int(rng.expovariate(1 / 300)) + 1)][seed % 4]
    counts = Counter(spread() for _ in range(rng.choice([1, 50, 5000])))
    for groups in (1, 7, 64, 128):
        plan = P.Plan(counts, 2048, groups, 128)
        placed = Counter()
        for size, items in plan.classes:
            assert sum(n * k for n, k in items) <= 2048
            for n, k in items:
                placed[n] += size * k
        assert placed == counts


def test_groups_are_of_equal_cardinality_and_round_up():
    rng = random.Random(3)
    counts = Counter(rng.randint(128, 2047) for _ in range(6400))
    rounded = P.grouped(counts, 64)
    assert len(rounded) <= 64 and sum(rounded.values()) == 6400 and max(rounded.values()) <= 2 * 100
    real = sorted(counts.elements(), reverse=True)
    upper = sorted((n for n, c in rounded.items() for _ in range(c)), reverse=True)
    assert all(a >= b for a, b in zip(upper, real)) and sum(upper) > sum(real)


def test_configurations_reach_the_least_fraction():
    """Against the best fractional packing by hand, and never below the volume."""
    assert sum(x for x, _ in P.configurations({1000: 10}, 2048)) == pytest.approx(5)
    assert sum(x for x, _ in P.configurations({1500: 10, 500: 10}, 2048)) == pytest.approx(10)
    assert sum(x for x, _ in P.configurations({1025: 4, 1023: 4, 683: 3, 682: 3}, 2048)) == pytest.approx(4 + 2, abs=0.3)
    rng = random.Random(5)
    need = {n: rng.randint(20, 90) for n in rng.sample(range(128, 2048), 60)}
    found = P.configurations(need, 2048)
    assert all(sum(sizes) <= 2048 for _, sizes in found)
    for n, c in need.items():
        assert sum(x * sizes.count(n) for x, sizes in found) == pytest.approx(c)
    assert sum(x for x, _ in found) <= 1.02 * sum(n * c for n, c in need.items()) / 2048 + 1 or max(need) > 1024


@pytest.mark.parametrize("spread", [lambda r: r.randint(1, 2047), lambda r: min(2047, int(r.expovariate(1 / 500)) + 1)])
def test_most_pieces_take_the_places_of_rounded_ones(spread):
    rng = random.Random(8)
    counts = Counter(spread(rng) for _ in range(20_000))
    plan = P.Plan(counts, 2048)
    large = sum(c for n, c in counts.items() if n >= P.SMALL)
    assert any(n not in plan.rounded[0] for n in counts if n >= P.SMALL) and plan.substituted >= 0.9 * large
    assert plan.sequences <= 1.01 * sum(n * c for n, c in counts.items()) / 2048 + 1
