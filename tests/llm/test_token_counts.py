import random

from tokenizers import Tokenizer, models

from veilframe.llm import token_counts as C

TEXTS = ["", " ", "a", "the cat  sat", "   lead and trail  ", "été 😀 ñ\n\n\ttab", "▁marks▁ here", "x" * 300, "日本語 text", "\x00\x7f", "Thntblere of then, edtioner in inea", "0123 4567,8.9"]


def library(pieces, byte_fallback):
    unk = next((i for i, (p, _) in enumerate(pieces) if p == "<unk>"), None)
    return Tokenizer(models.Unigram(pieces, unk_id=unk, byte_fallback=byte_fallback))


def expected(tokenizer, text):
    return len(tokenizer.encode(C.MARK + text.replace(" ", C.MARK), add_special_tokens=False).ids) if text else 0


def test_counts_equal_the_library_on_the_public_vocabulary():
    pieces = C.read_pieces(C.default_path())
    vocabulary, tokenizer = C.load(None), library(pieces, True)
    assert vocabulary.breaks and vocabulary.byte_pieces
    for text in TEXTS:
        assert vocabulary.count(text)[0] == expected(tokenizer, text), text
        assert vocabulary.count(text)[0] == (vocabulary.search(C.MARK + text.replace(" ", C.MARK))[0] if text else 0)


def test_ordinary_pieces_in_angle_brackets_count():
    pieces = C.read_pieces(C.default_path())
    vocabulary, tokenizer, scores = C.load(None), library(pieces, True), dict(pieces)
    for text in ["List<>", "Class<?>", "where a<>b", "new ArrayList<>()", "<>", "<?>", "a <?> b <> c<>"]:
        encoded = tokenizer.encode(C.MARK + text.replace(" ", C.MARK), add_special_tokens=False)
        assert vocabulary.count(text) == (len(encoded.ids), sum(scores[t] for t in encoded.tokens)), text
    assert C.special_pieces(C.default_path()) == {"<unk>", "<s>", "</s>"} | {f"<0x{b:02X}>" for b in range(256)}
    assert vocabulary.count("<s>")[0] > 1  # a control piece stands for no text


def test_ties_and_unknowns_equal_the_library():
    rng = random.Random(3)
    for trial in range(60):
        pieces = [("<unk>", 0.0)] + [(x, float(-rng.randint(1, 4))) for x in sorted({"".join(rng.choices("ab" + C.MARK, k=rng.randint(1, 4))) for _ in range(12)})]
        vocabulary, tokenizer = C.Vocabulary(pieces), library(pieces, False)
        for _ in range(20):
            text = "".join(rng.choices("aabbc ", k=rng.randint(1, 25)))
            assert vocabulary.count(text)[0] == expected(tokenizer, text), (trial, pieces, text)


def test_documents_and_defined_cases(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, "word " * 60_000, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _tokens string")
    tokenizer = library(C.read_pieces(C.default_path()), True)
    got = {r["doc_id"]: r["_tokens"]["n_tokens"] for r in C.token_counts(df, keep_cols=["doc_id"]).collect()}
    assert got == {i: expected(tokenizer, t or "") for i, t, _ in rows}
    assert C.token_counts(df.limit(0)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    whole = {r["doc_id"]: r["n_tokens"] for r in C.op10(spark, "/root/testdata/sf0.001").collect()}
    assert all(whole[r["doc_id"]] == expected(tokenizer, r["text"]) for r in docs)
