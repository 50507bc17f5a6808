"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each position; dynamic programming carries the best score
and its number of pieces, no back pointers. Ties go as in the tokenizers: at a position the earliest start that reaches
the best score stays, so among equal scores the longest last piece wins.

White space is marked by U+2581, with one mark before the text. As long as no piece of the vocabulary has a mark after
another character (checked when it is loaded), the best path breaks before every such mark, and each stretch
"marks + other characters" is searched once and remembered within bounds. Otherwise whole texts are searched.

A character that no piece covers counts as unknown at the lowest score less 10; it is as many tokens as UTF-8 bytes when
the vocabulary has all byte pieces, else a run of them is one token, as the tokenizers fuse them.

Defined cases: null and empty texts have 0 tokens and score 0; repeated rows count alike; an empty table is empty.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.shared import chunks, documents, free_names, named

MARK = "▁"
UNKNOWN_PENALTY = 10.0
RESULT = "n_tokens bigint, score double"
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with scores. Fused unknowns and byte pieces as the tokenizers have them; special pieces stand for no text."""

    def __init__(self, pieces: list[tuple[str, float]], remembered: int = 400_000, special: frozenset[str] = frozenset()):
        import ahocorasick

        usable = {p: s for p, s in pieces if p and p not in special}
        self.byte_pieces = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in usable if len(p) == 1}
        self.breaks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in usable)
        self.automaton = ahocorasick.Automaton()
        for p, s in usable.items():
            self.automaton.add_word(p, (len(p), s))
        if usable:
            self.automaton.make_automaton()
        self.empty = not usable
        self.memory: dict[str, tuple[int, float]] = {}
        self.remembered = remembered

    def search(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best path through text.

        The automaton gives matches by their ends, longest first. A position is closed, with the step for an unknown
        character, before any match is tried that could start there.
        """
        n, nothing = len(text), float("-inf")
        score, count, open_unknown = [0.0] + [nothing] * n, [0] * (n + 1), bytearray(n + 1)
        covered = self.single.issuperset(text)  # then every step has a piece of its own
        closed = 0

        def close(until: int) -> None:
            for p in range(closed + 1, until + 1):
                c = text[p - 1]
                if c not in self.single and score[p - 1] + self.unknown > score[p]:
                    score[p] = score[p - 1] + self.unknown
                    count[p] = count[p - 1] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_pieces else not open_unknown[p - 1])
                    open_unknown[p] = 1

        for last, (length, s) in self.automaton.iter(text) if not self.empty else ():
            if not covered and last > closed:
                close(last)
                closed = last
            end = last + 1
            value = score[end - length] + s
            if value > score[end]:
                score[end], count[end] = value, count[end - length] + 1
        if not covered:
            close(n)
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        if not self.breaks or not self.byte_pieces:  # fused unknowns may cross a break
            return self.search(marked)
        tokens, total, memory = 0, 0.0, self.memory
        for part in _STRETCH.findall(marked):
            known = memory.get(part)
            if known is None:
                known = self.search(part)
                if len(part) <= 64:
                    if len(memory) >= self.remembered:
                        memory.clear()
                    memory[part] = known
            tokens += known[0]
            total += known[1]
        return tokens, total


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def read_pieces(path: str) -> list[tuple[str, float]]:
    model = _model(path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def special_pieces(path: str) -> frozenset[str]:
    """Those the model marks as control, unknown or byte, however they are spelled."""
    model = _model(path)
    return frozenset(model.id_to_piece(i) for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i))


@lru_cache(maxsize=2)
def load(path: str | None) -> Vocabulary:
    """One instance for each Python worker."""
    path = path or default_path()
    return Vocabulary(read_pieces(path), special=special_pieces(path))


def token_counts(df: DataFrame, text_col: str = "text", keep_cols: list[str] | None = None, vocabulary_path: str | None = None) -> DataFrame:
    """keep_cols (default: all) and the struct _tokens of count and score of the best path."""
    cols = keep_cols if keep_cols is not None else df.columns
    plain = df.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(cols)], named(text_col).alias("_text"))
    struct = pa.struct([("n_tokens", pa.int64()), ("score", pa.float64())])

    def count(batches):
        vocabulary = load(vocabulary_path)
        for batch in batches:
            for part in chunks(batch, "_text"):
                found = [dict(zip(("n_tokens", "score"), vocabulary.count(t.as_py()), strict=True)) for t in part.column("_text")]
                yield part.select([c for c in part.schema.names if c != "_text"]).append_column("_tokens", pa.array(found, type=struct))

    out = plain.mapInArrow(count, T.StructType([*plain.drop("_text").schema, T.StructField("_tokens", T.StructType.fromDDL(RESULT))]))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], F.col("_tokens").alias(*free_names(cols, "_tokens")))


def op10(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), keep_cols=["doc_id"]).select("doc_id", "_tokens.*")
