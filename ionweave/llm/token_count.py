"""Token counts of a unigram tokenizer without making tokens: Aho-Corasick matches and a count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a character, longest first;
dynamic programming keeps the best score up to each character and the pieces on that path. The
tokenizer's rules hold exactly: pieces compete in order of their start and only a strictly better
score replaces one, so ties go to the earlier start; a character that is no piece by itself costs
the vocabulary's least score less ten and counts its UTF-8 bytes (byte fallback).

White space is a space only, written as the vocabulary writes it, with one put before the text. No
piece has that sign behind another character (checked), so texts fall apart before each run of it
and equal parts are computed once. Scores are added in double precision. Null and empty texts have
no piece; whole texts are counted, row by row, also rows of equal id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import slices

SIGN, KEPT, UNKNOWN_PENALTY = "▁", 300_000, 10.0
_PART = re.compile(f"{SIGN}+[^{SIGN}]*|[^{SIGN}]+")


def read_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Normal and user-defined pieces and their scores, of a sentencepiece model file, in id order.

    Control, unknown, unused and byte pieces match no text.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    real = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
    return [(m.id_to_piece(i), m.get_score(i)) for i in real]


class Counter:
    """Best score and piece count of texts under one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        if any(re.search(f"[^{SIGN}]{SIGN}", p) for p, _ in vocabulary):
            raise ValueError("a piece goes on beyond white space")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[float, int]] = {}

    def part(self, s: str) -> tuple[float, int]:
        """(score, pieces) of the best path through ``s``."""
        n, at, top, count = len(s), 0, None, 0
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)

        def close(upto: int) -> None:
            """Settle the characters up to ``upto``, after their matches."""
            nonlocal at, top, count
            while at < upto:
                c = s[at]
                if c not in self.single:
                    score = scores[at] + self.unknown
                    if top is None or score > top:
                        top, count = score, counts[at] + len(c.encode("utf-8", "surrogatepass"))
                at += 1
                scores[at], counts[at], top = top, count, None

        for end, (length, score) in self.automaton.iter(s):
            if end > at:
                close(end)
            score += scores[end + 1 - length]
            if top is None or score > top:
                top, count = score, counts[end + 1 - length] + 1
        close(n)
        return scores[n], counts[n]

    def text(self, text: str | None) -> tuple[float, int]:
        """(score, pieces) of a whole text."""
        if not text:
            return 0.0, 0
        score, count, known = 0.0, 0, self.known
        for p in _PART.findall(SIGN + text.replace(" ", SIGN)):
            got = known.get(p)
            if got is None:
                got = self.part(p)
                if len(p) < 64:
                    if len(known) >= KEPT:
                        known.clear()
                    known[p] = got
            score += got[0]
            count += got[1]
        return score, count


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """``(doc_id, n_chars, n_tokens, score)`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_file))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for b in slices(batches, 1, 4000, 8_000_000):
            texts = b.column(1).to_pylist()
            got = [counter.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([c for _, c in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())], ["doc_id", "n_chars", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")
