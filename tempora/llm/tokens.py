"""Token counts: count-only Viterbi over a unigram vocabulary.

The pieces and scores come from a public tokenizer file (its path is a
parameter; the driver reads it and broadcasts the pieces, whose number is the
vocabulary's).  An Aho-Corasick automaton enumerates all pieces that end at
each position; dynamic programming carries the best score and the number of
pieces, and no path.  The tokenizer's rules are kept exactly: among equal
scores the piece that starts first (the longest) stays; a character that is
no piece of its own may be unknown at the lowest score less 10, which counts
one token per UTF-8 byte with byte fallback and else one per unknown run;
spaces are escaped, a text that is not empty begins with an escaped space, and
no other normalisation is applied.

With byte fallback, and if no piece has an escaped space after another character,
the best path of a text is the best paths of its words side by side, so words
are counted once and remembered (at most ``REMEMBERED`` at a time, a bound on memory, not on
the result).  Whole texts are counted where they lie: no shuffle.

Defined cases: null and empty texts have 0 tokens and score 0; repeated rows
count alike; an empty table gives no rows; extra columns are kept by
``with_counts`` (the new ones take fresh names) and not read by ``counts``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import bytewords as bw

UNKNOWN_PENALTY = 10.0
REMEMBERED = 300_000
SPACE = "▁"


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float]]
    byte_fallback: bool

    @property
    def unknown(self) -> float:
        return min((s for _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY


def load(path: str) -> Vocabulary:
    """Ordinary pieces and scores of a sentencepiece model file."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    plain = [i for i in ids if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
    return Vocabulary([(m.id_to_piece(i), m.get_score(i)) for i in plain], any(m.is_byte(i) for i in ids))


class Counter(dict):
    """word -> complex(pieces, score) of its best path, filled as words are met."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.fallback, self.unknown = vocabulary.byte_fallback, vocabulary.unknown
        self.automaton = ahocorasick.Automaton()
        pieces = [(p.replace(SPACE, " "), s) for p, s in vocabulary.pieces]
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        if pieces:
            self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        joined = {c for p, _ in pieces if len(p) > 1 for c in p}
        inside = any(" " in p.lstrip(" ") for p, _ in pieces)
        # a line break that is part of no longer piece is a cut as well
        cut = "" if "\n" in joined else "\n"
        # without byte fallback a run of unknown characters is one token, across words too
        self.split = None if inside or not self.fallback else re.compile(rf"{cut}+| *[^ {cut}]+| +" if cut else r" *[^ ]+| +")

    @staticmethod
    def bytes_of(character: str) -> int:
        return len((SPACE if character == " " else character).encode())

    def best(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path; the first start wins among equal scores."""
        n = len(word)
        score, count, run = [float("-inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        single, unknown = self.single, self.unknown
        at = 0

        def close(upto):
            for i in range(at, upto):
                if word[i] not in single and (x := score[i] + unknown) > score[i + 1]:
                    more = self.bytes_of(word[i]) if self.fallback else int(not run[i])
                    score[i + 1], count[i + 1], run[i + 1] = x, count[i] + more, True
        if len(self.automaton):
            for end, (size, s) in self.automaton.iter(word):   # by end, longest first
                if at < end:
                    close(end)
                    at = end
                start = end + 1 - size
                if (x := score[start] + s) > score[end + 1]:
                    score[end + 1], count[end + 1], run[end + 1] = x, count[start] + 1, False
        close(n)
        return count[n], score[n]

    def __missing__(self, word: str) -> complex:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = complex(*self.best(word))
        return value

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = " " + text.replace(SPACE, " ")
        if self.split is None:
            return self.best(text)
        total = sum(map(self.__getitem__, self.split.findall(text)), 0j)
        return int(total.real), total.imag


def with_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """All columns, the number of tokens and the best path's score; returns (table, names)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = bw.fresh(docs, "n_tokens"), bw.fresh(docs, "path_score")

    def make():
        counter = Counter(shared.value)

        def run(column):
            got = [counter.count(t.as_py()) for t in column]
            return [pa.array([c for c, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())]
        return run
    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.DoubleType())]
    return bw.append_columns(docs, text_col, fields, make), *names


def counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id, n_tokens, path_score``."""
    df, n, s = with_counts(docs.select(id_col, text_col), vocabulary, text_col)
    return df.select(F.col(id_col), F.col(n).alias("n_tokens"), F.col(s).alias("path_score"))
