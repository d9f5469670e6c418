"""Token counts by count-only Viterbi over a unigram vocabulary.

The pieces and scores of a sentencepiece vocabulary are read as a unigram model;
scores that only mark a piece as last resort become the next below the others. An
Aho-Corasick automaton enumerates the pieces that end at each character; for each
character the best score of a segmentation up to it and its number of pieces are
kept, nothing else. As in the tokenizer, of equally good segmentations the one
whose last piece is longest wins; a character that is no piece counts as the lowest
score less 10 and, with byte fallback, as many pieces as it has bytes, else with
all unknown characters beside it as one.

Apart from runs of the space mark, that mark only begins pieces, so no piece
crosses into the next run of marks: each such word is segmented by itself and
remembered. Sums are exact where the tokenizer's are (it adds 32-bit floats).
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from ._shared import ROW, map_rows, numbered

MARK, UNKNOWN_PENALTY, REMEMBERED = "▁", 10.0, 300_000


#: Scores below are marks, not scores.
SENTINEL = -1e8


def unigram_model(serialised: bytes) -> pb.ModelProto:
    """The vocabulary as a unigram model."""
    model = pb.ModelProto()
    model.ParseFromString(serialised)
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    lowest = min((p.score for p in model.pieces if p.score > SENTINEL), default=0.0)
    for p in model.pieces:
        if p.score <= SENTINEL:
            p.score = lowest - 1
    return model


class Counter(dict):
    """Maps a word to its number of pieces."""

    def __init__(self, model: pb.ModelProto):
        super().__init__()
        kinds = pb.ModelProto.SentencePiece
        pieces = [p for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        normal = [p.score for p in model.pieces if p.type == kinds.NORMAL]
        self.unknown = min(normal) - UNKNOWN_PENALTY
        self.fallback = model.trainer_spec.byte_fallback
        self.prefix = model.normalizer_spec.add_dummy_prefix
        whole = any(MARK in p.piece.lstrip(MARK) for p in pieces) or not self.fallback and all(p.piece != MARK for p in pieces)
        self.word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if not whole else ".+", re.S).findall
        self.automaton = ahocorasick.Automaton()
        most = max(0.0, *normal)
        for p in pieces:
            # pieces that the user defined are always taken: they score by their length, as the tokenizer has it
            self.automaton.add_word(p.piece, (len(p.piece), p.score if p.type == kinds.NORMAL else len(p.piece.encode()) * most - 0.1))
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        n = segmented(self.automaton, word, self.unknown, self.fallback)
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self) > REMEMBERED:
            self.clear()
        text = text.replace(" ", MARK)
        return sum(map(self.__getitem__, self.word(MARK + text if self.prefix else text)))


def segmented(automaton: ahocorasick.Automaton, word: str, unknown: float, fallback: bool) -> int:
    """Pieces in the best segmentation of ``word``; without byte fallback a run of unknown characters is one."""
    size = len(word)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(size)]
    for end, piece in automaton.iter(word):
        ending[end].append(piece)
    score, pieces, last_unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
    for end in range(1, size + 1):
        best, at, cost, single = None, 0, 0, False
        for length, gain in sorted(ending[end - 1], reverse=True):  # the earliest start first: it wins ties
            single |= length == 1
            if best is None or score[end - length] + gain > best:
                best, at, cost = score[end - length] + gain, end - length, 1
        if not single and (best is None or score[end - 1] + unknown > best):
            best, at, last_unknown[end] = score[end - 1] + unknown, end - 1, True
            cost = len(word[end - 1].encode("utf-8", "surrogatepass")) if fallback else 0 if last_unknown[end - 1] else 1
        score[end], pieces[end] = best, pieces[at] + cost
    return pieces[size]


@cache
def counter(path: str) -> Counter:
    with open(path, "rb") as f:
        return Counter(unigram_model(f.read()))


def token_counts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: its row number, id and n_tokens.

    ``path`` names a sentencepiece model with identity normalisation that every
    worker can read. Null and empty texts have no tokens. Ids may be null or
    repeat; an empty table gives no rows; other columns are not read. A text of any
    length is counted whole, a word at a time; of segmentations that score alike,
    that with the longest last piece counts.
    """
    docs = numbered(docs, F.col(id).alias("id"), F.col(text).alias("text")).select(ROW, "id", "text")
    kind = f"{ROW} long, id {docs.schema['id'].dataType.simpleString()}, n_tokens long"

    def rows(columns):
        tool = counter(path)
        return [columns[0], columns[1], [tool.count(t) for t in columns[2]]]

    return map_rows(docs, kind, rows).withColumnRenamed("id", id)
