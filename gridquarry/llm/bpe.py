"""Byte-level BPE through a sentencepiece model made from the vocabulary.

Each token becomes a piece: its bytes as printable characters, scored by its
negative rank, so that sentencepiece merges in the order of the ranks. Nothing is
trained and nothing normalised. Texts are cut by the tokenizer's pattern, each
match is encoded by itself, and ids are decoded by the inverse of the mapping.

Regular expression engines differ in the characters that they know as letters and
numbers. So the classes of the pattern are written out, as the tokenizer's library
has them.
"""

from __future__ import annotations

import base64
import re
from functools import cache
from hashlib import sha256

import numpy as np
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from ._shared import ROW, map_rows, numbered

#: Pre-tokens remembered by a worker.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


@cache
def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


@cache
def members(kind: str) -> str:
    """The characters of a class as tiktoken knows it, as ranges for a set."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    ranges: list[list[int]] = []
    for c in map(ord, probe.decode(probe.encode_ordinary(every))):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@cache
def written_out(pattern: str) -> re.Pattern:
    r"""The pattern with its classes \p{..} and \s, in and out of sets, and \S, out of sets, as ranges."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part == "[" and not inside or part == "]" and inside:
            inside = not inside
        if part.startswith("\\p{") or part == "\\s":
            part = members(part) if inside else f"[{members(part)}]"
        elif part == "\\S" and not inside:
            part = rf"[^{members(chr(92) + 's')}]"
        out.append(part)
    return re.compile("".join(out))


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece k + 1 is the token of the k-th lowest rank."""
    char = byte_characters()
    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(ranks) + 1
    model.trainer_spec.unk_piece = "⁇"
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.precompiled_charsmap = b""
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    model.pieces.add(piece="⁇", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(char[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    return model.SerializeToString()


class Codec(dict):
    """Maps a pre-token to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.split = ranks, written_out(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.rank = np.array([0, *sorted(ranks.values())], "<u4")
        self.token = {rank: token for token, rank in ranks.items()}
        self.char = byte_characters()

    def __missing__(self, word: str) -> bytes:
        b = word.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(b)) is not None:  # a token as it stands, even if no merges lead to it
            ids = whole.to_bytes(4, "little")
        else:
            ids = self.rank[self.model.encode("".join(map(self.char.__getitem__, b)))].tobytes()
        if len(b) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """For each row of ``docs``: its row number, id, n_tokens, ids_sha256 and decoded_sha256, and the ids if asked for.

    ``path`` names a file of ranks that every worker can read. Null texts count
    as empty: no tokens. Text of special tokens is ordinary text. Ids may be null
    or repeat; an empty table gives no rows; other columns are not read, so their
    names may clash. A text of any length is encoded whole, pre-token by pre-token;
    of merges of equal rank the leftmost comes first, as in the tokenizer.
    """
    docs = numbered(docs, F.col(id).alias("id"), F.col(text).alias("text")).select(ROW, "id", "text")
    kind = f"{ROW} long, id {docs.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def rows(columns):
        number, ids, texts = columns
        tool = codec(path, pattern)
        out = [[], [], []] + [[]] * with_ids
        for t in texts:
            e = tool.encode(t or "")
            out[0].append(len(e) // 4)
            out[1].append(sha256(e).hexdigest())
            out[2].append(sha256(tool.decode(e)).hexdigest())
            if with_ids:
                out[3].append(np.frombuffer(e, "<i4"))
        return [number, ids, *out]

    return map_rows(docs, kind, rows).withColumnRenamed("id", id)
