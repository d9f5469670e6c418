import base64
import random
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
import tiktoken
from sentencepiece import sentencepiece_model_pb2 as pb

from gridquarry.llm import bpe, viterbi
from gridquarry.llm.queries import MULTI_RANKS, PATTERN, PIECES

from .conftest import ODD, random_text


@pytest.fixture(scope="module")
def encoding():
    with open(MULTI_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query_agrees_with_tiktoken(frame, corpus, encoding):
    got = bpe.encoded(frame(corpus), MULTI_RANKS, PATTERN, with_ids=True).collect()
    texts = sorted((t or "" for _, t, *_ in corpus))
    assert sorted(encoding.decode(r["ids"]) for r in got) == texts
    for r in got:
        text = encoding.decode(r["ids"])
        ids = encoding.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha256(text.encode()).hexdigest()
    assert bpe.encoded(frame([]), MULTI_RANKS, PATTERN).count() == 0


def test_every_character_alone_and_between(encoding):
    tool = bpe.codec(MULTI_RANKS, PATTERN)
    for at in range(0, 0x110000, 0x800):
        some = [chr(c) for c in range(at, at + 0x800) if not 0xD800 <= c < 0xE000]
        for joint in ("a", " ", "1"):
            text = joint.join(some)
            assert np.frombuffer(tool.encode(text), "<u4").tolist() == encoding.encode_ordinary(text), hex(at)


def test_odd_strings(encoding):
    tool, rng = bpe.codec(MULTI_RANKS, PATTERN), random.Random(9)
    alphabet = "ab 's\n\t  12é中🙂_-!% ſ'LL<|endoftext|>"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        e = tool.encode(text)
        assert np.frombuffer(e, "<u4").tolist() == encoding.encode_ordinary(text)
        assert tool.decode(e) == text.encode()


def test_all_tokens_round_trip():
    tool = bpe.codec(MULTI_RANKS, PATTERN)
    ids = np.array(sorted(tool.token), "<u4")
    assert tool.decode(ids.tobytes()) == b"".join(tool.token[i] for i in ids.tolist())
    assert all(len(tool[t.decode()]) == 4 for t in list(tool.token.values())[:3000] if t.decode("utf-8", "replace") == t.decode("utf-8", "ignore"))


@pytest.fixture(scope="module")
def unigram():
    """The library's own unigram tokenizer over the same vocabulary."""
    with open(PIECES, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_proto=viterbi.unigram_model(f.read()).SerializeToString())


def test_counts_agree_with_the_library(unigram):
    tool, rng = viterbi.counter(PIECES), random.Random(4)
    texts = [t or "" for t in ODD if len(t or "") < 2000] + [random_text(rng, rng.randint(1, 40)) for _ in range(300)]
    texts += ["".join(rng.choice("ab  ▁\néß中🙂0") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    for text in texts:
        assert tool.count(text) == len(unigram.encode(text)), text


def test_long_texts_agree_with_the_library(unigram, spark, sf_dir):
    """The library adds 32-bit floats, so long texts might differ; of those in the tables none does."""
    tool = viterbi.counter(PIECES)
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert max(map(len, texts)) > 10_000
    assert [t for t in texts if tool.count(t) != len(unigram.encode(t))] == []


def small_model(pieces, fallback, user):
    model = pb.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = pb.TrainerSpec.UNIGRAM, fallback
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    kinds = pb.ModelProto.SentencePiece
    for piece, score, kind in [("<unk>", 0, kinds.UNKNOWN), ("<s>", 0, kinds.CONTROL), ("</s>", 0, kinds.CONTROL), *((f"<0x{b:02X}>", 0, kinds.BYTE) for b in range(256 * fallback)), *((u, 0, kinds.USER_DEFINED) for u in user), *((p, s, kinds.NORMAL) for p, s in pieces.items())]:
        model.pieces.add(piece=piece, score=score, type=kind)
    return model


@pytest.mark.parametrize("fallback", [False, True])
def test_small_vocabularies_agree_with_the_library(fallback):
    """Ties, unknown runs, marks that are no piece or lie within pieces, and pieces that the user defined."""
    rng = random.Random(8)
    for trial in range(150):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))): -rng.randint(1, 40) / 4 for _ in range(rng.randint(2, 14))}
        user = {"".join(rng.choice("abcx") for _ in range(rng.randint(1, 3))) for _ in range(2 * (trial % 3 == 0))} - set(pieces)
        model = small_model(pieces, fallback, sorted(user))
        library, tool = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), viterbi.Counter(model)
        for _ in range(40):
            text = "".join(rng.choice("aabbccx🙂é \n") for _ in range(rng.randint(0, 12)))
            assert tool.count(text) == len(library.encode(text)), (text, pieces, user)


def test_count_query(frame, corpus):
    tool = viterbi.counter(PIECES)
    got = viterbi.token_counts(frame(corpus), PIECES).drop("__row").collect()
    assert sorted((r[0] or -1, r[1]) for r in got) == sorted((i or -1, tool.count(t or "")) for i, t, *_ in corpus)
    assert viterbi.token_counts(frame([]), PIECES).count() == 0
