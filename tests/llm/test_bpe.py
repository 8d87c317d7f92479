"""Byte-level BPE against tiktoken, and exact round trips."""

import os
import random

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken

from ledgerframe.llm import bpe

PATH = public.path("byte_bpe_50k.tiktoken")
DEFINITION = bpe.tokenizer_json(PATH, public.PATTERN)
EDGES = ["", " ", "\n", "  a", "a  ", "a \n b", "<|endoftext|>", "don't  I'll", "x" * 3000, "日本語 　\x85\xa0\x1c", "😀👍🏽", "²½१२"]


def texts():
    rng = random.Random(4)
    pools = ["ab c\n\t  'sd've ll I'm", "éßñ日本語 　\x85\xa0\x1c​", "0123456789 ²½१२", "😀👍🏽 .,!?-", "".join(chr(rng.randrange(1, 0x3000)) for _ in range(300))]
    return EDGES + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(80))) for _ in range(1500)]


def test_ids_equal_tiktoken_and_decode_back():
    exact = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    coder, table = bpe.SegmentEncoder(DEFINITION, limit=50), bpe.id_bytes(DEFINITION)
    for t, got in zip(texts(), coder.encode(texts())):
        assert np.frombuffer(got, "<u4").tolist() == exact.encode_ordinary(t)
        assert bpe.decode_bytes(got, table) == t.encode()
        assert "".join(bpe.decode_stream(np.frombuffer(got, "<u4").tolist(), table)) == t


def test_split_characters_come_out_whole():
    ids = np.frombuffer(bpe.SegmentEncoder(DEFINITION).encode(["👍🏽é"])[0], "<u4").tolist()
    pieces = list(bpe.decode_stream(ids, bpe.id_bytes(DEFINITION)))
    assert "".join(pieces) == "👍🏽é" and "�" not in "".join(pieces) and len(ids) > 2


def test_columns(spark):
    rows = [(1, "a b", "x"), (None, None, "y"), (1, "", "z"), (2, "é👍" * 2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(df, PATH, public.PATTERN).collect()
    assert len(got) == 4 and all(len(r.ids) == len(r.offsets) for r in got)
    assert next(r for r in got if r.ids and len(r.ids) < 5).offsets == [0, 1]
    back = bpe.decode(bpe.encode(df, PATH, public.PATTERN), PATH, public.PATTERN).collect()
    assert sorted(bytes(r.data).decode() for r in back) == sorted(t or "" for _, t, _ in rows)
    assert bpe.round_trip(df.limit(0), PATH, public.PATTERN).count() == 0


def test_an_encoder_that_failed_once_still_gives_right_ids(monkeypatch):
    coder = bpe.SegmentEncoder(DEFINITION)
    want = bpe.SegmentEncoder(DEFINITION).encode(["some words here", "words"])
    with monkeypatch.context() as broken:
        broken.setattr(coder, "_segment_ids", lambda segments: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            coder.encode(["some words"])
    assert coder.encode(["some words here", "words"]) == want


def test_an_encoder_uses_one_thread(monkeypatch):
    """A task has one core. Whoever sets the variable keeps what was set."""
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    bpe.SegmentEncoder(DEFINITION)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    bpe.SegmentEncoder(DEFINITION)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "true"


def test_remembered_segments_stay_bounded_and_ids_the_same():
    coder, plain = bpe.SegmentEncoder(DEFINITION, limit=20), bpe.SegmentEncoder(DEFINITION)
    rng = random.Random(8)
    for _ in range(60):
        texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(5)) for _ in range(2)]
        assert coder.encode(texts) == plain.encode(texts)
        assert len(coder.known) <= 20 and len(coder.known.old) <= 20 and not getattr(coder.known.old, "old", None)
