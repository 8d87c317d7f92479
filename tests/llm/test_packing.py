"""Packing: the plan's invariants, optimal counts on small cases, and every piece in its place."""

import itertools
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as public
from tokenizers import Tokenizer

from ledgerframe.llm import packing

PATH = public.path("word_bpe_49k.json")


def histogram(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


def bins_of(plan, counts, capacity):
    seen = np.zeros_like(counts)
    for pattern, m in plan:
        assert m > 0 and sum(pattern) <= capacity
        for x in pattern:
            seen[x] += m
    assert (seen == counts).all()
    return sum(m for _, m in plan)


def fewest(lengths, capacity):
    lengths = sorted(lengths, reverse=True)

    @lru_cache(None)
    def best(i, rooms):
        if i == len(lengths):
            return 0
        tries = [1 + best(i + 1, tuple(sorted((*rooms, capacity - lengths[i]))))]
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            tries.append(best(i + 1, tuple(sorted((*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :])))))
        return min(tries)

    return best(0, ())


def test_small_cases_are_optimal():
    rng = random.Random(6)
    for _ in range(60):
        lengths = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 10))]
        c = histogram(lengths, 20)
        n, low = bins_of(packing.bin_completion(c, 20), c, 20), packing.lower_bound(c, 20)
        assert low <= n == fewest(lengths, 20)


def test_search_improves_on_best_fit():
    lengths = [6, 6, 5, 5, 5, 4, 4, 3, 2] * 1
    c = histogram([*lengths, 7, 7, 3, 3], 10)
    assert bins_of(packing.bin_completion(c, 10), c, 10) <= bins_of(packing.best_fit_decreasing(c, 10), c, 10)


def test_large_histograms_stay_near_the_bound():
    rng = np.random.default_rng(8)
    c = histogram(np.minimum(2047, rng.gamma(2, 300, 20_000).astype(int) + 1), 2048)
    n = bins_of(packing.bin_completion(c, 2048, nodes=300), c, 2048)
    assert n <= 1.005 * packing.lower_bound(c, 2048)


def test_fillings_are_all_undominated_ones():
    """Against all multisets that fit: every one is covered by a filling given, and none given is covered by another one."""
    rng = random.Random(13)
    for _ in range(40):
        room, lengths = rng.randrange(8, 25), [rng.randrange(2, 12) for _ in range(rng.randrange(1, 9))]
        c = histogram([x for x in lengths if x <= room], max(room, 12))
        given = list(packing.completions(c, room))
        every = {tuple(sorted(s, reverse=True)) for n in range(1, len(lengths) + 1) for s in itertools.combinations(lengths, n) if sum(s) <= room}
        assert set(given) <= every | {()}
        assert all(any(packing._covers(g, f) for g in given) for f in every)
        assert not any(packing._covers(g, f) for i, f in enumerate(given) for g in given[:i])


def test_the_search_ends_by_itself_and_by_its_nodes():
    c = histogram([7, 7, 6, 6, 5, 5, 4, 4, 3, 3], 11)
    assert bins_of(packing.bin_completion(c, 11, nodes=10**6), c, 11) == fewest((7, 7, 6, 6, 5, 5, 4, 4, 3, 3), 11)
    wide = histogram(np.random.default_rng(1).integers(500, 1100, 3000), 2048)
    assert bins_of(packing.bin_completion(wide, 2048, nodes=50), wide, 2048) <= bins_of(packing.best_fit_decreasing(wide, 2048), wide, 2048)


def test_segments_equal_the_plain_call():
    rng = random.Random(9)
    pools = ["ab C\n\t  'sd've LL I'm", "éßÑñÀÿ×÷ª²½\x85\xa0\x1c", "019²½१२", "😀Σİ,!?-<|endoftext|>_", "".join(chr(rng.randrange(1, 0x250)) for _ in range(300))]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["", "ΑΣ Σ", "<|endoftext|> x"]
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", " "]
    texts += ["".join(rng.choice([*special, "a", "B c", "é", "\n"]) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    tok = Tokenizer.from_file(PATH)
    for added in (True, False):
        tok.encode_special_tokens = not added
        got = packing.SegmentEncoder(packing._tokenizer(PATH), packing.lower_words, limit=40, added=added).encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_every_piece_has_its_place(spark):
    rng = random.Random(10)
    rows = [(i % 50, " ".join(rng.choice(["alpha", "beta", "Γ", "x1"]) for _ in range(rng.randrange(40))), 7) for i in range(120)]
    rows += [(200, None, 1), (201, "", 1), (None, "alpha beta", 1), (202, "word " * 700, 1), (203, "a <|endoftext|> b<|startoftext|>", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    got = packing.pack(df, PATH, capacity=64, with_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    want = sorted(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0]) for _, t, _ in rows)
    docs, bins = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 64 * r.piece
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    whole = [tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got if r.piece == 0 and r.length < 64 and r.doc_id != 202]
    assert sorted(whole) == [w for w in want if len(w) < 64]
    long = sorted(docs[202], key=lambda r: r.piece)
    assert tuple(np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in long]).tolist()) == next(w for w in want if len(w) > 64)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_every_place_is_used_once_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(300)], "doc_id long, text string").repartition(7)
    whole = packing.pack(df, PATH, capacity=64).collect()
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 3)
    got = packing.pack(df, PATH, capacity=64).collect()
    assert sorted(r[:5] for r in map(tuple, got)) == sorted(r[:5] for r in map(tuple, whole))
    spots = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(spots, spots[1:])) and max(o + n for _, o, n in spots) <= 64
    assert len({r.sequence_id for r in got}) == len({r.sequence_id for r in whole})


def test_words_encoded_together_have_their_own_ids():
    rng = random.Random(11)
    alphabet = "abstvemld'''..,,!?-- \t\n\x1c\x85\xa0 09²½ÀéßþſŉĿAZ_<|>жΣ日́İ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4_000)] + ["x <|EndOfText|> y", "a<|startoftext|>b", ""]
    definition = packing._tokenizer(PATH)
    coder = packing.SegmentEncoder(definition, packing.lower_words, limit=2_000, added=True, single=packing.single_word)
    calls, plain = [], coder.tok.encode_batch_fast

    class Counted:
        encode_batch_fast = staticmethod(lambda given, **how: calls.append(len(given)) or plain(given, **how))

    coder.tok = Counted
    got = [ids for s in range(0, len(texts), 256) for ids in coder.encode(texts[s : s + 256])]
    want = Tokenizer.from_str(definition).encode_batch_fast(texts, add_special_tokens=False)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in want]
    calls.clear()
    coder.encode([" ".join("".join(rng.choice("abcde") for _ in range(8)) for _ in range(640))])
    assert sum(calls) <= 640 // 32 + 1
