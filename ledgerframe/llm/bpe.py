"""Byte-level BPE by a rank file, through the ``tokenizers`` library.

Rank files give a byte string for every id. Merges are rebuilt from them: a token of
several bytes is the merge of the two parts that lower-ranked merges leave of it. The library works on
characters, so bytes are mapped to printable characters by the usual byte-level table; decoding
maps ids back to their bytes, and a streaming decoder holds back the bytes of a character
that the next piece completes.

Invented and natural prose repeat their words, so each worker keeps the ids of short
space-delimited segments. A segment is an optional space and a run of characters other than
ASCII white space, or a run of white space; no match of the pattern crosses such a border.
Texts with other white space or control separators are encoded whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, process_cache

SEGMENT = r"[ \n\t\r\f\v]+(?![^ \n\t\r\f\v])| ?[^ \n\t\r\f\v]+|[ \n\t\r\f\v]+"
OTHER_SPACE = "[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]"


def byte_table() -> list[str]:
    """The printable character of each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge behind every token of several bytes, in rank order."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def tokenizer_json(path: str, pattern: str) -> str:
    """A tokenizers-library definition equal to the rank file with the given split pattern."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = load_ranks(path), byte_table()
    show = lambda b: "".join(table[x] for x in b)
    model = models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=[(show(a), show(b)) for a, b in merges_of(ranks)])
    tok = Tokenizer(model)
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok.to_str()


_segment, _other_space = re.compile(SEGMENT).findall, re.compile(OTHER_SPACE).search


def segments_with_space(text: str) -> list[str] | None:
    """Segments for byte-level patterns, where a space belongs to the word after it."""
    return None if _other_space(text) else _segment(text)


class _Known(dict):
    """Ids of segments. One that isn't here is taken from ``old``, or gets a place that is filled when its ids are found."""

    def __init__(self, old: dict):
        self.old, self.fresh = old, {}

    def __missing__(self, segment: str) -> bytes | bytearray:
        got = self.old.get(segment)
        if got is None:
            got = self.fresh[segment] = bytearray()
        self[segment] = got
        return got


class SegmentEncoder:
    """Encodes texts by a tokenizers definition, remembering the ids of short segments.

    ``split`` gives a text's segments, or None for a text that must be encoded whole. With ``added`` the definition's added tokens are
    found in texts, as the library's plain call does, and texts that hold one (in any case) are encoded whole; without, their strings are
    text like any other. ``limit`` bounds the remembered segments: past it the older half is let go, which costs
    time and never changes a result.

    Segments for which ``single`` holds must be one word of a tokenizer that drops white space and marks the ends of words by a suffix. They
    are encoded many at a time with spaces between and told apart by the ids that end words; if those don't number the segments,
    each goes by itself.
    """

    def __init__(self, definition: str, split: Callable[[str], list[str] | None] | None = None, limit: int = 400_000, added: bool = False, single: Callable[[str], bool] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would only cost time
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        self.tok.encode_special_tokens = not added
        strings = [t["content"] for t in json.loads(definition).get("added_tokens") or ()] if added else []
        holds, cut = re.compile("|".join(map(re.escape, strings)) or "(?!)", re.I).search, split or segments_with_space
        heads = {re.match(r"[^\w\s]*", t)[0] for t in strings}  # the same in any case, and found faster
        self.split = (lambda text: None if any(h in text for h in heads) and holds(text) else cut(text)) if strings else cut
        self.limit, self.known = limit, _Known({})
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        self.single = single if suffix else None
        if self.single:
            vocab = self.tok.get_vocab()
            self.ends = np.zeros(max(vocab.values(), default=-1) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def _segment_ids(self, segments: list[str], each: int = 32) -> list[bytes]:
        """Ids of segments, of single words many at a time."""
        if not self.single:
            return self._ids(segments)
        found: dict[str, bytes] = {}
        words = list(filter(self.single, segments))
        runs = [words[s : s + each] for s in range(0, len(words), each)]
        for run, e in zip(runs, self.tok.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stops = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
            if len(stops) == len(run) and stops[-1] == 4 * len(ids):
                data = ids.tobytes()
                found.update(zip(run, [data[a:b] for a, b in zip([0, *stops], stops)]))
        rest = [w for w in segments if w not in found]
        found.update(zip(rest, self._ids(rest)))
        return list(map(found.__getitem__, segments))

    def _ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = list(texts)
        parts = list(map(self.split, texts))
        known = self.known
        try:
            found = [p and list(map(known.__getitem__, p)) for p in parts]
            for (w, place), ids in zip(known.fresh.items(), self._segment_ids(list(known.fresh))):
                place += ids
                known[w] = ids
            rest = iter(self._ids([t for t, p in zip(texts, parts) if p is None]))
        except BaseException:
            self.known = _Known({})  # places that stayed empty must not be taken for ids
            raise
        out = [next(rest) if p is None else b"".join(p) for p in found]
        for w in known.fresh:
            if len(w) > 48:
                known.pop(w, None)
        known.fresh = {}
        if len(known) > self.limit // 2:
            known.old, self.known = {}, _Known(known)
        return out


def encoder(definition: str) -> SegmentEncoder:
    """The worker's encoder for this definition."""
    return process_cache(("segments", hashlib.sha256(definition.encode()).hexdigest()), lambda: SegmentEncoder(definition))


def id_bytes(definition: str) -> list[bytes]:
    """The bytes of every id, by reversing the byte table."""

    def build() -> list[bytes]:
        from tokenizers import Tokenizer

        back = {c: b for b, c in enumerate(byte_table())}
        vocab = Tokenizer.from_str(definition).get_vocab()
        out = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            out[i] = bytes(back[c] for c in token)
        return out

    return process_cache(("bytes", hashlib.sha256(definition.encode()).hexdigest()), build)


def decode_bytes(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_stream(ids: Iterable[int], table: list[bytes]) -> Iterator[str]:
    """Text piece by piece; a character split over tokens comes out with the token that completes it."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield decoder.decode(table[i])
    yield decoder.decode(b"", final=True)


def offsets_of(ids: bytes, table: list[bytes]) -> list[int]:
    """Byte offset of the start of every token."""
    sizes = [len(table[i]) for i in np.frombuffer(ids, "<u4").tolist()]
    return [0, *np.cumsum(sizes).tolist()[:-1]] if sizes else []


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", with_offsets: bool = True) -> DataFrame:
    """Ids and byte offsets of each whole text: id, ids array<int>, offsets array<long>.

    A null text counts as empty and gives empty arrays; ids may be null and repeat; the
    other columns of ``df`` are ignored; an empty table gives no rows.
    """
    definition = tokenizer_json(path, pattern)

    def run(cols: dict[str, list]) -> dict[str, list]:
        found, table = encoder(definition).encode(t or "" for t in cols["text"]), id_bytes(definition)
        return {"id": cols["id"], "ids": [np.frombuffer(x, "<u4").astype(np.int32).tolist() for x in found], "offsets": [offsets_of(x, table) if with_offsets else None for x in found]}

    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, "id long, ids array<int>, offsets array<long>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Bytes behind each array of ids: id, data binary. A null array counts as empty."""
    definition = tokenizer_json(path, pattern)

    def run(cols: dict[str, list]) -> dict[str, list]:
        table = id_bytes(definition)
        return {"id": cols["id"], "data": [b"".join(table[i] for i in x or ()) for x in cols["ids"]]}

    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, "id long, data binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and decode each whole text: id, n_tokens, digest of the ids, digest of the decoded bytes."""
    definition = tokenizer_json(path, pattern)

    def run(cols: dict[str, list]) -> dict[str, list]:
        found, table = encoder(definition).encode(t or "" for t in cols["text"]), id_bytes(definition)
        return {
            "id": cols["id"],
            "n_tokens": [len(x) // 4 for x in found],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in found],
            "decoded_sha256": [hashlib.sha256(decode_bytes(x, table)).hexdigest() for x in found],
        }

    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
