r"""Chat formatting with typed content parts.

A message's content is a list of parts: text, image, audio, document. A visitor walks them
in order; text is escaped, any other part becomes a placeholder followed by its attachment
number, and the attachment is recorded with the tokens its placeholder expands to.

Template: a turn is ``<s>[INST role]`` + content + ``[/INST]</s>`` and turns follow one
another without separators. In roles and texts the characters ``\``, ``<``, ``[`` and ``]`` are preceded by
a backslash, so no text can form a control string, and removing the backslashes restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE, UNESCAPE = re.compile(r"[\\<\[\]]"), re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<s>\[INST ((?:[^\\\]]|\\.)*)\]((?:[^\\<\[]|\\.|<(?:image|audio|document) \d+>)*)\[/INST\]</s>", re.S)
PLACEHOLDER = re.compile(r"(?<!\\)((?:\\\\)*)<(image|audio|document) (\d+)>")


def escape(text: str) -> str:
    return ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


@dataclass
class PartVisitor:
    """Flattens typed parts; ``attachments`` gets (kind, reference, expanded tokens) in order of appearance."""

    image_tokens: int = 256
    audio_tokens_per_second: int = 25
    document_tokens_per_page: int = 512
    attachments: list[tuple[str, str, int]] = field(default_factory=list)

    def visit(self, part: dict | None) -> str:
        kind = (part or {}).get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown part type {kind!r}")
        return method(part or {})

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        return self._attach("image", part, self.image_tokens * max(1, int(part.get("tiles") or 1)))

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, max(1, round(float(part.get("seconds") or 0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, self.document_tokens_per_page * max(1, int(part.get("pages") or 1)))

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append((kind, part.get("ref") or "", tokens))
        return f"<{kind} {len(self.attachments) - 1}>"


def format_turn(role: str | None, parts: list[dict], visitor: PartVisitor) -> str:
    return f"<s>[INST {escape(role or '')}]{''.join(map(visitor.visit, parts))}[/INST]</s>"


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted string; placeholders stay in the text."""
    end = 0
    for m in TURN.finditer(formatted):
        if m.start() != end:
            break
        end = m.end()
        yield unescape(m[1]), unescape(m[2])
    if end != len(formatted):
        raise ValueError(f"no turn at character {end}")


PART = "struct<type:string,text:string,ref:string,tiles:int,seconds:double,pages:int>"


def format_messages(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """Format every turn: conv_id, turn, role, formatted, attachments, expanded_tokens.

    ``parts_col`` holds an array of parts (type, text, ref, tiles, seconds, pages). One row a
    turn, so a conversation of any length is spread over tasks; attachment numbers start at 0
    in each turn. A null list of parts, a null part and a null text count as empty text; a null role
    as ''. Extra columns are ignored.
    """
    cols = [F.col(c).alias(n) for c, n in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (parts_col, "parts"))]
    schema = "conv_id long, turn long, role string, formatted string, attachments array<struct<kind:string,ref:string,tokens:int>>, expanded_tokens long"
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            text, found = [], []
            for r in rows:
                v = PartVisitor()
                text.append(format_turn(r["role"], r["parts"] or [], v))
                found.append([dict(zip(("kind", "ref", "tokens"), a)) for a in v.attachments])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([r["turn"] for r in rows], pa.int64()), pa.array([r["role"] for r in rows], pa.string()), pa.array(text, pa.string()), pa.array(found, kinds), pa.array([sum(a["tokens"] for a in f) for f in found], pa.int64())],
                names=["conv_id", "turn", "role", "formatted", "attachments", "expanded_tokens"],
            )

    return df.select(*cols).mapInArrow(run, schema)


def _raw() -> Column:
    """The content of a formatted turn without escapes, by which turns of one place and role are ordered."""
    role = F.length(F.regexp_replace(F.coalesce("role", F.lit("")), r"[\\<\[\]]", r"\\$0"))
    before, after = F.lit(len("<s>[INST ]")) + role, len("[/INST]</s>")
    return F.regexp_replace(F.substr("formatted", before + 1, F.length("formatted") - before - after), r"(?s)\\(.)", "$1")


class _Digest:
    """Running digests of one conversation, as its formatted turns come by."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_roles: frozenset) -> None:
        self.chars += len(formatted)
        for role, text in parse_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role in loss_roles:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame, loss_roles=("assistant",)) -> DataFrame:
    """Parse formatted turns in order and digest each conversation and its loss mask.

    Takes the rows of ``format_messages``. A conversation's rows stream by in order of turn (then role,
    then text), so memory doesn't grow with its length: only running digests are held.
    A digest of ordered text can't be split, so one conversation is read by one task; the formatting
    before it is spread evenly.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    masked = frozenset(loss_roles)

    def run(batches):
        now, done = None, []
        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(text, masked)
            yield table(done)
            done = []
        if now is not None:
            yield table([now.row()])

    def table(rows):
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), _raw())
    return ordered.select("conv_id", "formatted").mapInArrow(run, schema)


def digest_conversations(df: DataFrame) -> DataFrame:
    """Format rows of (conv_id, turn, role, text) and read the result back, one row a conversation.

    Null texts count as empty, null roles as ''; rows without conv_id form one conversation
    with a null id; a null turn comes first; repeated rows are turns of their own.
    """
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tiles"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    return read_back(format_messages(df.select("conv_id", "turn", "role", F.array(part).alias("parts"))))
