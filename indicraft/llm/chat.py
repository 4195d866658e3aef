"""Chat formatting on token level.

Every segment of a conversation is encoded by itself: control tokens are reserved ids that no text
can produce, and the ids of all segments are spliced end to end. The loss mask is +1 where a segment under
loss begins and -1 where it ends, summed from the left. So that the text form is safe too, control
strings inside texts are escaped: a backslash goes in after the first bracket, and one more where there already are
some, so removing one backslash restores any text.

Template, per turn: `[TURN]role[TEXT]text[END]`, a conversation between `<s>` and `</s>`; the usual
roles have a control string of their own (`[SYS]`, `[INST]`, `[ANSWER]`) in place of `[TURN]role[TEXT]`.

A conversation streams through one task in order of its turns: its digests are sequential by nature. Only the running
state is held, and token chunks leave turn by turn; encoding happens before the shuffle, wherever the turns are. The shuffle
carries a turn's ids in two bytes each and the two edges of its run under loss, not its text.

Defined cases: null text is empty, a null role is told apart from an empty one; ties in `turn` are ordered by role, then by
the first 40 code points of the text, then by its ids, so repeated rows stand side by side and all count; null turns come
first; a null conv_id is a conversation; texts of any length are encoded whole; an empty table gives no rows; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, map_texts, steps, text_or_empty
from .token_files import UnitCoder

#: Control strings and their place above the vocabulary.
CONTROLS = ("<s>", "</s>", "[SYS]", "[INST]", "[ANSWER]", "[TURN]", "[NULL]", "[TEXT]", "[END]", "[/INST]", "[/SYS]")
ROLES = {"system": "[SYS]", "user": "[INST]", "assistant": "[ANSWER]"}
_BODIES = "|".join(re.escape(c[1:]) for c in CONTROLS)
CONTROL = re.compile(r"([<\[])(" + _BODIES + ")")
ESCAPE = re.compile(r"([<\[])(\\*)(" + _BODIES + ")")
HOLDS_CONTROL = r"[<\[]\\*(?:" + _BODIES + ")"
UNESCAPE = re.compile(r"([<\[])\\(\\*)(" + _BODIES + ")")


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text) if "\\" in text else text


def escape_all(texts: pa.Array) -> pa.Array:
    """`escape` of every text; only those that hold a control string are rebuilt."""
    hit = pc.match_substring_regex(texts, HOLDS_CONTROL)
    if not pc.any(hit).as_py():
        return texts
    return pa.array([escape(t) if h else t for t, h in zip(texts.to_pylist(), hit.to_pylist())], pa.large_string())


class Coder:
    """Byte-level BPE ids of text segments, reserved ids of control strings, and back to bytes."""

    def __init__(self, path: str):
        self.units = UnitCoder(path)
        tokenizer = self.units.tokenizer
        size = tokenizer.get_vocab_size()
        # the printable stand-ins of bytes in byte-level vocabularies
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        stand_in = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        pieces = [b""] * size
        for token, i in tokenizer.get_vocab().items():
            pieces[i] = bytes(stand_in[c] for c in token) if all(c in stand_in for c in token) else token.encode()
        self.control = {c: size + k for k, c in enumerate(CONTROLS)}
        self.pieces = pa.array(pieces + [c.encode() for c in CONTROLS], pa.large_binary())
        self.first_control = size
        self.kind = np.uint16 if size + len(CONTROLS) <= 1 << 16 else np.uint32
        self.width = np.dtype(self.kind).itemsize
        self.control_bytes = {c: np.array([i], self.kind).tobytes() for c, i in self.control.items()}
        self.roles: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, end to end in `kind`."""
        ids = self.units.encode(texts)
        return ids if self.kind == self.units.kind else [np.frombuffer(i, self.units.kind).astype(self.kind).tobytes() for i in ids]

    def role_ids(self, role: str) -> bytes:
        if role not in self.roles:
            if len(self.roles) >= 1_024:
                self.roles.clear()
            self.roles[role] = self.encode(pa.array([escape(role)], pa.large_string()))[0]
        return self.roles[role]

    def spelled(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids end to end, and where each id's begin, with the end of the last."""
        out = self.pieces.take(pa.array(ids.astype(np.int32)))
        ends = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1, out.offset * 8)
        return memoryview(out.buffers()[2] or b""), ends

    def decode(self, ids) -> str:
        return bytes(self.spelled(np.asarray(ids, dtype=np.int64))[0]).decode()


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def splice(segments: list[tuple[bytes, bool]], width: int) -> tuple[bytes, int, int]:
    """Ids of all segments end to end, and the edges (first, one past the last) of the run of segments under loss; (0, 0) without one."""
    at, first, last = 0, 0, 0
    for ids, learn in segments:
        stop = at + len(ids) // width
        if learn and stop > at:
            first, last = (first if last else at), stop
        at = stop
    return b"".join([ids for ids, _ in segments]), first, last


def mask_of(sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The loss mask of turns that stand end to end: +1 at every first edge, -1 at every last one, summed from the left."""
    begins = np.cumsum(sizes) - sizes
    edge = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(edge, begins + first, 1)
    np.add.at(edge, begins + last, -1)
    return np.cumsum(edge[:-1]).astype(np.int8)


def turn_tokens(c: Coder, role: str | None, text_ids: bytes, loss_role: str, loss_on_end: bool) -> tuple[bytes, int, int]:
    """One turn's ids and edges of its run under loss; `text_ids` encode the escaped text."""
    control, learn = c.control_bytes, role == loss_role
    if role in ROLES:
        head = [(control[ROLES[role]], False)]
    else:
        head = [(control["[TURN]"], False), (control["[NULL]"] if role is None else c.role_ids(role), False), (control["[TEXT]"], False)]
    return splice([*head, (text_ids, learn), (control["[END]"], learn and loss_on_end)], c.width)


#: Columns of turns in token form; `tokens` holds ids of two or four little-endian bytes each.
TURNS = ("conv_id", "turn", "role", "opening", "tokens", "loss_first", "loss_last")
OPENING_CHARS = 40


def format_turns(turns: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 loss_role: str = "assistant", loss_on_end: bool = False) -> DataFrame:
    """(conv_id, turn, role, opening, tokens, loss_first, loss_last): the tokens of every turn and its run under loss, without a shuffle."""
    turns.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]
    opening = F.substring(text_or_empty(text), 1, OPENING_CHARS).alias("opening")
    slim = turns.select(col(conv).cast("long").alias("conv_id"), col(turn).cast("long").alias("turn"), col(role).cast("string").alias("role"), opening, text_or_empty(text).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        c = coder(SparkFiles.get(name))
        texts = c.encode(escape_all(batch.column(4).cast(pa.large_string())))
        parts = [turn_tokens(c, r, t, loss_role, loss_on_end) for r, t in zip(batch.column(2).to_pylist(), texts)]
        return {"tokens": [p[0] for p in parts], "loss_first": [p[1] for p in parts], "loss_last": [p[2] for p in parts]}

    add = T.StructType([T.StructField("tokens", T.BinaryType()), T.StructField("loss_first", T.LongType()), T.StructField("loss_last", T.LongType())])
    return map_texts(slim, run, add, "text").select(*TURNS)


def ordered(turns: DataFrame) -> DataFrame:
    """Conversations whole in a partition and in order."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "opening", "tokens")]
    return turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "tokens", "loss_first", "loss_last")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in steps(batch.column(1)):
            yield batch.slice(start, stop - start)


def _tokens(c: Coder, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all turns end to end, ids per turn, loss mask)."""
    blobs = rows.column(1).to_pylist()
    sizes = np.array([len(b) // c.width for b in blobs], dtype=np.int64)
    return np.frombuffer(b"".join(blobs), c.kind), sizes, mask_of(sizes, rows.column(2).to_numpy(), rows.column(3).to_numpy())


def assemble(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, token_ids, loss_mask) of whole conversations, for those that fit into a row.

    `turns` comes from `format_turns`. Longer ones can be written turn by turn from `ordered`.
    """
    name = tokenizer.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(SparkFiles.get(name))
        conv, ids, mask = None, [], []

        def row():
            spliced = np.concatenate([[c.control["<s>"]], *ids, [c.control["</s>"]]]).astype(np.int32)
            learn = np.concatenate([[0], *mask, [0]]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([spliced], pa.list_(pa.int32())), pa.array([learn], pa.list_(pa.int32()))], names=["conv_id", "token_ids", "loss_mask"])

        for rows in _slices(batches):
            tokens, sizes, learn = _tokens(c, rows)
            stop = np.cumsum(sizes)
            for cid, a, b in zip(rows.column(0).to_pylist(), (stop - sizes).tolist(), stop.tolist()):
                if ids and cid != conv:
                    yield row()
                    ids, mask = [], []
                conv = cid
                ids.append(tokens[a:b])
                mask.append(learn[a:b])
        if ids:
            yield row()

    return ordered(turns).mapInArrow(run, "conv_id long, token_ids array<int>, loss_mask array<int>")


def read_turns(c: Coder, rows: pa.RecordBatch) -> Iterator[tuple[str | None, str, str, int, int, int]]:
    """(role, text, text under loss, characters with control strings, tokens, tokens under loss) of every turn, read back from its tokens and mask."""
    ids, sizes, mask = _tokens(c, rows)
    spelled, places = c.spelled(ids)
    kept = (mask == 1) & (ids < c.first_control)
    learned, learned_places = c.spelled(ids[kept])
    stop = np.cumsum(sizes)
    under, kept_upto = np.append(0, np.cumsum(mask, dtype=np.int64)), np.append(0, np.cumsum(kept))
    names = {c.control[v]: k for k, v in ROLES.items()}
    end = len("[END]")
    for a, b in zip((stop - sizes).tolist(), stop.tolist()):
        first = int(ids[a])
        if first in names:
            role, body = names[first], a + 1
        else:
            body = a + 1 + int(np.flatnonzero(ids[a:b] == c.control["[TEXT]"])[0])
            role = None if ids[a + 1] == c.control["[NULL]"] else unescape(bytes(spelled[places[a + 1] : places[body - 1]]).decode())
        head = bytes(spelled[places[a] : places[body]]).decode()
        rest = bytes(spelled[places[body] : places[b]]).decode()
        loss = bytes(learned[learned_places[kept_upto[a]] : learned_places[kept_upto[b]]]).decode()
        yield role, unescape(rest[:-end]), unescape(loss), len(head) + len(rest), b - a, int(under[b] - under[a])


def digests(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation: turns, digests of all text and of the text under loss, and formatted length.

    All read back from the tokens of `format_turns`, turn by turn, with running digests.
    """
    name = tokenizer.rsplit("/", 1)[-1]
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(SparkFiles.get(name))
        state = None

        def close(s: dict) -> dict:
            return s | {"turns_sha256": s["turns_sha256"].hexdigest(), "loss_sha256": s["loss_sha256"].hexdigest()}

        for rows in _slices(batches):
            done = []
            for conv, (role, text, learned, chars, n, n_loss) in zip(rows.column(0).to_pylist(), read_turns(c, rows)):
                if state is None or conv != state["conv_id"]:
                    if state is not None:
                        done.append(close(state))
                    edges = len("<s>") + len("</s>")
                    state = {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": edges, "n_tokens": 2, "loss_tokens": 0}
                state["n_turns"] += 1
                state["turns_sha256"].update(f"{role or ''}\n{text}\n".encode())
                state["loss_chars"] += len(learned)
                state["loss_sha256"].update(learned.encode())
                state["formatted_chars"] += chars
                state["n_tokens"] += n
                state["loss_tokens"] += n_loss
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([close(state)], schema=schema)

    return ordered(turns).mapInArrow(run, fields)
