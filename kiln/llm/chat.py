"""Chat formatting by token-level assembly (operator 2).

Every segment (role, text) is encoded by itself, so no token spans a border;
reserved ids, which no text can produce, mark the turns:

    TURN role SEP text END      rendered as      ### role: text</turn>\\n

Control strings inside content are escaped: a backslash is put before every
backslash, ``###`` and ``</turn>`` (in roles also before ``:``), and undone
by dropping it.  The loss mask covers the text segment of the trained
role; it is derived by prefix sums over +1/-1 marks at the segments' borders.

Edge cases: null text or role counts as empty; rows without conversation id
form one conversation; rows of one turn number are ordered by role, then by
a hash of the text, and all kept (repeated rows too); a text may have
any length; an empty table gives no rows; other columns are ignored.

One conversation is one output row, so its rows meet in one task, which
appends them in a stream; texts are encoded before that, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm.bpe import ByteBpe, read_ranks, sha, slices, worker_bpe

TURN, SEP, END = "### ", ": ", "</turn>\n"
_TEXT_CONTROL = regex.compile(r"\\|###|</turn>")
_ROLE_CONTROL = regex.compile(r"\\|###|</turn>|:")
_ESCAPED = regex.compile(r"\\(.)", regex.DOTALL)
_FORMATTED = regex.compile(r"### ((?:\\.|[^\\:])*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", regex.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _TEXT_CONTROL).sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def reserved(vocabulary: int) -> dict[str, int]:
    """Ids above the vocabulary for the template's marks."""
    return {TURN: vocabulary, SEP: vocabulary + 1, END: vocabulary + 2}


def assemble(segments: list[tuple[np.ndarray, np.ndarray, bool]], marks: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one conversation from its (role ids, text ids, trained) segments."""
    parts: list[np.ndarray] = []
    borders: list[tuple[int, int]] = []
    at = 0
    for role, text, trained in segments:
        parts += [np.array([marks[TURN]], "<u4"), role, np.array([marks[SEP]], "<u4"), text, np.array([marks[END]], "<u4")]
        start = at + len(role) + 2
        at = start + len(text) + 1
        if trained and len(text):
            borders.append((start, start + len(text)))
    ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    step = np.zeros(len(ids) + 1, np.int32)
    for a, b in borders:
        step[a] += 1
        step[b] -= 1
    return ids.astype("<u4"), np.cumsum(step[:-1]).astype(bool)


def render(ids: np.ndarray, bpe: ByteBpe) -> str:
    """The formatted text of assembled ids."""
    marks = {i: s.encode() for s, i in reserved(len(bpe.tokens)).items()}
    return b"".join(marks[i] if i in marks else bpe.tokens[i] for i in ids.tolist()).decode()


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _FORMATTED.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


def masked_text(ids: np.ndarray, mask: np.ndarray, bpe: ByteBpe) -> str:
    """All text under the mask, unescaped; each masked run is decoded by itself."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    runs = zip(edge[::2], edge[1::2])
    return "".join(unescape(bpe.decode(ids[a:b].astype("<u4").tobytes()).decode()) for a, b in runs)


def format_conversations(
    rows: DataFrame, vocabulary: str, pattern: str, trained_role: str = "assistant",
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """conv_id, ids (binary, little-endian unsigned 32-bit) and loss_mask (binary, one byte an id)."""
    tokens = rows.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), text.alias("text"),
        F.xxhash64(text).alias("tie"),
    )
    conv, turn = (slim.schema[c].dataType for c in ("conv_id", "turn"))
    binary = T.BinaryType()
    encoded_schema = T.StructType([
        T.StructField("conv_id", conv), T.StructField("turn", turn), T.StructField("role", T.StringType()),
        T.StructField("tie", T.LongType()), T.StructField("role_ids", binary), T.StructField("text_ids", binary),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokens.value, pattern)
        for batch in batches:
            texts, roles = batch.column("text").to_pylist(), batch.column("role").to_pylist()
            for lo, hi in slices(texts):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("role"), part.column("tie"),
                     pa.array(bpe.encode([escape(r, role=True) for r in roles[lo:hi]]), pa.binary()),
                     pa.array(bpe.encode([escape(t) for t in texts[lo:hi]]), pa.binary())],
                    names=encoded_schema.names,
                )

    out_schema = T.StructType([T.StructField("conv_id", conv), T.StructField("ids", binary), T.StructField("loss_mask", binary)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = reserved(len(tokens.value))
        current: list[tuple[np.ndarray, np.ndarray, bool]] = []
        last, seen = None, False
        done: list[tuple] = []

        def flush() -> None:
            ids, mask = assemble(current, marks)
            done.append((last, ids.tobytes(), mask.tobytes()))
            current.clear()

        def batch_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                names=out_schema.names,
            )

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, role, r, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "role_ids", "text_ids"))):
                if seen and c != last:
                    flush()
                last, seen = c, True
                current.append((np.frombuffer(r, "<u4"), np.frombuffer(t, "<u4"), role == trained_role))
            if done:
                yield batch_of(done, kind)
                done = []
        if seen:
            flush()
            yield batch_of(done, kind)

    encoded = slim.mapInArrow(encode, encoded_schema)
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return ordered.mapInArrow(join, out_schema)


def read_back(formatted: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """What the formatted rows hold: turns and loss text, read back from ids and mask."""
    tokens = formatted.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    schema = T.StructType([
        formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokens.value, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, m in zip(batch.column("ids"), batch.column("loss_mask")):
                ids, mask = np.frombuffer(i.as_py(), "<u4"), np.frombuffer(m.as_py(), bool)
                text = render(ids, bpe)
                turns = read_turns(text)
                loss = masked_text(ids, mask, bpe)
                plain = "".join(f"{r}\n{t}\n" for r, t in turns)
                for k, v in enumerate((len(turns), sha(plain.encode()), len(loss), sha(loss.encode()), len(text))):
                    out[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(v, k) for v, k in zip(out, kinds))], names=schema.names
            )

    return formatted.mapInArrow(run, schema)
