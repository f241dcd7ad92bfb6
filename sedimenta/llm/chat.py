"""Chat formatting on the level of tokens.

Role headers and contents are encoded segment by segment, the reserved ids of the control tokens are spliced between, and
the loss mask is the prefix sum of marks at the borders of what the assistant says. A control string within a content never
becomes a control token; it is escaped as well, so that the decoded conversation can't be misread.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.bpe import VOCABULARY, Bpe
from sedimenta.llm.common import quoted, shuffle_partitions
from sedimenta.llm.textkit import ragged_gather, spans, string_buffers

CONTROL = ("<|endoftext|>", "<|im_start|>", "<|im_end|>")  # take the first free ids of the vocabulary, in this order
_LOOKS_LIKE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One backslash more after every `<` that is followed by `|`, backslashes between them or not."""
    return _LOOKS_LIKE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def assemble(bpe: Bpe, roles: list[str], texts: list[str], first: np.ndarray, learn: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, mask, end of each conversation) of conversations whose turns are first[k]..first[k+1]-1."""
    end_text, start, end = bpe.size, bpe.size + 1, bpe.size + 2
    n = len(texts)
    segments = [x for r, t in zip(roles, texts) for x in (escape(r) + "\n", escape(t))] + ["\n"]
    ids, count = bpe.encode(segments)
    newline = ids[len(ids) - count[-1] :]
    at = np.cumsum(count) - count
    # a turn: start, header, content, end, newline; a conversation ends with end-of-text
    source = np.concatenate([ids, np.array([start, end, end_text], np.int32)])
    k = len(ids)
    place = np.stack([np.full(n, k), at[0:-1:2], at[1:-1:2], np.full(n, k + 1), np.full(n, at[-1])], axis=1)
    length = np.stack([np.ones(n, np.int64), count[0:-1:2], count[1:-1:2], np.ones(n, np.int64), np.full(n, len(newline))], axis=1)
    convs = len(first) - 1
    turn_conv = np.repeat(np.arange(convs), np.diff(first))
    flat_place, flat_len = np.empty(5 * n + convs, np.int64), np.empty(5 * n + convs, np.int64)
    rows = 5 * np.arange(n) + turn_conv
    for j in range(5):
        flat_place[rows + j], flat_len[rows + j] = place[:, j], length[:, j]
    last = 5 * first[1:] + np.arange(convs)
    flat_place[last], flat_len[last] = k + 2, 1
    out = ragged_gather(source, flat_place, flat_len)
    begin = np.cumsum(flat_len) - flat_len
    marks = np.zeros(len(out) + 1, np.int32)
    taught = np.array([r == learn for r in roles], bool)
    np.add.at(marks, begin[rows[taught] + 2], 1)
    np.add.at(marks, begin[rows[taught] + 4], -1)
    return out, np.cumsum(marks[:-1]).astype(np.int8), begin[last] + 1


def chat_format(turns: DataFrame, path: str = VOCABULARY, learn: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, token_ids, loss_mask, n_tokens) of every conversation.

    A turn is <|im_start|>, role and newline, content, <|im_end|>, newline; <|endoftext|> ends the conversation. The mask is 1 on the
    contents of the role `learn` and on the <|im_end|> after them. Turns go by turn, then role, then text, nulls first, so ties and
    repeated rows keep a fixed order and all stay. A null role is the role "unknown", a null text is empty; rows without a
    conv_id form one conversation with a null conv_id. Texts are whole however long. An empty table gives an
    empty table; further columns aren't read.
    """
    rows = turns.select(quoted("conv_id").alias("conv_id"), quoted("turn").alias("turn"), F.coalesce(quoted("role"), F.lit("unknown")).alias("role"), quoted("text").alias("text"))
    shared = turns.sparkSession.sparkContext.broadcast(Bpe.load(path))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def whole(batches):
        """Tables that hold whole conversations."""
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            conv = t.column(0).combine_chunks()
            last = _boundaries(conv)[-1]
            if held and conv[0].as_py() != held[-1].column(0)[-1].as_py():
                yield pa.concat_tables(held)
                held = []
            if last:
                yield pa.concat_tables([*held, t.slice(0, last)])
                held = []
            held.append(t.slice(last))
        if held:
            yield pa.concat_tables(held)

    def run(batches):
        bpe = shared.value
        for t in whole(batches):
            conv = pa.concat_arrays(t.column(0).chunks)
            starts = np.concatenate([_boundaries(conv), [len(conv)]])
            _, offs = string_buffers(t.column(3))
            for lo, hi in spans(offs[starts]):
                a, b = int(starts[lo]), int(starts[hi])
                ids, mask, ends = assemble(bpe, t.column(2).slice(a, b - a).to_pylist(), [x or "" for x in t.column(3).slice(a, b - a).to_pylist()], starts[lo : hi + 1] - a, learn)
                at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [conv.take(pa.array(starts[lo:hi])), pa.array(np.diff(starts[lo : hi + 1]).astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(mask)), pa.array(np.diff(ends, prepend=0).astype(np.int32))],
                    ["conv_id", "n_turns", "token_ids", "loss_mask", "n_tokens"],
                )

    ordered = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kind}, n_turns int, token_ids array<int>, loss_mask array<tinyint>, n_tokens int")


def _boundaries(conv: pa.Array) -> np.ndarray:
    """Positions where a conversation begins."""
    codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1]).astype(np.int64)
