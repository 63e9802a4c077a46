"""Chat conversations as token sequences with reserved ids and a loss mask."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that may not stand in a text as they are; the first three are the template's own.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"]
LOSS_ROLE = "assistant"
_RAW = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile("|".join(f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """A backslash after the first sign of each control string, and one more where some stand there already."""
    return _RAW.sub(lambda m: _join(m, "\\"), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _join(m, ""), text)


def _join(m: re.Match, more: str) -> str:
    first, slashes, rest = (g for g in m.groups() if g is not None)
    return first + more + slashes + rest


class Template:
    """Encodes and decodes; the ids after the vocabulary stand for the control strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.ids = {c: size + i for i, c in enumerate(CONTROL)}
        self.strings = {i: c for c, i in self.ids.items()}

    def turns(self, roles: list[str], texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and loss mask of each turn: segments are encoded apart, reserved ids put between them."""
        names = sorted(set(roles))
        coded = self.tokenizer.encode_batch_fast([escape(x) for x in [*names, *texts]], add_special_tokens=False)
        known = {name: e.ids for name, e in zip(names, coded[:len(names)], strict=True)}
        out = []
        for role, found in zip(roles, coded[len(names):], strict=True):
            name, text = known[role], found.ids
            ids = np.array([self.ids[TURN], *name, self.ids[TEXT], *text, self.ids[END]], np.int32)
            steps = np.zeros(len(ids) + 1, np.int8)
            if role == LOSS_ROLE:
                steps[len(name) + 2] += 1
                steps[len(name) + 2 + len(text)] -= 1
            out.append((ids, np.cumsum(steps, dtype=np.int8)[:-1]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The formatted text, control strings included."""
        out, at = [], 0
        for spot in [*np.flatnonzero(ids >= min(self.strings)), len(ids)]:
            if spot > at:
                out.append(self.tokenizer.decode(ids[at:spot].tolist(), skip_special_tokens=False))
            if spot < len(ids):
                out.append(self.strings[int(ids[spot])])
            at = spot + 1
        return "".join(out)

    def plain(self, ids: np.ndarray) -> str:
        return unescape(self.decode(ids))

    def read(self, turns: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, str, str, int]]:
        """Role, text, text under the mask and length of the formatted text of each turn, from its ids and mask.

        Segments between reserved ids are decoded once; a mask that does not cover just the text is decoded apart.
        """
        spots = [np.flatnonzero(ids >= min(self.strings)) for ids, _ in turns]
        segments = [ids[a + 1:b].tolist() for (ids, _), at in zip(turns, spots, strict=True) for a, b in zip(at[:2], at[1:3], strict=True)]
        names = {tuple(x) for x in segments[::2]}
        known = dict(zip(names, self.tokenizer.decode_batch([list(x) for x in names], skip_special_tokens=False), strict=True))
        texts = self.tokenizer.decode_batch(segments[1::2], skip_special_tokens=False)
        out = []
        for (ids, mask), at, name, text in zip(turns, spots, segments[::2], texts, strict=True):
            begin, middle, end = at
            if ids[at].tolist() != [self.ids[TURN], self.ids[TEXT], self.ids[END]] or begin or end + 1 != len(ids):
                raise ValueError("ids of a turn do not follow the template")
            role, plain = known[tuple(name)], unescape(text)
            told = np.flatnonzero(mask)
            whole = len(told) == end - middle - 1 and (not len(told) or (told[0] == middle + 1 and told[-1] == end - 1))
            under = plain if whole else self.plain(ids[told]) if len(told) else ""
            out.append((unescape(role), plain, under, len(TURN) + len(role) + len(TEXT) + len(text) + len(END)))
        return out


def format_turns(conversations: DataFrame, path: str = TOKENIZER, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``conv_id``, ``turn``, ``role``, ``text`` and the token ``ids`` with their loss ``mask``.

    The ids of a conversation are those of its turns one after another, in order of turn, role and text, nulls
    first; they are not gathered in one cell, because a conversation may be of any size. A null text or role is empty. Repeated turns stay. The mask is
    1 on the text of ``assistant`` turns. Turns are encoded where they are read.
    """
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
                                F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def encode(batches):
        template = Template(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = template.turns(part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([i for i, _ in coded], pa.list_(pa.int32())), pa.array([m for _, m in coded], pa.list_(pa.int8()))],
                                                 [*part.schema.names, "ids", "mask"])

    return rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids array<int>, mask array<tinyint>")


def read_back(turns: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """What the ids and masks of ``format_turns`` say, one row per conversation.

    The turns of a conversation pass in order through running digests, so a task holds one Arrow batch of turns at a time, whatever the
    conversation's size; only ids and mask are read.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")

    def read(batches):
        template, state = Template(path), None
        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, masks = ([x.values.to_numpy(zero_copy_only=False) for x in part.column(i)] for i in (1, 2))
                found = template.read(list(zip(ids, masks, strict=True)))
                for conv, (role, text, under, length) in zip(part.column(0).to_pylist(), found, strict=True):
                    if state is None or state[0] != conv:
                        if state is not None:
                            done.append(state)
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[3] += len(under)
                    state[4].update(under.encode())
                    state[5] += length
            yield _told(done)
        if state is not None:
            yield _told([state])

    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _told(states: list) -> pa.RecordBatch:
    rows = [(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in states]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
