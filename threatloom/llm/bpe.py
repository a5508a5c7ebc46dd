"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

Merging by rank is the definition of BPE, but not the fastest way to its result. Two tokens
stand next to each other in some merged text only if they are compatible: merging their joined
bytes gives back the two. A token sequence whose neighbours are all compatible is the merged
sequence, and there is one. The encoder therefore goes left to right with the longest token
that starts at each place, found by an Aho-Corasick automaton. It falls back to shorter
prefixes, and steps back where none fits. Places proven dead are marked, so the time is linear.
"""

import json
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.frames import by_bytes, fresh, give_back, lean, quoted

# --- Fixed values: the split pattern of byte-level BPE vocabularies ------------------
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# -------------------------------------------------------------------------------------
#: Bytes that a task spends on pieces it has met, and half as much on pairs. Of each, the older half goes when it is full.
REMEMBERED_BYTES = 48 << 20
#: A remembered text or pair costs about this much beside its own bytes.
_ENTRY_BYTES = 160
#: A match is one number: how far back it began, and in the low bits its token.
_ID_BITS, _ID_MASK = 20, (1 << 20) - 1
#: Text bytes that are encoded at a time.
SLICE_BYTES = 2 << 20
#: Longer pieces are encoded anew each time.
REMEMBERED_LENGTH = 64


class Recent(dict):
    """A dictionary that keeps what was met lately, in two generations of at most half of `limit` bytes each."""

    def __init__(self, limit: int):
        super().__init__()
        self.half, self.spent, self.old = limit // 2, 0, {}

    def put(self, key, value, size: int):
        if self.spent + size > self.half:
            self.old, self.spent = dict(self), 0
            self.clear()
        self.spent += size
        self[key] = value
        return value


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    return {chr(byte): byte for byte in shown} | {chr(256 + k): byte for k, byte in enumerate(hidden)}


class Encoder:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            description = json.load(file)
        model, to_byte = description["model"], _byte_characters()
        raw = {name: bytes(to_byte[c] for c in name) for name in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in description["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for name, token_id in model["vocab"].items():
            self.token[token_id] = name.encode() if name in self.special else raw[name]
        for name, token_id in self.special.items():
            self.token[token_id] = name.encode()
        ids = {text: model["vocab"][name] for name, text in raw.items() if name not in self.special}
        # Rank of the merge of a pair, what it gives, and which pair made each token.
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.made_from: dict[int, tuple[int, int]] = {}
        self.rank_of: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (model["vocab"][left], model["vocab"][right])
            made = ids[raw[left] + raw[right]]
            self.pair_rank[pair] = rank
            if made not in self.made_from:
                self.made_from[made], self.rank_of[made] = pair, rank
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        usable = {text: i for text, i in ids.items() if len(text) == 1 or i in self.made_from}
        self.single = [0] * 256
        for text, token_id in usable.items():
            if len(text) == 1:
                self.single[text[0]] = token_id  # matches everywhere: no need to search for it
            else:
                self.automaton.add_word(text.decode("latin-1"), len(text) - 1 << _ID_BITS | token_id)
        self.automaton.make_automaton()
        self.sizes = [len(text) for text in self.token]
        # Of each token, the longest shorter one that it begins with.
        self.shorter: dict[int, int] = {}
        for text, token_id in usable.items():
            for end in range(len(text) - 1, 0, -1):
                if text[:end] in usable:
                    self.shorter[token_id] = usable[text[:end]]
                    break
        self.forget()
        self.pieces = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split if self.special else None
        sizes = np.array([len(t) for t in self.token])
        self.offsets = np.append(0, np.cumsum(sizes))
        self.bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)

    def forget(self) -> None:
        """Drop what was remembered of texts."""
        self._compatible, self._known = Recent(REMEMBERED_BYTES // 2), Recent(REMEMBERED_BYTES)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two tokens."""
        pair = left << 32 | right
        known = self._compatible.get(pair)
        if known is None:
            known = self._compatible.old.get(pair)
            known = self._compatible.put(pair, self._judge(left, right) if known is None else known, _ENTRY_BYTES)
        return known

    def _judge(self, left: int, right: int) -> bool:
        """Undo merges, latest first, on both sides of the seam. The pair at the seam must never have been due.

        `before` is the rank of the merge undone last. A pair across the seam would have been
        taken if its rank is lower; at equal rank the one further left goes first.
        """
        last = len(self.pair_rank)
        before, on_left = last, False
        while True:
            across = self.pair_rank.get((left, right))
            if across is not None and (across < before or (across == before and not on_left)):
                return False
            left_rank, right_rank = self.rank_of.get(left, -1), self.rank_of.get(right, -1)
            if left_rank < 0 and right_rank < 0:
                return True
            # Of two merges of one rank the right one came later, so it is undone first.
            if left_rank > right_rank:
                before, on_left, left = left_rank, True, self.made_from[left][1]
            else:
                before, on_left, right = right_rank, False, self.made_from[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece of the split pattern."""
        size = len(piece)
        if not size:
            return []
        longest = [self.single[byte] for byte in piece]
        for end, match in self.automaton.iter(piece.decode("latin-1")):
            longest[end - (match >> _ID_BITS)] = match & _ID_MASK  # a later end is a longer match
        dead = bytearray(size + 1)
        found: list[int] = []
        at, token, left, shorter, sizes, met = 0, longest[0], -1, self.shorter, self.sizes, self._compatible.get
        while True:
            end = at + sizes[token]
            fits = not dead[end]
            if fits and left >= 0:
                fits = met(left << 32 | token)
                if fits is None:
                    fits = self.compatible(left, token)
            if fits:
                found.append(token)
                if end == size:
                    return found
                at, left, token = end, token, longest[end]
            elif token in shorter:
                token = shorter[token]
            else:
                dead[at] = 1
                token = found.pop()
                at -= sizes[token]
                left = found[-1] if found else -1

    def _packed(self, piece: str) -> bytes:
        packed = self._known.old.get(piece)
        if packed is None:
            packed = array("i", self.encode_piece(piece.encode())).tobytes()
        if len(piece) <= REMEMBERED_LENGTH:
            self._known.put(piece, packed, _ENTRY_BYTES + len(piece) + len(packed))
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers. Special strings in it are their tokens."""
        if self.split_special is not None and any(name in text for name in self.special):
            parts = self.split_special(text)
            return b"".join(
                struct.pack("<i", self.special[part]) if k % 2 else self._plain(part) for k, part in enumerate(parts)
            )
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known, packed = self._known, self._packed
        return b"".join([known.get(piece) or packed(piece) for piece in self.pieces(text)])

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each id's bytes begin (one more entry than ids)."""
        begins = self.offsets[ids]
        sizes = self.offsets[ids + 1] - begins
        ends = np.cumsum(sizes)
        places = np.append(0, ends)
        take = np.arange(places[-1]) + np.repeat(begins - places[:-1], sizes)
        return self.bytes[take], places


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per vocabulary file and Python process."""
    return Encoder(path)


def encode(text: Column, path: str) -> Column:
    """Token ids (array<int>) of each text; a null text is empty. `path` must exist on every executor."""

    def run(texts: pa.Array) -> pa.Array:
        model = encoder(path)
        packed = [model.encode_packed(t) if t else b"" for t in (x.as_py() for x in texts)]
        offsets = np.append(0, np.cumsum([len(p) // 4 for p in packed])).astype(np.int32)
        ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
        return pa.ListArray.from_arrays(pa.array(offsets), ids)

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(text)


_DECODE_IDS = 1 << 20


def _decoded(model: Encoder, ids: np.ndarray) -> str:
    blocks = (ids[k : k + _DECODE_IDS] for k in range(0, len(ids), _DECODE_IDS))
    return b"".join(model.decode_flat(block)[0].tobytes() for block in blocks).decode(errors="replace")


def round_trip(docs: DataFrame, path: str, keep: list[str], text: str = "text", coded: str = "coded") -> DataFrame:
    """The columns `keep` and a struct `coded` of `ids`, `n_tokens` and `decoded`, the text that the ids give back.

    Each text is encoded once. A null text is empty; equal rows are treated alike; an empty table
    stays empty. Where `keep` has a column named `coded`, underscores are added to the new name.
    A task holds SLICE_BYTES of text at a time, or one text, beside what its worker remembers.
    """
    (coded,) = fresh(docs.select(*[quoted(name) for name in keep]), coded)
    body = fresh(docs.select(*[quoted(name) for name in keep]), "body")[0]
    kind = T.StructType(
        [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
    )
    told = docs.select(*[quoted(name) for name in keep], quoted(text).alias(body))

    def answer(model: Encoder, part: pa.RecordBatch) -> pa.RecordBatch:
        packed = [model.encode_packed(t) if t else b"" for t in (x.as_py() for x in part.column(body))]
        ids = [np.frombuffer(p, dtype="<i4") for p in packed]
        sizes = np.array([len(i) for i in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))
        texts = pa.array([_decoded(model, i) for i in ids], pa.string())
        made = pa.StructArray.from_arrays([lists, pa.array(sizes), texts], names=kind.names)
        return pa.RecordBatch.from_arrays([*(part.column(name) for name in keep), made], [*keep, coded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        model = encoder(path)
        try:
            yield from (answer(model, part) for part in by_bytes(batches, body, SLICE_BYTES))
        finally:
            model.forget()
            give_back()

    fields = T.StructType([*told.select(*[quoted(name) for name in keep]).schema.fields, T.StructField(coded, kind)])
    return told.mapInArrow(run, fields)


def decode(ids: Column, path: str) -> Column:
    """The text of each array of ids, special tokens included; bytes that are not UTF-8 become U+FFFD. Null stays null."""

    def run(lists: pa.Array) -> pa.Array:
        model, out = encoder(path), []
        for row in lists:
            if not row.is_valid:
                out.append(None)
                continue
            out.append(_decoded(model, row.values.to_numpy(zero_copy_only=False)))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, T.StringType())(ids)

