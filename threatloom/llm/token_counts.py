"""Token counts of whole texts, as a tokenizer library gives them.

Texts are cut into pieces at places where no token can reach across. Equal pieces of a slice
are encoded once, in one batch call that returns lengths only. Slices are cut by bytes, so a
few long texts make as large a slice as many short ones, and a very long text needs no more
memory than its own bytes.

For byte-level BPE of the usual split pattern, a place before a single space is safe where a
character that is no white space stands on either side of that space: pieces of the pattern
have a space only in front, or consist of white space. For other tokenizers the whole text is
one piece.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threatloom.llm.frames import by_bytes, quoted, text_buffers

LIMIT = 1024
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BATCH = 20_000
#: First bytes of white space beyond ASCII. Next to them no cut is made, though most of their characters would allow it.
_MAY_BE_WHITE = np.zeros(256, dtype=bool)
_MAY_BE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


@lru_cache(maxsize=4)
def _tokenizers(path: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=4)
def _sentencepiece(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def _lengths(path: str, texts: list[str]) -> list[int]:
    """Token counts from one batch call of the library that belongs to the file."""
    if path.endswith(".model"):
        return [len(ids) for ids in _sentencepiece(path).encode(texts, num_threads=1)]
    return [len(found) for found in _tokenizers(path).encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def splits_before_spaces(path: str) -> bool:
    """Whether the file describes byte-level BPE with the usual pattern and nothing that reaches across a space."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as file:
        d = json.load(file)
    pre = d.get("pre_tokenizer") or {}
    plain = not d.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    tight = all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in d.get("added_tokens", []))
    return bool(plain and tight)


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions of spaces before which a text may be cut."""
    at = np.flatnonzero(data[1:-1] == 32) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    before, after = data[at - 1], data[at + 1]
    fine = ~_WHITE[before] & ~_WHITE[after] & ~_MAY_BE_WHITE[after]
    for back in (2, 3):  # a character of two or three bytes that ends before the space
        fine &= ~(_MAY_BE_WHITE[data[np.maximum(at - back, 0)]] & (before >= 0x80))
    return at[fine]


def count_slice(texts: pa.Array, path: str) -> np.ndarray:
    """Token count of each text; null and empty texts have none."""
    data, offsets = text_buffers(texts)
    sizes = np.diff(offsets)
    begins = offsets[:-1][sizes > 0]
    if not len(begins):
        return np.zeros(len(sizes), np.int64)
    cuts = safe_cuts(data) if splits_before_spaces(path) else np.zeros(0, np.int64)
    edges = np.union1d(begins, cuts)
    places = pa.py_buffer(np.append(edges, len(data)).astype(np.int64))
    pieces = pa.Array.from_buffers(pa.large_string(), len(edges), [None, places, pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    distinct, lengths = coded.dictionary, []
    for k in range(0, len(distinct), _BATCH):
        lengths += _lengths(path, distinct.slice(k, _BATCH).to_pylist())
    each = np.array(lengths, dtype=np.int64)[coded.indices.to_numpy()]
    out = np.zeros(len(sizes), np.int64)
    out[sizes > 0] = np.add.reduceat(each, np.searchsorted(edges, begins))
    return out


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every document.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null ids come out as they
    came in. No special tokens are added; special strings inside a text are handled as the
    library does by default.
    """
    kind = docs.select(quoted(doc_id)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: Spark has a task for each core
        for part in by_bytes(batches, "text"):
            counts = count_slice(part.column("text"), path)
            sizes = np.diff(text_buffers(part.column("text"))[1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
