"""Long passages that documents share, by compacting the de Bruijn graph of their words.

An edge of the graph is a window of `window` words; windows that follow each other share a node.
Edges are not counted one by one. Each window picks the least-hashed of the short word sequences
(`GRAM` words) in it, and neighbours that pick the same one stay together as a *piece*, a path
without branches that is some dozen edges long. Equal windows pick equal sequences, so copies of
a passage fall into equal pieces, but for those at its ends.

1. Pieces whose sequence occurs in one document only are dropped by a join.
2. Equal pieces are added up: the smallest document and the place there are a piece's source.
   Every occurrence of a piece joins its source. Pieces that follow each other in a document and,
   as their places show, in the source too, compact to one span.
3. Pieces that share a sequence but not all words are the ends of passages, and the places where
   copies differ. Only these are opened into windows, each piece in its smallest document only,
   and windows are matched one by one.

So what moves is a row per dozen words, then a row per word where passages end.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.frames import by_bytes, fresh, kept_in_table, quoted
from threatloom.llm.words import Words, words_of, xxh64

WINDOW = 50
#: Words of the sequences that windows pick from. Shorter ones make longer pieces, and more of them shared by chance.
GRAM = 20
SLICE_BYTES = 4 << 20
# Rolling hashes are sums of word hashes times powers of an odd number, modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VERSION_BITS, _PLACE_BITS, _SPAN_BITS = 24, 32, 8


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash (its low bits too)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any run of words: hash(a, b) is that of words a .. b - 1."""

    def __init__(self, words: Words):
        own = xxh64(words.data, words.start, words.size)
        n = len(own)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(n + 1, _BASE, np.uint64)) if n else np.full(1, _BASE)
            self.undo = np.cumprod(np.full(n + 1, _INVERSE, np.uint64)) if n else np.full(1, _INVERSE)
            self.upto = np.zeros(n + 1, np.uint64)
            np.cumsum(own * powers[:n], out=self.upto[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.upto[b] - self.upto[a]) * self.undo[a] + (b - a).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the first place of the least of values[i : i + width]."""
    at = np.arange(len(values), dtype=np.int32)
    done = 1
    while done < width:
        step = min(done, width - done)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        done += step
    return at


def _pieces(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each piece: its hash, that of its sequence, the number of its text, its first window, and how many it has."""
    rolling, count = Rolling(words), np.diff(words.first)
    n = len(words.start)
    starts = np.arange(max(0, n - gram + 1))
    picked = _least(rolling.hash(starts, starts + gram), window - gram + 1)  # of window i, for every i of the slice
    own = count - window + 1  # windows of each text
    text = np.repeat(np.arange(len(count)), np.maximum(own, 0))
    lead = np.cumsum(np.maximum(own, 0)) - np.maximum(own, 0)
    first = np.arange(len(text)) - lead[text]  # the window's number in its text
    place = words.first[:-1][text] + first
    chosen = picked[place] if len(place) else np.zeros(0, np.int32)
    new = np.ones(len(place), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(place)))
    begin, sequence = place[head], chosen[head].astype(np.int64)
    return rolling.hash(begin, begin + size + window - 1), rolling.hash(sequence, sequence + gram), text[head], first[head], size


def _version_of(text: Column) -> Column:
    """A number for each text, so that rows of one id with different texts stay apart."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << _VERSION_BITS) - 1))


_PIECE = "piece long, sequence long, doc long, spot long"
_SPAN = "array<struct<start:int,size:int,doc:long,spot:int>>"


def _spot(version: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    return version << (_PLACE_BITS + _SPAN_BITS) | place << _SPAN_BITS | size


def _version():
    return F.shiftrightunsigned("spot", _PLACE_BITS + _SPAN_BITS)


def _place(spot):
    return F.shiftright(spot, _SPAN_BITS).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")


def _size(spot):
    return spot.bitwiseAND(F.lit((1 << _SPAN_BITS) - 1)).cast("int")


def pieces(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(piece, sequence, doc, spot) of every piece of every text of docs (doc, text); spot packs version, place and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", SLICE_BYTES):
            piece, sequence, text, place, size = _pieces(words_of(part.column("text"), lower=False), window, gram)
            ids = part.column("doc").to_numpy(zero_copy_only=False)
            versions = part.column("version").to_numpy(zero_copy_only=False)
            spots = _spot(versions[text], place, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.view(np.int64)), pa.array(sequence.view(np.int64)), pa.array(ids[text]), pa.array(spots)],
                ["piece", "sequence", "doc", "spot"],
            )

    return _keyed(docs).filter("doc IS NOT NULL").mapInArrow(run, _PIECE)


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, version, spans) for texts of docs (doc, text) that hold windows of an earlier document.

    spans are windows that repeat, as runs: the first window's place, how many, and where the
    first of them starts in the smallest document that has it (`doc`, `spot`).
    """
    found = kept_in_table(pieces(docs, window, gram), "repeats-pieces")
    shared = found.groupBy("sequence").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    # Sums are written before they are joined: Spark can then split a key that many rows share.
    shared = kept_in_table(shared.select("sequence"), "repeats-shared")
    alike = kept_in_table(found.join(shared, "sequence"), "repeats-alike")
    source = alike.groupBy("piece", "sequence").agg(F.min(F.struct("doc", "spot")).alias("source"), F.max("doc").alias("last"))
    source = kept_in_table(source, "repeats-sources")
    # Sequences with more than one smallest document: some windows of their pieces may still be older elsewhere.
    mixed = source.groupBy("sequence").agg(F.min("source.doc").alias("least"), F.max("source.doc").alias("most"))
    mixed = kept_in_table(mixed.filter("least < most").select("sequence", F.lit(True).alias("mixed")), "repeats-mixed")
    told = source.join(mixed, "sequence", "left").filter("mixed OR source.doc < last").select("piece", "source", "mixed")
    told = kept_in_table(told, "repeats-told")
    placed = alike.select("piece", "doc", "spot").join(told, "piece")
    placed = placed.filter("source.doc < doc OR (mixed AND source.doc = doc)").select(
        "doc", _version().alias("version"), _place(F.col("spot")).alias("start"), _size(F.col("spot")).alias("size"),
        (F.col("source.doc") < F.col("doc")).alias("whole"), F.col("source.doc").alias("from"), _place(F.col("source.spot")).alias("spot"),
    )
    placed = kept_in_table(placed, "repeats-placed")
    windows = kept_in_table(_windows(docs, placed.filter("NOT whole"), window), "repeats-windows")
    oldest = windows.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("source"), F.max("doc").alias("last"))
    oldest = kept_in_table(oldest.filter("source.doc < last"), "repeats-oldest")
    matched = windows.join(oldest, "window").filter("source.doc < doc")
    singles = matched.select("doc", "version", "start", F.lit(1).alias("size"), F.col("source.doc").alias("from"), F.col("source.start").alias("spot"))
    spans = placed.filter("whole").select("doc", "version", "start", "size", "from", "spot").unionByName(singles)
    every = F.array_sort(F.collect_list(F.struct("start", "size", F.col("from").alias("doc"), "spot")))
    return kept_in_table(spans.groupBy("doc", "version").agg(_compacted(every).alias("spans")), "repeats-spans")


def _compacted(spans):
    """Join spans that follow each other both here and in their source to one; spans are as many as a text has pieces."""

    def run(lists: pa.Array) -> pa.Array:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        flat, offsets = lists.flatten(), np.diff(lists.offsets.to_numpy())
        start, size, doc, spot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        row = np.repeat(np.arange(len(lists)), offsets)
        new = np.ones(len(start), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + size[:-1]) | (doc[1:] != doc[:-1]) | (spot[1:] != spot[:-1] + size[:-1])
        head = np.flatnonzero(new)
        total = np.add.reduceat(size, head) if len(head) else size
        ends = np.append(0, np.cumsum(np.bincount(row[head], minlength=len(lists)))).astype(np.int32)
        made = pa.StructArray.from_arrays(
            [pa.array(start[head], pa.int32()), pa.array(total, pa.int32()), pa.array(doc[head], pa.int64()), pa.array(spot[head], pa.int32())],
            ["start", "size", "doc", "spot"],
        )
        return pa.ListArray.from_arrays(pa.array(ends), made)

    return F.arrow_udf(run, T._parse_datatype_string(_SPAN))(spans)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs (doc, text, ..) with the version of each text."""
    return docs.withColumn("version", _version_of(F.col("text")))


def _windows(docs: DataFrame, opened: DataFrame, window: int) -> DataFrame:
    """(window, doc, version, start) of every window of the pieces `opened` (doc, version, start, size)."""
    lists = opened.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "size")).alias("opened"))
    # Equal rows are one text here.
    texts = _keyed(docs.select("doc", "text").filter("doc IS NOT NULL")).join(lists, ["doc", "version"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", SLICE_BYTES):
            words = words_of(part.column("text"), lower=False)
            rolling, lists = Rolling(words), part.column("opened")
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            start, size = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            which = np.repeat(np.arange(len(row)), size)
            spot = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            begin = words.first[row[which]] + spot
            owner = row[which]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rolling.hash(begin, begin + window).view(np.int64)), part.column("doc").take(pa.array(owner)),
                 part.column("version").take(pa.array(owner)), pa.array(spot.astype(np.int32))],
                ["window", "doc", "version", "start"],
            )

    return texts.select("doc", "version", "text", "opened").mapInArrow(run, "window long, doc long, version long, start int")


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """The rows of `docs`, each with n_words, n_removed, kept (the words left, joined by single spaces) and spans.

    A word goes if it lies in a window of `window` words that also starts in a document with a
    smaller id; windows are those of the texts as given. `spans` are the runs of such windows with
    their source. Null and empty texts have no words. Rows without an id take no part and keep their
    words. Rows of one id are one document: none removes words from another, and equal rows come out
    alike. Where `docs` has columns of these names, underscores are added to the new ones. An empty
    table stays empty. Texts of any length are taken whole; one text is held in a task at a time.
    """
    if not 1 <= gram <= window <= gram + (1 << _SPAN_BITS) - 2:
        raise ValueError(f"a window of {window} words does not fit sequences of {gram}")
    n_words, n_removed, kept, spans = fresh(docs, "n_words", "n_removed", "kept", "spans")
    narrow = docs.select(quoted(doc_id).cast("long").alias("doc"), quoted(text).alias("text"))
    found = repeated(narrow, window, gram)
    own = F.struct(*[quoted(name) for name in docs.columns]).alias("own")
    whole = _keyed(docs.select(own, quoted(doc_id).cast("long").alias("doc"), quoted(text).alias("text")))
    joined = whole.join(found, ["doc", "version"], "left").select("own", "text", "spans")
    kind = T.StructType([*joined.select("own").schema.fields, *T._parse_datatype_string(f"n_words long, n_removed long, kept string, spans {_SPAN}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", SLICE_BYTES):
            words, lists = words_of(part.column("text"), lower=False), part.column("spans")
            texts, gone = [], []
            flat, ends = lists.flatten(), np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            start, size = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            for i in range(part.num_rows):
                a, b = words.first[i], words.first[i + 1]
                x, y = (ends[i - 1] if i else 0), ends[i]
                if x == y:
                    body, lost = words.data[words.start[a] : words.start[b - 1] + words.size[b - 1]] if b > a else words.data[:0], 0
                else:
                    edge = np.zeros(b - a + 1, np.int32)
                    np.add.at(edge, start[x:y], 1)
                    np.add.at(edge, start[x:y] + size[x:y] + window - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    lost = int((~stays).sum())
                    each = words.size[a:b] + 1  # with the space behind each word
                    body = words.data[words.start[a] : words.start[b - 1] + each[-1]][np.repeat(stays, each)][:-1]
                texts.append(body.tobytes().decode())
                gone.append(lost)
            yield pa.RecordBatch.from_arrays(
                [part.column("own"), pa.array(np.diff(words.first)), pa.array(gone, pa.int64()), pa.array(texts, pa.string()),
                 lists.fill_null(pa.scalar([], lists.type))],
                kind.names,
            )

    made = joined.mapInArrow(run, kind)
    return made.select("own.*", *[F.col(a).alias(b) for a, b in zip(("n_words", "n_removed", "kept", "spans"), (n_words, n_removed, kept, spans), strict=True)])
