"""Near-duplicate groups by SimHash: fingerprints, pairs within a few bits, groups.

Fingerprints are compared, not documents: exact copies and texts with equal fingerprints are
one node. Pairs within `reach` bits are found by the generalised pigeonhole principle. The 64
bits are dealt into m parts, correlated bits into the same part, and part i gets a threshold
t_i of its own with sum(t_i) = reach - m + 1. If two fingerprints differed in more than t_i
bits of every part, they would differ in sum(t_i + 1) = reach + 1 bits or more. So every pair
agrees within t_i in some part, and looking up all values within t_i of each part's value
misses none. m and the thresholds come from a dynamic program over estimated candidates,
computed from bit statistics of all fingerprints. Any outcome of it gives the same pairs.
"""

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.components import components
from threatloom.llm.frames import fresh, give_back, kept_in_table, lean, quoted
from threatloom.llm.words import words_of, xxh64

BITS = 64
REACH = 4
SHINGLE = 4
_SLICE = 4 << 20
_BLOCK = 1 << 16
#: What making, moving and sorting one looked-up row costs, in comparisons of two fingerprints.
ROW_COST = 30.0


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: a bit is 1 if set in over half of its shingles' hashes, repeats counted.

    A text with fewer words than a shingle is one shingle; one without words (or null) gives 0.
    """
    words = words_of(texts)
    counts = np.diff(words.first)
    shingles = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    text = np.repeat(np.arange(len(counts)), shingles)
    begins = np.cumsum(shingles) - shingles
    first = words.first[:-1][text] + np.arange(len(text)) - begins[text]
    last = np.minimum(first + shingle - 1, words.first[1:][text] - 1)
    at = words.start[first]
    hashes = xxh64(words.data, at, words.start[last] + words.size[last] - at)
    votes = np.zeros((len(counts), BITS), dtype=np.int64)
    for begin in range(0, len(hashes), _BLOCK):
        block = hashes[begin : begin + _BLOCK]
        bits = np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner = text[begin : begin + _BLOCK]
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        votes[owner[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    ones = votes * 2 > shingles[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = np.frombuffer(texts.cast(pa.large_string()).fill_null("").buffers()[1], dtype=np.int64)
    sizes = sizes[texts.offset : texts.offset + len(texts) + 1]
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + _SLICE, side="right")) - 1)
        yield texts.slice(begin, end - begin)
        begin = end


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """The fingerprint as a signed 64-bit number."""
    lean()
    found = [fingerprints(part) for part in _slices(texts)]
    give_back()
    return pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))


def hex16(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


# ---- parts and thresholds ---------------------------------------------------------


def bit_statistics(nodes: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each pair of bits is set together, over all of them.

    Each task adds up one 64 x 64 table; Spark sums the tables by cell.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = np.zeros((BITS, BITS), dtype=np.int64)
        rows = 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows += len(values)
            for begin in range(0, len(values), _BLOCK):
                bits = _bits(values[begin : begin + _BLOCK]).astype(np.float32)
                together += np.rint(bits.T @ bits).astype(np.int64)
        cells = pa.array(np.arange(BITS * BITS + 1))
        yield pa.RecordBatch.from_arrays([cells, pa.array(np.append(together.ravel(), rows))], ["cell", "n"])

    summed = nodes.select(column).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for cell, n in summed:
        table[cell] = n
    return int(table[-1]), table[:-1].reshape(BITS, BITS)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(rows: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into equal parts; each grows around one bit by the bits most correlated with it."""
    share = together / max(rows, 1)
    mean = np.diag(share)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    linked = np.abs((share - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(linked, 0)
    left, dealt = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda bit: (linked[bit, left].sum(), -bit))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda bit: (linked[bit, group].sum(), -bit))
            group.append(best)
            left.remove(best)
        dealt.append(sorted(group))
    return dealt


def _within(mean: np.ndarray, part: list[int], most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most 0, 1, .. `most` bits of the part."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for bit in part:
        differ = 2 * mean[bit] * (1 - mean[bit])
        shifted = np.append(0.0, chance[:-1])
        chance = chance * (1 - differ) + shifted * differ
    return list(np.cumsum(chance))


def plan_parts(rows: int, together: np.ndarray, reach: int = REACH) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of least estimated cost. A threshold of -1 leaves its part out."""
    rows = max(rows, 1)  # of nothing every plan costs nothing, and the first would flip each four bits of 64
    mean = np.diag(together) / rows
    best: tuple[float, list, list] | None = None
    for number in range(1, reach + 2):
        parts = correlated_parts(rows, together, number)
        budget = reach - number + 1
        # costs[t + 1]: part looked up with threshold t
        costs = []
        for part in parts:
            chance = _within(mean, part, reach)
            looked_up = [sum(comb(len(part), d) for d in range(t + 1)) for t in range(reach + 1)]
            costs.append([0.0] + [rows * (1 + n) * ROW_COST + rows * rows / 2 * p for n, p in zip(looked_up, chance, strict=True)])
        # Dynamic program over parts: least cost of thresholds that sum to s (shifted so that -1 per part is 0).
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            following: dict[int, tuple[float, list[int]]] = {}
            for used, (spent, chosen) in table.items():
                for step, price in enumerate(cost):
                    if used + step <= budget + number:
                        option = (spent + price, [*chosen, step - 1])
                        if used + step not in following or option < following[used + step]:
                            following[used + step] = option
            table = following
        if budget + number in table and (best is None or table[budget + number][0] < best[0]):
            best = (table[budget + number][0], parts, table[budget + number][1])
    return best[1], best[2]


# ---- pairs -------------------------------------------------------------------------


def _mask(bits: list[int]) -> int:
    value = sum(1 << bit for bit in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def close_pairs(nodes: DataFrame, column: str, reach: int = REACH) -> DataFrame:
    """(a, b) with a < b for all pairs of different values in `column` at `reach` or fewer differing bits.

    `nodes` has each value once. A pair may appear once per part in which it was found. The
    distance is part of the join condition, so candidates that fail are never rows.
    """
    rows, together = bit_statistics(nodes, column)
    parts, thresholds = plan_parts(rows, together, reach)
    value = quoted(column)
    chosen = [(k, _mask(part), part, t) for k, (part, t) in enumerate(zip(parts, thresholds, strict=True)) if t >= 0]
    stored = F.array(*[F.struct(F.lit(k).alias("part"), value.bitwiseAND(F.lit(mask)).alias("key")) for k, mask, _, _ in chosen])
    kept = nodes.select(value.alias("a"), F.inline(stored))
    looked_up = []
    for k, mask, part, most in chosen:
        flips = [_mask(list(bits)) for d in range(most + 1) for bits in combinations(part, d)]
        flip = F.explode(F.array(*map(F.lit, flips))) if len(flips) > 1 else F.lit(flips[0])
        one = nodes.select(value.alias("b"), F.lit(k).alias("part"), flip.alias("flip"), value.bitwiseAND(F.lit(mask)).alias("own"))
        looked_up.append(one.select("b", "part", F.col("own").bitwiseXOR(F.col("flip")).alias("key")))
    probes = looked_up[0]
    for more in looked_up[1:]:
        probes = probes.unionByName(more)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach)
    kept, probes = kept.alias("kept"), probes.alias("probes")
    same = (F.col("kept.part") == F.col("probes.part")) & (F.col("kept.key") == F.col("probes.key"))
    return kept.join(probes, same & near).select("a", "b")


# ---- groups ------------------------------------------------------------------------


def _groups(marked: DataFrame, mark: str, doc_id: str, reach: int) -> tuple[DataFrame, DataFrame]:
    """One row per fingerprint (node, its smallest id), and (node, group) from the links."""
    nodes = marked.groupBy(quoted(mark).alias("node")).agg(F.min(quoted(doc_id)).alias("smallest"))
    nodes = kept_in_table(nodes, "simhash-nodes")
    return nodes, components(nodes, close_pairs(nodes, "node", reach), "node")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id (smallest id reachable over links).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows come out as
    often as they came in. A row without id links others, but only ids that exist name a group;
    a group without any has a null component_id. An empty table gives no rows.
    """
    marked = docs.select(quoted(doc_id).alias("doc_id"), fingerprint(quoted(text)).alias("fingerprint"))
    marked = kept_in_table(marked, "simhash-fingerprints")
    nodes, groups = _groups(marked, "fingerprint", "doc_id", reach)
    named = nodes.join(groups, "node")
    names = named.groupBy("group").agg(F.min("smallest").alias("component_id"))
    members = named.join(names, "group").select(F.col("node").alias("fingerprint"), "component_id")
    return marked.join(members, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """The rows of `docs` with one row left of each group of near duplicates, all columns kept.

    The row with the smallest id stays; of rows that repeat that id, the one whose text hashes
    lowest. Rows without an id yield to rows with one.
    """
    mark, rank = fresh(docs, "mark", "rank")
    marked = docs.withColumn(mark, fingerprint(quoted(text)))
    narrow = kept_in_table(docs.select(quoted(doc_id).alias("id"), fingerprint(quoted(text)).alias("mark")), "simhash-fingerprints")
    nodes, groups = _groups(narrow, "mark", "id", reach)
    order = F.struct(F.col("smallest").isNull().alias("none"), "smallest", "node")
    leading = nodes.join(groups, "node").groupBy("group").agg(F.min_by("node", order).alias(mark)).select(mark)
    first = Window.partitionBy(mark).orderBy(quoted(doc_id).asc_nulls_last(), F.xxhash64(quoted(text)))
    one = marked.withColumn(rank, F.row_number().over(first)).filter(quoted(rank) == 1)
    return one.join(leading, mark, "left_semi").select(*[quoted(name) for name in docs.columns])
