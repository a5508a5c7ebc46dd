"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants form a tree. The root serves words to everyone, with a uniform base of V + 1 words.
Each context has a restaurant below it: the start of a text, and every word that learnt texts
have, however rare. The start counts as the place after an end. A customer at a context's restaurant sits down with those who eat the same word or
opens a table, which sends a customer to the root.

Words are compared by 64-bit hashes and dealt to partitions by them. All seats of a word, in
every restaurant, are then in one partition, and a word that a third of all tokens are is still
one entry per context. Gibbs sampling runs in each partition: who sits where is summed out, and
each dish draws its number of tables given everyone else; only the number of tables of a
restaurant spans partitions, and each estimates those elsewhere: by its own tables a customer,
and where it has few customers of a restaurant by those of restaurants of about the same size. After BURN_IN sweeps SAMPLES seatings
are kept. Predictive probabilities use the true totals of each seating and are averaged.

Text is read once. Blocks of documents become arrays of word numbers, written to the shared
folder. What goes to the partitions and back is, per block, one number list per distinct word
and context: as much as the corpus has, and never a row per token. Customers and tables of
contexts travel the same way, as lists for the words of a block; the driver has none of them.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.frames import by_bytes, kept_in_table, quoted
from threatloom.llm.words import word_hashes, words_of, xxh64

DISCOUNTS = (0.6, 0.8)  # root, contexts
STRENGTHS = (20.0, 5.0)
BURN_IN, SAMPLES, BETWEEN = 8, 3, 2
BLOCK_BYTES = 32 << 20
PART_WORDS, PART_TOKENS = 1 << 20, 1 << 21
FEW = 50.0  # customers that what restaurants of the same size do counts for
#: The end of a text as a token: no word hashes a newline.
END = xxh64(np.array([10], np.uint8), np.array([0]), np.array([1]))[0]


def _packed(values: np.ndarray) -> bytes:
    """Numbers with their byte planes apart: high bytes of small numbers cost next to nothing, so counts can be 64 bits wide."""
    flat = np.ascontiguousarray(values).ravel()
    return zstandard.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, flat.itemsize).T), 1)


def _open(packed: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _packed_sorted(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as their differences."""
    return _packed(np.diff(values, prepend=np.uint64(0)).astype("<u8"))


def _open_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_open(packed, "<u8"), dtype=np.uint64)


# ---- blocks ----------------------------------------------------------------------------------

_BLOCK = "block long, ids array<long>, held array<boolean>, sizes binary, tokens binary, vocabulary binary, counts binary, n_tokens long, n_words long"


def _block_row(number: int, ids: list, held: list, sizes: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    size = np.concatenate(sizes)
    vocabulary, token = np.unique(np.concatenate(hashes), return_inverse=True)
    learnt = np.repeat(~np.array(held, bool), size)
    counts = np.bincount(token[learnt], minlength=len(vocabulary))
    row = {
        "block": [number],
        "ids": [ids],
        "held": [held],
        "sizes": [_packed(size.astype(np.int32))],
        "tokens": [_packed(token.astype("<i4"))],
        "vocabulary": [_packed_sorted(vocabulary)],
        "counts": [_packed(counts.astype(np.int32))],
        "n_tokens": [int(learnt.sum())],
        "n_words": [len(vocabulary)],
    }
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(row.values(), kinds, strict=True)], names=list(row))


def _tokens_of(row: dict) -> np.ndarray:
    return _open(row["tokens"], "<i4")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task gathered into blocks of about BLOCK_BYTES; a longer text is a block by itself."""
    number = TaskContext.get().partitionId() << 32
    ids, held, sizes, hashes, gathered = [], [], [], [], 0
    for part in by_bytes(batches, "text", 4 << 20):
        words = words_of(part.column("text"))
        own = word_hashes(words)
        counts = np.diff(words.first)
        hashes.append(np.insert(own, words.first[1:], END))
        sizes.append(counts + 1)
        ids += part.column("id").to_pylist()
        held += part.column("held").to_pylist()
        gathered += len(words.data)
        if gathered >= BLOCK_BYTES:
            yield _block_row(number, ids, held, sizes, hashes)
            number += 1
            ids, held, sizes, hashes, gathered = [], [], [], [], 0
    if ids:
        yield _block_row(number, ids, held, sizes, hashes)


def _pairs_of(row: dict, vocabulary: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Word and context of each token in one number: place of the word times words, and place of the word before it."""
    sizes = _open(row["sizes"], np.int32)
    context = np.empty(len(token), np.int64)
    context[1:] = token[:-1]
    context[np.cumsum(sizes) - sizes] = np.searchsorted(vocabulary, END)
    return token * np.int64(len(vocabulary)) + context


def _edges(vocabulary: np.ndarray, bits: int) -> np.ndarray:
    """Where the words of each partition begin and end; partitions are ranges of hashes."""
    part = (vocabulary >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(vocabulary), np.int64)
    return np.searchsorted(part, np.arange((1 << bits) + 1))


# ---- seats -----------------------------------------------------------------------------------


EXACT = 256  # up to so many customers, Stirling numbers come from their recurrence
NEAR, TERMS = 1.5, 60
POINTS = 65  # numbers of tables that are weighed for a dish with more customers
GROUPS = 4  # dishes of a group are drawn at once, each given the rest as the groups before have left it


def log_rise(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logarithm of a (a + 1) .. (a + n - 1) for a > 0 and n >= 0, whole or not, without the loss of taking large logarithms apart."""
    a, n = np.broadcast_arrays(np.asarray(a, float), np.asarray(n, float))
    low = np.zeros(a.shape)
    small = a < 8
    if small.any():
        x, y = a[small], a[small] + n[small]
        for k in range(8):
            low[small] += np.log((x + k) / (y + k))
        a = np.where(small, a + 8, a)
    end = a + n
    series = lambda x: (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    return low + (a - 0.5) * np.log1p(n / a) + n * (np.log(end) - 1) + series(end) - series(a)


def log_factorial(n: np.ndarray) -> np.ndarray:
    return log_rise(1.0, n)


class Stirling:
    """Logarithms of generalised Stirling numbers S(c, t): the weight of all ways to seat c customers at t tables.

    They are exact up to EXACT customers. Beyond, few tables (up to NEAR * c^d) have the
    alternating sum of falling powers, which ends early there. For more, S(c, t) is c! / (t! d^t)
    times the chance that t independent Sibuya(d) numbers add up to c, by its saddlepoint.
    """

    def __init__(self, discount: float):
        self.d = d = discount
        self.exact = np.full((EXACT + 1, EXACT + 1), -np.inf)
        self.exact[1, 1] = 0.0
        for c in range(1, EXACT):
            t = np.arange(1, c + 2)
            stay = np.log(np.maximum(c - t * d, 1e-300)) + self.exact[c, 1 : c + 2]
            self.exact[c + 1, 1 : c + 2] = np.logaddexp(np.where(t <= c, stay, -np.inf), self.exact[c, : c + 1])
        # By y = log(1 - z): mean of a number tilted by z, and what the saddlepoint needs there.
        y = -np.geomspace(1e-9, 60.0, 6000)
        z, rest = -np.expm1(y), np.exp(y)
        seen = -np.expm1(d * y)  # 1 - (1 - z)^d
        # Factorial moments, to be divided by seen.
        f1 = d * z * rest ** (d - 1)
        f2 = d * (1 - d) * z**2 * rest ** (d - 2)
        m1, m2 = f1 / seen, (f1 + f2) / seen
        k2 = m2 - m1**2
        sound = (m1 - 1 > 1e-6) & (k2 > 1e-6)
        self.mean = np.log(m1[sound] - 1)
        self.rate = (np.log(seen) - m1 * np.log(z))[sound]
        self.spread = np.log(k2[sound])
        j = np.arange(1, TERMS + 1)
        self.signs = (-1.0) ** (j + 1) * np.sin(np.pi * j * d) / np.pi

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For a column of c over EXACT, and rows of t from 1 to c."""
        d, c, t = self.d, np.asarray(c, float), np.asarray(t, float)
        at = np.log(np.maximum(c / t - 1, 1e-12))
        sums = t * np.interp(at, self.mean, self.rate) - 0.5 * (np.log(2 * np.pi * t) + np.interp(at, self.mean, self.spread))
        out = log_factorial(c) + np.where(t == c, t * np.log(d), sums)
        near = t <= NEAR * c**d
        row, column = np.nonzero(near)
        if len(row):
            j = np.arange(1, TERMS + 1)
            # Each term from the one before: C(t, j), then the two gamma functions.
            steps = np.exp(log_rise(1 + (j - 1) * d, d) - log_rise(c - j * d, d)) / j
            few, product, total = t[row, column], np.ones(len(row)), np.zeros(len(row))
            for k in range(TERMS):
                product *= np.maximum(few - k, 0) * steps[row, k]
                total += product * self.signs[k]
            out[row, column] = log_rise(1.0, c[row, 0] - 1) + np.log(np.maximum(total, 1e-300))
        return out - log_factorial(t) - t * np.log(d)


STIRLING = {d: Stirling(d) for d in DISCOUNTS}


def draw_tables(random, discount: float, customers: np.ndarray, rise: np.ndarray, come: np.ndarray | None, over: np.ndarray) -> np.ndarray:
    """A number of tables for each dish, from its conditional: S(c, t) times the product, over i < t, of
    discount * (rise + i) * (come + i) / (over + i), or discount * (rise + i) / over if nothing comes."""
    out, number = np.ones(len(customers), np.int64), STIRLING[discount]
    for c in range(2, EXACT + 1):
        for at in np.array_split(rows := np.flatnonzero(customers == c), 1 + len(rows) * c // (1 << 21)):
            if len(at):
                i = np.arange(c)
                more = np.log(discount * (rise[at, None] + i) * ((come[at, None] + i) / (over[at, None] + i) if come is not None else 1 / over[at, None]))
                out[at] = 1 + _pick(random, number.exact[c, 1 : c + 1] + np.cumsum(more, axis=1))
    many = np.flatnonzero(customers > EXACT)
    for at in np.array_split(many, 1 + len(many) // (1 << 12)):
        if len(at):
            c, a, o = customers[at, None].astype(float), rise[at, None], over[at, None]

            def weigh(t, c=c, a=a, o=o, at=at):
                sent = log_rise(come[at, None], t) - log_rise(o, t) if come is not None else -t * np.log(o)
                return number(c, t) + t * np.log(discount) + log_rise(a, t) + sent

            # All weight lies about one mode: narrow the points down to where it is, then draw among them.
            low, high = np.ones_like(c), c.copy()
            while True:
                step = np.maximum((high - low) / (POINTS - 1), 1.0)
                t = np.minimum(np.floor(low + step * np.arange(POINTS)), high)
                weight = weigh(t)
                weight[:, 1:][t[:, 1:] == t[:, :-1]] = -np.inf
                heavy = weight > weight.max(axis=1, keepdims=True) - 25
                first, last = heavy.argmax(axis=1), POINTS - 1 - heavy[:, ::-1].argmax(axis=1)
                line = np.arange(len(at))
                left, right = t[line, np.maximum(first - 1, 0)][:, None], t[line, np.minimum(last + 1, POINTS - 1)][:, None]
                if np.all((right - left >= 0.5 * (high - low)) | (step <= 1)):
                    break
                low, high = left, right
            picked = _pick(random, weight)
            least = t[line, picked]
            most = np.where(picked + 1 < POINTS, t[line, np.minimum(picked + 1, POINTS - 1)], least + 1)
            width = np.maximum(most - least, 1)
            # A point stands for the numbers around it.
            drawn = np.floor(least + (random.random(len(at)) - 0.5) * (width - 1) + 0.5)
            out[at] = np.clip(drawn, 1, customers[at]).astype(np.int64)
    return out


def _pick(random, weight: np.ndarray) -> np.ndarray:
    """A column for each row, by the logarithms of its weights."""
    total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    return (total < random.random(len(weight))[:, None] * total[:, -1:]).sum(axis=1)


class Seats:
    """Numbers of tables of many dishes. A dish is a word in a restaurant; who sits where is summed out."""

    def __init__(self, customers: np.ndarray):
        """One table for each dish that has customers."""
        self.customers = customers.astype(np.int64)
        self.count = (self.customers > 0).astype(np.int64)

    def tables(self) -> np.ndarray:
        return self.count

    @property
    def dish(self) -> np.ndarray:
        """The dish of each table."""
        return np.repeat(np.arange(len(self.count)), self.count)

    @property
    def size(self) -> np.ndarray:
        """One seating of those that the numbers of tables stand for: all but one customer each at the first."""
        size = np.ones(int(self.count.sum()), np.int64)
        some = np.flatnonzero(self.count)
        size[(np.cumsum(self.count) - self.count)[some]] += (self.customers - self.count)[some]
        return size


class Sampler:
    """Seats of a partition's words: entries (word, context, customers) over the root."""

    def __init__(self, word: np.ndarray, context: np.ndarray, customers: np.ndarray, words: int, scale: np.ndarray, base: float, seed):
        self.word, self.context, self.scale, self.base = word, context, scale, base
        self.random = np.random.default_rng(seed)
        self.leaf = Seats(customers)
        self.root = Seats(np.bincount(word[customers > 0], minlength=words))
        self.root_scale = float(scale.mean()) if len(scale) else 1.0
        self.here = np.bincount(context, customers, minlength=len(scale))

    def _open_tables(self) -> np.ndarray:
        """Tables of each context in the corpus: its own here, and an estimate of those elsewhere."""
        own, total = np.bincount(self.context, self.leaf.tables(), minlength=len(self.scale)), self.here * self.scale
        like = np.log2(np.maximum(total, 1)).astype(np.int64)
        usual = np.bincount(like, own) / np.maximum(np.bincount(like, self.here), 1)
        return own + np.maximum(total - self.here, 0) * (own + FEW * usual[like]) / (self.here + FEW)

    def root_chance(self, words: np.ndarray, tables: np.ndarray, total: float, all_tables: float) -> np.ndarray:
        d, s = DISCOUNTS[0], STRENGTHS[0]
        got = np.maximum(self.root.customers[words] - d * tables[words], 0)
        return (got + (s + d * all_tables) * self.base) / (s + total)

    def sweep(self) -> None:
        """All customers of every dish are seated anew, as far as it matters: the dish's number of tables is
        drawn from its conditional given all other dishes; then those of the root."""
        (d0, d), (s0, s) = DISCOUNTS, STRENGTHS
        more = np.flatnonzero(self.leaf.customers >= 2)
        dealt = self.random.integers(GROUPS, size=len(more))
        for group in range(GROUPS):
            at = more[dealt == group]
            if not len(at):
                continue
            words, own = self.word[at], self.leaf.count[at]
            rise = s / d + np.maximum(self._open_tables()[self.context[at]] - own, 0)
            total, roots = float(self.root.customers.sum()) * self.root_scale, float(self.root.count.sum()) * self.root_scale
            others = np.maximum(self.root.customers[words] - own - d0 * self.root.count[words], 0)
            come = others + (s0 + d0 * roots) * self.base
            self.leaf.count[at] = draw_tables(self.random, d, self.leaf.customers[at], rise, come, s0 + np.maximum(total - own, 0))
            self.root.customers = np.rint(np.bincount(self.word, self.leaf.count, minlength=len(self.root.customers))).astype(np.int64)
            self.root.count = np.minimum(self.root.count, self.root.customers)
        dishes = np.flatnonzero(self.root.customers >= 2)
        for group in range(GROUPS):
            at = dishes[group::GROUPS]
            if len(at):
                own = self.root.count[at]
                rise = s0 / d0 + np.maximum(float(self.root.count.sum()) * self.root_scale - own, 0)
                self.root.count[at] = draw_tables(self.random, d0, self.root.customers[at], rise, None, np.full(len(at), 1 / self.base))


# ---- partitions ----------------------------------------------------------------------------------

_KNOWN = "part int, block long, words binary, known binary, learnt long"
_ASK = "part int, block long, words binary, lengths binary, contexts binary, waiting binary, places binary, counts binary"
_ANSWER = "part int, block long, root binary, leaf binary, words binary, tables binary, seats array<long>"
_TABLES = "part int, block long, tables binary"


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.table({name: pa.array(list(v), kind) for v, (name, kind) in zip(columns, kinds.items(), strict=True)})


def _known(blocks: DataFrame, bits: int) -> DataFrame:
    """Per block and partition: its words, and how often learnt texts of the corpus have them. `learnt` counts the partition's learnt words, on one row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = _open_sorted(row["vocabulary"]), _open(row["counts"], np.int32)
                edges = _edges(words, bits)
                for part in np.flatnonzero(np.diff(edges)):
                    a, b = edges[part], edges[part + 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(part)], pa.int32()), pa.array([row["block"]]), pa.array([_packed_sorted(words[a:b])], pa.binary()), pa.array([_packed(counts[a:b])], pa.binary())],
                        ["part", "block", "words", "counts"],
                    )

    def total(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        hashes = [_open_sorted(r["words"]) for r in rows]
        words, where = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(where, np.concatenate([_open(r["counts"], np.int32) for r in rows])).astype(np.int64)
        ends = np.cumsum([len(h) for h in hashes])
        learnt = int((counts > 0).sum())
        out = [(r["part"], r["block"], r["words"], _packed(counts[where[e - len(h) : e]]), 0 if i else learnt) for i, (r, h, e) in enumerate(zip(rows, hashes, ends, strict=True))]
        return _table(out, {"part": pa.int32(), "block": pa.int64(), "words": pa.binary(), "known": pa.binary(), "learnt": pa.int64()})

    sent = blocks.select("block", "vocabulary", "counts").mapInArrow(split, "part int, block long, words binary, counts binary")
    return sent.groupBy("part").applyInArrow(total, _KNOWN)


def _ask(blocks: DataFrame, known: DataFrame, bits: int) -> DataFrame:
    """Per block and partition: its words, the contexts they stand in with all customers these have, and how often in learnt texts."""

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            vocabulary, token = _open_sorted(row["vocabulary"]), _tokens_of(row)
            waiting = np.concatenate([_open(r["known"], np.int64) for r in sorted(told.to_pylist(), key=lambda r: r["part"])])
            learnt = np.repeat(~np.array(row["held"], bool), _open(row["sizes"], np.int32))
            pair, place = np.unique(_pairs_of(row, vocabulary, token), return_inverse=True)
            count = np.bincount(place[learnt], minlength=len(pair))
            del token, place, learnt
            word, context = pair // len(vocabulary), pair % len(vocabulary)
            edges = _edges(vocabulary, bits)
            for part in np.flatnonzero(np.diff(edges)):
                a, b = edges[part], edges[part + 1]
                x, y = np.searchsorted(word, [a, b])
                own, at = np.unique(context[x:y], return_inverse=True)
                values = [
                    _packed_sorted(vocabulary[a:b]),
                    _packed(np.bincount(word[x:y] - a, minlength=b - a).astype(np.int32)),
                    _packed_sorted(vocabulary[own]),
                    _packed(waiting[own]),
                    _packed(at.astype(np.int32)),
                    _packed(count[x:y].astype(np.int32)),
                ]
                out.append((int(part), row["block"], *values))
        kinds = {"part": pa.int32(), "block": pa.int64()} | dict.fromkeys(("words", "lengths", "contexts", "waiting", "places", "counts"), pa.binary())
        return _table(out, kinds)

    left = blocks.select("block", "held", "sizes", "tokens", "vocabulary")
    return left.groupBy("block").cogroup(known.select("block", "part", "known").groupBy("block")).applyInArrow(run, _ASK)


def _sample(asked: DataFrame, words: int, tokens: int, bits: int, seed: int) -> DataFrame:
    """Seat the customers of each partition, and tell each block what it asked for.

    An answer to a block has, aligned with the question: root customers and tables of each word
    per sample (`root`), and of each (word, context) customers and tables per sample (`leaf`).
    An answer without a block has tables per sample of some contexts (`words`, `tables`) for the
    partition that these belong to. `seats` holds the root's customers and tables per sample, on
    one row.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])

        def numbered(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lists = [_open_sorted(r[name]) for r in rows]
            every, where = np.unique(np.concatenate(lists), return_inverse=True)
            return every, where, np.cumsum([0] + [len(v) for v in lists])

        vocabulary, where, starts = numbered("words")
        contexts, sits, firsts = numbered("contexts")
        waiting = np.zeros(len(contexts), np.int64)
        waiting[sits] = np.concatenate([_open(r["waiting"], np.int64) for r in rows])
        keys = []
        for r, a, b, c, d in zip(rows, starts[:-1], starts[1:], firsts[:-1], firsts[1:], strict=True):
            keys.append(np.repeat(where[a:b], _open(r["lengths"], np.int32)) * np.int64(len(contexts)) + sits[c:d][_open(r["places"], np.int32)])
        entries = np.cumsum([0] + [len(k) for k in keys])
        entry, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        customers = np.rint(np.bincount(at, np.concatenate([_open(r["counts"], np.int32) for r in rows]))).astype(np.int64)
        word, context = entry // len(contexts), entry % len(contexts)
        here = np.bincount(context, customers, minlength=len(contexts))
        scale = np.where(here > 0, waiting / np.maximum(here, 1), 1.0)
        sampler = Sampler(word, context, customers, len(vocabulary), scale, 1 / (words + 1), [seed, rows[0]["part"]])
        sampler.root_scale = tokens / max(1, int(customers.sum()))
        for _ in range(BURN_IN):
            sampler.sweep()
        root, leaf, per_context, seats = [], [customers], [], []
        for k in range(SAMPLES):
            for _ in range(BETWEEN if k else 1):
                sampler.sweep()
            tables = sampler.leaf.tables().copy()
            root += [sampler.root.customers.copy(), sampler.root.tables().copy()]
            leaf.append(tables)
            per_context.append(np.bincount(context, tables, minlength=len(contexts)))
            seats += [int(sampler.root.customers.sum()), int(sampler.root.tables().sum())]
        root, leaf, per_context = np.array(root, np.int64), np.array(leaf, np.int64), np.rint(per_context).astype(np.int64)
        out = []
        for i, r in enumerate(rows):
            w, e = where[starts[i] : starts[i + 1]], at[entries[i] : entries[i + 1]]
            out.append((r["part"], r["block"], _packed(root[:, w]), _packed(leaf[:, e]), None, None, [] if i else seats))
        edges = _edges(contexts, bits)
        for part in np.flatnonzero(np.diff(edges)):
            a, b = edges[part], edges[part + 1]
            out.append((int(part), None, None, None, _packed_sorted(contexts[a:b]), _packed(per_context[:, a:b]), []))
        kinds = {"part": pa.int32(), "block": pa.int64()} | dict.fromkeys(("root", "leaf", "words", "tables"), pa.binary()) | {"seats": pa.list_(pa.int64())}
        return _table(out, kinds)

    return asked.groupBy("part").applyInArrow(run, _ANSWER)


def _context_tables(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Per block and partition: tables per sample of the restaurants of its words, over the corpus."""

    def run(spread: pa.Table, asked: pa.Table) -> pa.Table:
        told = spread.to_pylist()
        lists = [_open_sorted(r["words"]) for r in told]
        words, where = np.unique(np.concatenate([*lists, np.zeros(0, np.uint64)]), return_inverse=True)
        tables, end = np.zeros((SAMPLES, len(words) + 1), np.int64), 0
        for r, own in zip(told, lists, strict=True):
            tables[:, where[end : end + len(own)]] += _open(r["tables"], np.int64).reshape(SAMPLES, -1)
            end += len(own)
        out = []
        for r in asked.to_pylist():
            hashes = _open_sorted(r["words"])
            place = np.searchsorted(words, hashes)
            found = np.append(words, np.uint64(0))[place] == hashes
            out.append((r["part"], r["block"], _packed(tables[:, np.where(found & (place < len(words)), place, len(words))])))
        return _table(out, {"part": pa.int32(), "block": pa.int64(), "tables": pa.binary()})

    spread = answers.filter("block IS NULL").select("part", "words", "tables")
    return spread.groupBy("part").cogroup(known.select("part", "block", "words").groupBy("part")).applyInArrow(run, _TABLES)


# ---- scores --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Totals:
    """What spans partitions: tokens and words learnt, and per sample the root's customers and tables."""

    tokens: int
    words: int
    seats: list[int]


def _score_block(row: dict, answers: dict[str, list], totals: Totals) -> dict:
    """Scores of a block's texts. `answers` has, by kind, what each partition says, in their order; partitions are
    ranges of hashes, so of the block's words and pairs too, and one at a time is opened."""
    vocabulary, token = _open_sorted(row["vocabulary"]), _tokens_of(row)
    pair, place = np.unique(_pairs_of(row, vocabulary, token), return_inverse=True)
    place = place.astype(np.int32)
    known = np.concatenate([_open(r, np.int64) for r in answers["known"]])
    tables = np.concatenate([_open(r, np.int64).reshape(SAMPLES, -1) for r in answers["tables"]], axis=1)
    (d0, d1), (s0, s1) = DISCOUNTS, STRENGTHS
    chance, words_end, end = np.zeros(len(pair)), 0, 0
    for packed_root, packed_leaf in zip(answers["root"], answers["leaf"], strict=True):
        root, leaf = _open(packed_root, np.int64).reshape(2 * SAMPLES, -1), _open(packed_leaf, np.int64).reshape(SAMPLES + 1, -1)
        own = slice(end, end + leaf.shape[1])
        word, of = pair[own] // len(vocabulary) - words_end, pair[own] % len(vocabulary)
        for k in range(SAMPLES):
            all_, all_tables = totals.seats[2 * k : 2 * k + 2]
            base = (root[2 * k] - d0 * root[2 * k + 1] + (s0 + d0 * all_tables) / (totals.words + 1)) / (s0 + all_)
            # A word that is a context has as many customers in its restaurant as learnt texts have of it.
            chance[own] += (leaf[0] - d1 * leaf[k + 1] + (s1 + d1 * tables[k][of]) * base[word]) / (s1 + known[of])
        words_end, end = words_end + root.shape[1], own.stop
    del pair, tables
    sizes = _open(row["sizes"], np.int32)
    starts = np.cumsum(sizes) - sizes
    plain = np.log10((known + 1) / (totals.tokens + totals.words + 1))
    return {
        "doc_id": row["ids"],
        "held_out": row["held"],
        "n_tokens": sizes.astype(np.int64),
        "n_known": np.add.reduceat((known[token] > 0).astype(np.int64), starts),
        "train_tokens": np.full(len(sizes), totals.tokens),
        "base_score": np.add.reduceat(plain[token], starts),
        "score": np.add.reduceat(np.log10(chance / SAMPLES)[place], starts),
    }


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model learns from rows where `held_out` is false or null. Null and empty texts have one
    token, their end. base_score is the add-one unigram score, score the averaged model's log10
    probability. Nothing to learn from leaves the uniform base. Null ids and repeated rows come
    out as they came in; an empty table gives no rows.
    """
    narrow = docs.select(quoted(doc_id).cast("long").alias("id"), quoted(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks = kept_in_table(narrow.mapInArrow(_blocks, _BLOCK), "py-blocks")
    tokens, entries = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, entries / PART_WORDS, tokens / PART_TOKENS)))))
    known = kept_in_table(_known(blocks, bits), "py-known")
    words = known.agg(F.coalesce(F.sum("learnt"), F.lit(0))).first()[0]
    answers = kept_in_table(_sample(_ask(blocks, known, bits), words, tokens, bits, seed), "py-answers")
    seats = [0] * (2 * SAMPLES)
    for place, n in answers.select(F.posexplode("seats").alias("place", "n")).groupBy("place").agg(F.sum("n")).collect():
        seats[place] = n
    totals = Totals(tokens, words, seats)

    def meet(block: pa.Table, answered: pa.Table) -> pa.Table:
        answered = answered.sort_by("part")
        answers = {name: [v.as_buffer() for v in answered.column(name).drop_null()] for name in ("known", "root", "leaf", "tables")}
        scored = [_score_block(row, answers, totals) for row in block.to_pylist()]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        arrays = [pa.chunked_array([pa.array(s[n], kind) for s in scored], kind) for n, kind in zip(names, kinds, strict=True)]
        return pa.table(arrays, names=list(names))

    left = blocks.select("block", "ids", "held", "sizes", "tokens", "vocabulary")
    told = {"known": known, "root": answers.filter("block IS NOT NULL"), "tables": _context_tables(answers, known)}
    none = F.lit(None).cast("binary")
    right = None
    for name, frame in told.items():
        own = ("root", "leaf") if name == "root" else (name,)
        one = frame.select("block", "part", *[(F.col(c) if c in own else none).alias(c) for c in ("known", "root", "leaf", "tables")])
        right = one if right is None else right.unionByName(one)
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(meet, _SCORES)


def perplexity(scored: DataFrame) -> DataFrame:
    """One row: perplexity per token of held-out texts, and of learnt ones."""
    per = lambda cond: F.pow(F.lit(10.0), -F.sum(F.when(cond, F.col("score"))) / F.sum(F.when(cond, F.col("n_tokens"))))
    return scored.agg(per(F.col("held_out")).alias("held_out"), per(~F.col("held_out")).alias("learnt"))
