"""Mixing sources to target weights.

The weight of a source is its token share to the power of an exponent between 1 (shares as
they are) and 0 (all sources alike). The exponent is bisected until the weights meet a target
entropy or no source is repeated more often than a limit. The budget is then realised source
by source: whole epochs, and a part of a last one taken from a block permutation. In it every
document belongs to a block by a hash of itself and the epoch. Whole blocks are taken in order
until the budget falls inside one, and documents of that block in the order of their hashes
until it is used up. So no source is ever sorted or held in one task; what is ordered is one
row per block, and the documents of one block.
"""

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.frames import fresh, kept_in_table, quoted

BLOCK_TOKENS = 1 << 20
_GRID = 32
_ROUNDS = 5


def words_as_tokens(text: Column) -> Column:
    """Default token count of a document: its words."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_tokens(docs: DataFrame, tokens: Column, source: str = "source") -> DataFrame:
    """(source, tokens, rows), one row per source; a null source is a source of its own."""
    return docs.groupBy(quoted(source).alias("source")).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("rows"))


def _bisect(shares: DataFrame, fits) -> float:
    """The smallest exponent in 0..1 whose (log sum p^x, entropy) `fits`; 1 if none does.

    Each round asks for _GRID exponents in one aggregation over the sources and keeps the one
    interval in which the answer changes, as a bisection with _GRID - 1 cuts at a time.
    """
    low, high = 0.0, 1.0
    p = F.col("share")
    for _ in range(_ROUNDS):
        grid = [low + (high - low) * k / (_GRID - 1) for k in range(_GRID)]
        sums = [f for x in grid for f in (F.sum(F.pow(p, F.lit(x))), F.sum(F.pow(p, F.lit(x)) * F.log(p)))]
        row = shares.agg(*sums).first()
        found = None
        for k, x in enumerate(grid):
            z, zl = row[2 * k], row[2 * k + 1]
            if fits(x, log(z), log(z) - x * zl / z):
                found = k
                break
        if found is None:
            return 1.0
        if found == 0:
            return grid[0]
        low, high = grid[found - 1], grid[found]
    return high


def exponent(shares: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> float:
    """Exponent for `shares` (share > 0): the largest whose weights have at least `entropy` (nats), or the
    smallest that repeats no source more than `repeats` times on average.

    With `budget` (a multiple of all tokens) a source of share p is read budget * p^(x-1) / sum p^x
    times. Without it the budget is the least that reads every source once.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give one of entropy and repeats")
    if entropy is not None:
        # Entropy falls as the exponent rises: take the exponent just before it no longer suffices.
        first_short = _bisect(shares, lambda x, z, h: h < entropy)
        return first_short if first_short == 1.0 else max(0.0, first_short - 1e-6)
    least, most = (log(v) for v in shares.agg(F.min("share"), F.max("share")).first())

    def fits(x: float, z: float, _: float) -> bool:
        times = (x - 1) * least - (z - log(budget) if budget is not None else (x - 1) * most)
        return times <= log(repeats) + 1e-12

    return _bisect(shares, fits)


def weights(counts: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """counts (source, tokens, rows) with share, weight and quota (tokens to draw).

    A source without tokens has weight 0 and no quota: its rows appear once and cost nothing.
    """
    total = counts.agg(F.sum("tokens")).first()[0]
    if not total:
        return counts.select("*", *[F.lit(0.0).alias(name) for name in ("share", "weight")], F.lit(0).cast("long").alias("quota"))
    shared = counts.withColumn("share", F.col("tokens") / F.lit(float(total)))
    some = shared.filter("share > 0")
    x = exponent(some, entropy, repeats, budget)
    z, most = some.agg(F.sum(F.pow("share", F.lit(x))), F.max("share")).first()
    multiple = budget if budget is not None else z * exp((1 - x) * log(most))
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(x)) / z).otherwise(0.0)
    weighted = shared.withColumn("weight", weight)
    drawn = F.round(F.col("weight") * multiple * total).cast("long")
    # Rounding must not cost a source that is to be read whole its last tokens.
    near = F.abs(drawn - F.col("tokens")) <= 1
    return weighted.withColumn("quota", F.when(near, F.col("tokens")).otherwise(drawn))


def mix(
    docs: DataFrame, tokens: Column | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text",
    entropy: float | None = None, repeats: float | None = None, budget: float | None = None, seed: int = 0,
    block_tokens: int = BLOCK_TOKENS, copy: str = "copy",
) -> DataFrame:
    """The rows of `docs`, each as often as the mixture draws it, numbered 1, 2, .. in column `copy`.

    Column `turn` realises the permutation: in its order the blocks of all sources and epochs
    follow one another by hash, and the documents of a block by theirs, so a reader that sorts or
    range-partitions by it meets the sources at their weights all along.

    Tokens drawn from a source never exceed its quota; they fall short of it by less than one
    document. Null sources are one source, null ids and texts are drawn like others, equal rows
    are drawn together or not at all in a last epoch. An empty table stays empty. Where `docs` has
    a column named like `copy` or `turn`, underscores are added to the new one's name.
    """
    size, key, block, epochs = fresh(docs, "size", "key", "block", "epochs")
    copy, turn = fresh(docs, copy, "turn")
    names = docs.columns
    sized = docs.withColumn(size, words_as_tokens(quoted(text)) if tokens is None else tokens)
    counts = kept_in_table(source_tokens(sized, quoted(size), source), "mix-counts")
    plan = weights(counts, entropy, repeats, budget)
    has = F.col("tokens") > 0
    plan = plan.select(
        F.col("source").alias("plan_source"),
        F.when(has, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("int").alias(epochs),
        F.when(has, F.pmod("quota", F.greatest("tokens", F.lit(1)))).otherwise(0).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"),
    )
    plan = kept_in_table(plan, "mix-plan")

    def hashed_key(epochs: str) -> Column:
        return F.xxhash64(quoted(doc_id), quoted(text), quoted(epochs), F.lit(seed))

    def placed(frame: DataFrame, other: DataFrame) -> DataFrame:
        """Key and block of each row in the epoch that is drawn in part."""
        joined = frame.join(other, quoted(source).eqNullSafe(F.col("plan_source")), "inner")
        return joined.withColumn(key, hashed_key(epochs)).withColumn(block, F.pmod(F.xxhash64(quoted(key)), F.col("blocks")))

    narrow = placed(sized.select(quoted(source), quoted(doc_id), quoted(text), quoted(size)), plan.filter("rest > 0"))
    narrow = narrow.select("plan_source", "rest", quoted(block).alias("block"), quoted(key).alias("key"), quoted(size).alias("size"))
    per_block = narrow.groupBy("plan_source", "rest", "block").agg(F.sum("size").alias("size"))
    in_order = Window.partitionBy("plan_source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    upto = per_block.withColumn("upto", F.sum("size").over(in_order))
    # The first block that does not fit any more is the one that is drawn in part.
    cut = upto.filter("upto > rest").groupBy("plan_source").agg(
        F.min_by(F.struct("block", (F.col("rest") - (F.col("upto") - F.col("size"))).alias("left")), "block").alias("cut")
    )
    cut = kept_in_table(cut.select("plan_source", "cut.block", "cut.left"), "mix-cut")
    inside = narrow.join(
        cut.withColumnRenamed("plan_source", "cut_source"),
        F.col("plan_source").eqNullSafe(F.col("cut_source")) & (narrow["block"] == cut["block"]),
    ).select("plan_source", narrow["block"], "left", "key", "size")
    by_key = inside.groupBy("plan_source", "block", "left", "key").agg(F.sum("size").alias("size"))
    ordered = Window.partitionBy("plan_source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    last = by_key.withColumn("upto", F.sum("size").over(ordered)).filter("upto <= left")
    last = last.groupBy("plan_source").agg(F.max("key").alias("last_key"))
    bounds = (
        plan.join(cut.select(F.col("plan_source").alias("c"), F.col("block").alias("cut_block")), F.col("plan_source").eqNullSafe(F.col("c")), "left")
        .join(last.select(F.col("plan_source").alias("l"), "last_key"), F.col("plan_source").eqNullSafe(F.col("l")), "left")
        .select("plan_source", epochs, "rest", "blocks", "cut_block", "last_key")
    )
    bounds = kept_in_table(bounds, "mix-bounds")
    own, rest, blocks, cut_block, last_key = fresh(docs, "plan_source", "rest", "blocks", "cut_block", "last_key")
    bounds = bounds.toDF(own, epochs, rest, blocks, cut_block, last_key)
    everything = sized.join(bounds, quoted(source).eqNullSafe(quoted(own)), "inner").withColumn(key, hashed_key(epochs))
    everything = everything.withColumn(block, F.pmod(F.xxhash64(quoted(key)), quoted(blocks)))
    partly = (quoted(rest) > 0) & (
        quoted(cut_block).isNull()
        | (quoted(block) < quoted(cut_block))
        | ((quoted(block) == quoted(cut_block)) & (quoted(key) <= quoted(last_key)))
    )
    times = quoted(epochs) + F.coalesce(partly, F.lit(False)).cast("int")
    drawn = everything.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    # Epochs are shuffled anew each: the key and the block of a row depend on the number of its copy.
    of_copy = F.xxhash64(quoted(key), quoted(copy))
    of_block = F.xxhash64(quoted(source), quoted(copy), F.pmod(of_copy, quoted(blocks)), F.lit(seed))
    placed_at = F.shiftleft(of_block, 32).bitwiseOR(F.shiftrightunsigned(of_copy, 32))
    return drawn.select(*[quoted(n) for n in names], quoted(copy), placed_at.alias(turn))
