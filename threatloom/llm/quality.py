"""Quality rules: base counts per text, and a hashed n-gram log-likelihood ratio.

Trusted documents and the whole corpus each give a multinomial over hashed n-grams: whole words
and pairs of neighbouring words. A text's verdict is the mean over its n-grams of log p(bucket | trusted) - log p(bucket | corpus),
compared with a threshold: the same text always gets the same verdict.

Everything is built-in expressions over one row. Texts are never shuffled; what moves is one
row per bucket and task, and the two tables of BUCKETS numbers reach the scoring expression as
scalar subqueries, so their size is fixed whatever the corpus is.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.frames import fresh, kept_in_table, quoted

BUCKETS = 1 << 16
#: Labelled rows that the trusted multinomial and the threshold are learnt from, at most.
LABELLED_ROWS = 5_000
#: Pseudo-counts that a trusted bucket gets in proportion to the corpus, in units of its share.
PRIOR = float(BUCKETS)
#: Scores are cut to -LIMIT .. LIMIT and counted in bins of this width to place the threshold.
LIMIT, BIN = 10.0, 0.01
#: A good text lost counts as so many bad ones kept, in shares of their classes.
LOSS = 3.0
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20  # per cent of the words
SYMBOLS = r"[#*$%&|<>]+"
_SPACES = r"[\x20\x09-\x0D]+"
_VISIBLE = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Words as an array; null, empty and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")


def _repeated_words(word: Column) -> Column:
    """Words in windows found twice or more. Windows are compared by a 64-bit hash of their words.

    Most texts repeat no window, which counting distinct hashes tells. For the rest, windows
    sorted by (hash, place) have their equals as neighbours, and each flagged window adds the
    words up to the next flagged one, WINDOW at most.
    """
    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda i, k: F.coalesce(F.least(F.get(at, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda sum_, n: sum_ + n)

    def flagged(sorted_: Column) -> Column:
        def twice(w: Column, k: Column) -> Column:
            return (F.get(sorted_, k + 1)["h"] == w["h"]) | (F.get(sorted_, k - 1)["h"] == w["h"])

        return _bind(F.array_sort(F.transform(F.filter(sorted_, twice), lambda w: w["i"])), covered)

    def counted(hash_: Column) -> Column:
        tagged = F.array_sort(F.transform(hash_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hash_)) == F.size(hash_), F.lit(0)).otherwise(_bind(tagged, flagged))

    def of_words(bound: Column) -> Column:
        windows = F.size(bound) - WINDOW + 1
        places = F.sequence(F.lit(0), windows - 1)
        hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(bound, i + k) for k in range(WINDOW)]))
        return F.when(windows < 2, F.lit(0)).otherwise(_bind(hashes, counted))

    return _bind(word, of_words).cast("long")


def _bind(value: Column, use) -> Column:
    """use(value) with `value` computed once: a one-element array handed to a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null and empty texts count as texts without words: all counts 0, base_failed true.
    """
    (word,) = fresh(docs, "word")
    return _counted(docs.withColumn(word, words(quoted(text))), text, word).drop(word)


def _counted(split: DataFrame, text: str, word: str) -> DataFrame:
    body = F.coalesce(quoted(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(_VISIBLE))
    counted = split.withColumns(
        {
            "n_words": F.size(word).cast("long"),
            "word_chars": F.length(F.array_join(word, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _bind(lines, lambda all_: (F.size(all_) - F.size(F.array_distinct(all_))).cast("long")),
            "n_repeat_words": _repeated_words(quoted(word)),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


# ---- n-gram model --------------------------------------------------------------------


def _bucket(*gram: Column) -> Column:
    """The bucket of an n-gram, given as one whole word or two."""
    return F.pmod(F.xxhash64(*gram), F.lit(BUCKETS)).cast("int")


def _counts(word_arrays: DataFrame) -> DataFrame:
    """(bucket, n) over all n-grams of the column `words`; added up on the map side."""
    pairs = F.arrays_zip(F.col("words").alias("word"), F.expr("slice(words, 2, size(words))").alias("following"))
    word, following = F.col("word"), F.col("following")
    each = word_arrays.filter("size(words) > 0").select(F.inline(pairs))
    both = F.array(_bucket(word), F.when(following.isNotNull(), _bucket(word, following)))
    return each.select(F.explode(both).alias("bucket")).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def _filled(spark, counts: DataFrame, value: Column) -> DataFrame:
    """One row with `value` for every bucket in order; buckets without a row have a null n."""
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    pairs = every.join(counts, "bucket", "left").select("bucket", value.alias("value"))
    listed = pairs.agg(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("value", F.lit(0.0)).alias("value")))).alias("all"))
    return listed.select(F.transform("all", lambda one: one["value"]).alias("table"))


@dataclass(frozen=True)
class QualityModel:
    """`ratio` is a one-row, one-column frame with the log ratio of each bucket."""

    ratio: DataFrame
    threshold: float


def with_score(frame: DataFrame, word: str, ratio: DataFrame, score: str = "score") -> DataFrame:
    """Add the mean log ratio of the n-grams in the array column `word`; 0 for a row without any."""
    (table,) = fresh(frame, "table")

    def value(*gram: Column) -> Column:
        return F.get(quoted(table), _bucket(*gram))

    def mean(all_: Column) -> Column:
        first = value(F.get(all_, F.lit(0)))
        pairs = F.sequence(F.lit(0), F.size(all_) - 2)
        total = F.aggregate(
            pairs, first, lambda sum_, i: sum_ + value(F.get(all_, i), F.get(all_, i + 1)) + value(F.get(all_, i + 1))
        )
        return F.when(F.size(all_) < 1, 0.0).when(F.size(all_) < 2, first).otherwise(total / (2 * F.size(all_) - 1))

    # The subquery stands in a projection of its own, since lambdas may not hold one; Spark runs it once.
    return frame.withColumn(table, ratio.scalar()).withColumn(score, _bind(quoted(word), mean)).drop(table)


def labelled_sample(labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id") -> DataFrame:
    """At most `rows` labelled ids, chosen by a hash of the id, one row per id, labels 0 and 1 only.

    An id that has both labels, or none, is left out. The bound is what allows a broadcast.
    """
    clear = labels.filter(quoted(label).isin(0, 1) & quoted(doc_id).isNotNull())
    one = clear.groupBy(quoted(doc_id).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("most"))
    return one.filter("label = most").select("id", "label").orderBy(F.xxhash64("id"), "id").limit(rows)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    labelled_rows: int = LABELLED_ROWS,
) -> QualityModel:
    """Corpus counts from every document; trusted counts and the threshold from labelled ones.

    The threshold is the score that parts label 1 from label 0 best (share of label 0 below it
    less LOSS times the share of label 1; of equals the lowest). Without rows of both labels it is so low that nothing is rejected.
    """
    spark = docs.sparkSession
    sample = labelled_sample(labels, label, labelled_rows, doc_id)
    texts = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text"))
    corpus = _counts(texts.select(words(F.col("text")).alias("words")))
    # Labelled texts and bucket counts are asked for more than once, so they are written once.
    known = kept_in_table(texts.join(F.broadcast(sample), "id").select("label", "text"), "quality-texts")
    known = known.select("label", words(F.col("text")).alias("words"))
    trusted = _counts(known.filter("label = 1"))
    # Smoothing towards the corpus: a bucket that trusted texts say nothing about gets a ratio of 1.
    joined = corpus.withColumnRenamed("n", "all").join(trusted.withColumnRenamed("n", "good"), "bucket", "left")
    joined = joined.select("bucket", F.col("all").cast("double"), F.coalesce("good", F.lit(0)).cast("double").alias("good"))
    joined = kept_in_table(joined, "quality-counts")
    totals = joined.agg(F.sum("all").alias("all_sum"), F.sum("good").alias("good_sum")).first()
    every, good = float(totals[0] or 1.0), float(totals[1] or 0.0)
    share = F.col("all") / every
    value = F.log((F.col("good") + PRIOR * share) / (good + PRIOR)) - F.log(share)
    # The table is computed once here; as a lazy subquery it would be counted anew by every use.
    table = _filled(spark, joined, value).first()[0]
    ratio = spark.createDataFrame([(table,)], "table array<double>")
    scored = with_score(known, "words", ratio).select("label", "score")
    cut = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.col("score"), F.lit(LIMIT))) / BIN).cast("int")
    bins = scored.groupBy(cut.alias("bin")).agg(
        F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")
    )
    return QualityModel(ratio, best_cut(bins.orderBy("bin").collect(), BIN, LIMIT))


def best_cut(bins: list, width: float, limit: float) -> float:
    """Where to cut bins (bin, good, bad) in order so that good stays above and bad below; 2 * limit / width bins at most."""
    good, bad = sum(row[1] for row in bins), sum(row[2] for row in bins)
    if not good or not bad:
        return -limit - 1
    best, threshold, below_good, below_bad = 0.0, -limit - 1, 0, 0
    for bin_, good_here, bad_here in bins:
        below_good, below_bad = below_good + good_here, below_bad + bad_here
        gain = below_bad / bad - LOSS * below_good / good
        if gain > best + 1e-12:
            best, threshold = gain, (bin_ + 1) * width
    return threshold


def judge(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Base counts, base_failed, score and kept for every document, beside its own columns.

    A text is kept unless a base rule fails it or its score is below the threshold. Equal rows are
    judged alike, an empty table stays empty. Own columns of these names are replaced; `accepted`
    leaves them as they are.
    """
    (word,) = fresh(docs, "word")
    split = docs.withColumn(word, words(quoted(text)))
    scored = with_score(_counted(split, text, word), word, model.ratio).drop(word)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= model.threshold))


def accepted(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns untouched, whatever these are called."""
    own = F.struct(*[quoted(name) for name in docs.columns])
    return judge(docs.select(own.alias("own"), quoted(text).alias("text")), model).filter("kept").select("own.*")
