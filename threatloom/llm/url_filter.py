"""URL filter: rules, and for the rest a ratio of two character language models.

Accepted and rejected URLs each train a Markov model of variable order: the chance of a
character given up to ORDER characters before it, each order smoothed with the one below by the
number of different characters seen after the context (Witten and Bell). A URL's score is the
difference of the two log-likelihoods per character; the threshold is calibrated on labelled
URLs kept out of training. All of it is built-in expressions and joins. Counts are exact, one
row per n-gram, and as many as the URLs have: nothing is hashed into a table of fixed size.

What a place in a URL adds depends on its last ORDER + 1 characters only, so it is worked out
once per different n-gram, from the shortest order up. A join or window on the way meets at
most one row per character of the alphabet for each key. Only n-grams that very many places
share, and URLs of very many pages, are dealt out by a salt.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.frames import fresh, kept_in_table, quoted
from threatloom.llm.quality import best_cut

ORDER = 4
ALPHABET = 256.0
HELD_OUT = 5  # one in so many labelled URLs calibrates the threshold
LIMIT, BIN = 10.0, 0.01
_START = "\n" * ORDER
UNIT = float(1 << 36)  # log-likelihoods are summed in whole numbers, so their order does not matter
HOT, SALTS = 512, 64  # keys with over 1 / HOT of all rows, so HOT at most, are split in SALTS

Rule = tuple[str, str]  # verdict, host/path


def parts(frame: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Add host (A-Z lower-cased) and path; both empty for null and for URLs without `://`."""
    text = F.coalesce(quoted(url), F.lit(""))
    found = F.locate("://", text)
    rest = F.when(found > 0, F.substring(text, found + 3, F.length(text))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    own = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return frame.withColumns(
        {host: F.translate(own, upper, lower), path: F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}
    )


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. The rules are a short list of settings."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        told = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, told) if found is None else found.when(fits, told)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


# ---- Markov models -----------------------------------------------------------------------


def _grams(url: Column) -> Column:
    """The ORDER + 1 characters up to each place, of start marks, the characters and an end mark."""
    padded = F.concat(F.lit(_START), F.coalesce(url, F.lit("")), F.lit("\n"))
    bound = F.array(F.struct(padded.alias("u")))
    return F.get(
        F.transform(bound, lambda b: F.transform(F.sequence(F.lit(1), F.length(b["u"]) - ORDER), lambda at: F.substring(b["u"], at, F.lit(ORDER + 1)))),
        F.lit(0),
    )


def _counts(labelled: DataFrame) -> DataFrame:
    """(gram, yes, no): how often accepted and rejected URLs have each n-gram of ORDER + 1 characters."""
    places = labelled.select("accepted", F.explode(_grams(F.col("url"))).alias("gram"))
    return places.groupBy("gram").agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))


def _gains(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, gain) for each row of `asked` (gram, each once): the log of its chance in accepted URLs over that in rejected ones."""
    zero = F.lit(0).cast("long")
    both = counts.select("gram", "yes", "no").unionByName(asked.select("gram", zero.alias("yes"), zero.alias("no")))
    # n-grams of all orders; their length tells the order, and that of a context too.
    sizes = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("size")
    every = both.groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).select(F.col("gram").alias("whole"), "yes", "no", sizes)
    every = every.groupBy(F.right("whole", F.col("size")).alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    after = Window.partitionBy(F.left("gram", F.length("gram") - 1))
    seen = [f(F.col(c)).over(after).alias(f"{name}_{c}") for c in ("yes", "no") for name, f in (("n", F.sum), ("t", lambda c: F.count_if(c > 0)))]
    every = kept_in_table(every.select("gram", "yes", "no", *seen), "url-grams")

    def chance(c: str, below: Column) -> Column:
        total = F.col(f"n_{c}") + F.col(f"t_{c}")
        return F.when(total > 0, (F.col(c) + F.col(f"t_{c}") * below) / total).otherwise(below).alias(f"p_{c}")

    found = every.filter(F.length("gram") == 1).select("gram", *[chance(c, F.lit(1 / ALPHABET)) for c in ("yes", "no")])
    for size in range(2, ORDER + 2):
        below = found.select(F.col("gram").alias("shorter"), F.col("p_yes").alias("b_yes"), F.col("p_no").alias("b_no"))
        longer = every.filter(F.length("gram") == size).withColumn("shorter", F.right("gram", F.lit(size - 1)))
        found = longer.join(below, "shorter").select("gram", *[chance(c, F.col(f"b_{c}")) for c in ("yes", "no")])
    gain = F.log("p_yes") - F.log("p_no")
    return asked.select("gram").join(found, "gram").select("gram", F.round(gain * UNIT).cast("long").alias("gain"))


def _hot(counted: DataFrame, key: str) -> list:
    """Keys (key, rows) that hold over 1 / HOT of all rows."""
    total = counted.agg(F.sum("rows")).first()[0] or 0
    return [r[0] for r in counted.filter(F.col("rows") * HOT > total).filter(F.col("rows") > SALTS).select(key).collect()]


def _salts(key: Column, hot: list) -> Column:
    """All salts of a key, to be exploded."""
    one = F.array(F.lit(0))
    return F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(one) if hot else one


def _salt(key: Column, hot: list, by: Column) -> Column:
    return F.when(key.isin(hot), F.pmod(by, F.lit(SALTS)).cast("int")).otherwise(0) if hot else F.lit(0)


@dataclass(frozen=True)
class UrlModel:
    """`counts` has a row (gram, yes, no) for each n-gram of the training URLs."""

    counts: DataFrame
    threshold: float


def with_score(frame: DataFrame, counts: DataFrame, url: str, score: str = "score") -> DataFrame:
    """Add the log-likelihood difference per character, end mark included. A null URL scores as an empty one."""
    text = F.coalesce(quoted(url), F.lit(""))
    # Different URLs, numbered; the numbers stand once they are written.
    urls = frame.groupBy(text.alias("url")).agg(F.count(F.lit(1)).alias("rows"))
    urls = kept_in_table(urls.withColumn("number", F.monotonically_increasing_id()), "urls")
    places = urls.select("number", F.explode(_grams(F.col("url"))).alias("gram"))
    asked = kept_in_table(places.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")), "url-asked")
    hot = _hot(asked, "gram")
    gains = kept_in_table(_gains(counts, asked), "url-gains").withColumn("salt", F.explode(_salts(F.col("gram"), hot)))
    places = places.withColumn("salt", _salt(F.col("gram"), hot, F.col("number")))
    sums = places.join(gains, ["gram", "salt"]).groupBy("number").agg((F.sum("gain") / UNIT / F.count(F.lit(1))).alias("mean"))
    hot = _hot(urls, "url")
    key, salt, mean = fresh(frame, "key", "salt", "mean")
    told = urls.join(sums, "number").select(F.col("url").alias(key), F.explode(_salts(F.col("url"), hot)).alias(salt), F.col("mean").alias(mean))
    keyed = frame.withColumns({key: text, salt: _salt(text, hot, F.monotonically_increasing_id())})
    return keyed.join(told, [key, salt]).withColumn(score, quoted(mean)).drop(key, salt, mean)


def fit(labelled: DataFrame) -> UrlModel:
    """Models from (url, accepted) rows; one URL in HELD_OUT, by hash, places the threshold instead.

    The threshold parts the two classes best on those (of equals the lowest). If a class has no
    rows there, everything is accepted.
    """
    known = labelled.filter("url IS NOT NULL AND accepted IS NOT NULL").select("url", "accepted")
    apart = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    counts = kept_in_table(_counts(known.filter(~apart)), "url-counts")
    scored = with_score(known.filter(apart), counts, "url")
    bin_ = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.col("score"), F.lit(LIMIT))) / BIN).cast("int").alias("bin")
    bins = scored.groupBy(bin_).agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    return UrlModel(counts, best_cut(bins.orderBy("bin").collect(), BIN, LIMIT))


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and score. A rule decides where one fits, else the score.

    Null URLs that no rule fits are blocked: nothing speaks for them. A column of `pages` that
    has one of these names is replaced.
    """
    (found,) = fresh(pages, "found")
    ruled = parts(pages, url).withColumn(found, rule_of(F.col("host"), F.col("path"), rules))
    scored = with_score(ruled, model.counts, url)
    accepted = quoted(url).isNotNull() & (F.col("score") >= model.threshold)
    verdict = F.coalesce(quoted(found)["verdict"], F.when(accepted, "allow").otherwise("block"))
    return scored.withColumns({"rule": quoted(found)["rule"], "verdict": verdict}).drop(found)


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Judge every page with models trained on the URLs that the rules decide."""
    (found,) = fresh(pages, "found")
    narrow = parts(pages.select(quoted(url).alias("url")))
    ruled = narrow.withColumn(found, rule_of(F.col("host"), F.col("path"), rules)).filter(quoted(found).isNotNull())
    return judge(pages, rules, fit(ruled.select("url", (quoted(found)["verdict"] == "allow").alias("accepted"))), url)
