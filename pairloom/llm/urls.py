"""URL filters, in DataFrame functions only.

Rules decide first. What no rule fits is judged by logistic regression on hashed
character n-grams of host and path, trained on a small labelled URL table:
``labelled_urls``, where both verdicts stand under every top-level domain, or a
table of the caller's, such as ``labelled_sample`` of what the rules decide.

A null URL, or one without ``://``, has an empty host and path and is judged like
any other; a URL of any length is judged whole. Repeated rows each get a result
row, an empty table none; columns other than key and URL are ignored. Without
labelled rows the method allows; with one class only it gives that class.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.runtime import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host/path`` with its verdict; fits the host, its subdomains, and paths that start so."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


# The rules of the contract.
RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)

# The words of the small labelled table, and what stands around them.
BLOCKED = (
    "adult", "ads", "bets", "casino", "cheap", "clickbait", "crack", "escort", "farm-links", "free-prizes", "gambling", "jackpot", "keygen", "loans", "lottery", "malware",
    "pills", "poker", "porn", "slots", "spam", "sweepstakes", "track", "viagra", "warez", "win", "xxx",
)
ALLOWED = (
    "academy", "archive", "arts", "astronomy", "biology", "books", "bridges", "chess", "city", "climate", "courses", "culture", "daily", "docs", "economy", "energy", "film", "forum",
    "garden", "geology", "health", "history", "journal", "kitchen", "law", "library", "maps", "market", "math", "museum", "music", "nature", "news", "ocean", "opera", "park", "physics",
    "poetry", "press", "radio", "recipes", "research", "review", "river", "school", "science", "society", "sports", "station", "theatre", "times", "travel", "university", "village", "weather", "wiki",
)
#: Words that mean nothing, made from syllables: what no model has seen need not be unwanted.
SYLLABLES = ("th", "an", "in", "er", "on", "re", "ti", "ou", "sh", "le", "ha", "ed", "st", "tion", "ing", "or")
MADE_UP = tuple(SYLLABLES[i % 16] + SYLLABLES[(5 * i + 3) % 16] + SYLLABLES[(7 * i // 3 + 1) % 16] for i in range(48))
BEFORE, DOMAINS, LANGUAGES = ("", "www.", "blog.", "m."), ("com", "org", "net", "edu", "io", "info"), ("en", "de", "es", "fr")
#: Rows of each verdict that ``labelled_sample`` takes at most, about.
TRAIN_ROWS = 2000
#: Buckets of hashed n-grams, and the lengths of n-grams.
BUCKETS, LENGTHS = 4096, (2, 3, 4)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of the longest fitting rule and its verdict, or null. Ties: the first in the alphabet."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked by where it comes from."""

    def of(mark: str, text: Column) -> Column:
        characters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")  # once, so that an n-gram costs its own length
        none = F.expr("cast(array() as array<string>)")

        def of_length(c: Column, n: int) -> Column:
            grams = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(F.lit(mark), *[F.get(c, i + j) for j in range(n)]))
            return F.when(F.size(c) >= n, grams).otherwise(none)

        def each(c: Column) -> Column:
            return F.concat(*[of_length(c, n) for n in LENGTHS])

        return F.transform(F.array(characters), each)[0]

    return F.concat(of("h", host), of("p", path))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table, ``host, path, verdict, word``: some rows for each of the words above, and of made-up ones that are allowed.

    Every word stands under every domain. A blocked word stands once as it is, and
    three times in what unwanted URLs look like whatever their words: strings of
    hyphens and digits, letters spelled as digits, and paths of redirects, clicks and
    hexadecimal marks. Allowed ones have plain names and short, readable paths.
    """
    word, second = F.col("word"), F.col("words")[F.pmod(F.col("at") + 5 * F.col("d") + 1, F.size("words"))]
    each = lambda words, verdict: F.struct(F.array(*map(F.lit, words)).alias("words"), F.lit(verdict).alias("verdict"))
    rows = spark.range(1).select(F.explode(F.array(each(BLOCKED, "block"), each((*ALLOWED, *MADE_UP), "allow"))).alias("x")).select("x.verdict", "x.words", F.posexplode("x.words").alias("at", "word"))
    rows = rows.select("verdict", "words", "at", "word", F.posexplode(F.array(*map(F.lit, DOMAINS))).alias("d", "domain"), F.array(*map(F.lit, BEFORE)).alias("before"), F.array(*map(F.lit, LANGUAGES)).alias("langs"))
    hashed = lambda i: F.abs(F.xxhash64("word", "domain", F.lit(i)))
    number, mark = (hashed(0) % 1000).cast("string"), F.lower(F.substring(F.hex(hashed(1)), 1, 10))
    lang = F.col("langs")[F.pmod(F.col("at") + F.col("d"), F.lit(len(LANGUAGES)))]
    plain = F.concat(F.lit("/"), lang, F.lit("/"), number)
    look = lambda name, *path: F.struct(name.alias("name"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in path]).alias("path"))
    unwanted = F.array(
        look(word, plain), look(F.concat_ws("-", word, second, number), "/go/", mark, "/", number), look(F.concat(second, word, number), "/click/", number, "-", mark, "/out"),
        look(F.translate(F.concat(word, F.lit("-"), second), "aeios", "43105"), "/r/", mark, "/aff", number, "/", mark),
    )
    wanted = F.array(look(word, plain), look(F.concat_ws("-", word, second), plain, ".html"), look(F.concat(word, F.lit("the")), "/", lang, "/", second, "/"), look(word, "/", second, "-", word))
    looks = F.explode(F.when(F.col("verdict") == "block", unwanted).otherwise(wanted))
    made = rows.select("*", looks.alias("x"))
    turn = F.pmod(F.col("at") + F.col("d") + F.length("x.name"), F.lit(len(BEFORE)))
    return made.select(F.concat(F.col("before")[turn], "x.name", F.lit(".example."), "domain").alias("host"), F.col("x.path").alias("path"), "verdict", "word")


def labelled_sample(judged: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``rows`` distinct URLs of each verdict, chosen by a hash of the URL."""
    known = judged.where(F.col("found").isNotNull()).select("host", "path", F.col("found.verdict").alias("verdict"))
    counts = {r["verdict"]: r["count"] for r in known.groupBy("verdict").count().collect()}  # two rows at most
    share = F.lit(0.0)
    for verdict, n in counts.items():
        share = F.when(F.col("verdict") == verdict, min(1.0, rows / n)).otherwise(share)
    place = F.pmod(F.xxhash64("host", "path"), F.lit(1_000_003)) / 1_000_003
    return known.where(place < share).distinct()


def filter_urls(pages: DataFrame, key: str, url: str = "url", rules: Sequence[Rule] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``key, host, path, rule, verdict, block_score`` of every page.

    ``labelled`` has host, path, verdict; None takes ``labelled_urls``.
    ``block_score`` is the classifier's probability of block, null where a rule fits.
    """
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    judged = pages.select(F.col(f"`{key}`").alias(key), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    train = cut((labelled_urls(pages.sparkSession) if labelled is None else labelled).select("host", "path", "verdict"))
    counts = {r["verdict"]: r["count"] for r in train.groupBy("verdict").count().collect()}
    if len(counts) < 2:
        given = judged.withColumn("score", F.lit(1.0 if "block" in counts else 0.0))
    else:
        tf = HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS)
        label = (F.col("verdict") == "block").cast("double")
        grams = ngrams(F.col("host"), F.col("path"))
        rows = tf.transform(train.select(grams.alias("grams"), label.alias("label")))
        model = LogisticRegression(maxIter=30, regParam=0.01, probabilityCol="probability").fit(rows)
        some = F.when(F.col("found").isNull(), grams).otherwise(F.expr("cast(array() as array<string>)"))
        given = model.transform(tf.transform(judged.withColumn("grams", some)))
        given = given.withColumn("score", vector_to_array("probability")[1])
    free = F.col("found").isNull()
    return given.select(
        key, "host", "path", F.col("found.rule").alias("rule"),
        F.when(free, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).otherwise(F.col("found.verdict")).alias("verdict"),
        F.when(free, F.col("score")).alias("block_score"),
    )
