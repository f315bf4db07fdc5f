"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs of every document are hashed into ``buckets`` features. Two multinomials over the features, one of the
trusted documents and one of all documents, are counted on the whole corpus with add-one smoothing. A document's score is its
log-likelihood ratio divided by its number of features; it is kept when it passes the base rules and its score reaches
``least_score``. Everything is a DataFrame expression; per-document work stays inside the row, so no shuffle moves texts, and
the only thing gathered is the table of ``buckets`` weights.

Defined results: null text has no words and fails the base rules; documents with null ids are scored but never trusted;
repeated rows count as often as they occur; with no trusted document the two models are the same prior and corpus; texts of
any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.scale import sized

SPACE = "[\\x20\\x09-\\x0D]+"
BLANK = " \t\n\x0b\f\r"
#: The symbols that the rules count.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a non-null text."""
    trimmed = F.btrim(text, F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def shifted(a: Column, k: int) -> Column:
    """The array without its first k elements."""
    return F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))


def joined(a: Column, b: Column, k: int, size: Column) -> Column:
    """Hashes of (a[i], b[i + k]) for the first ``size`` places."""
    return F.slice(F.zip_with(a, shifted(b, k), lambda x, y: F.xxhash64(x, y)), 1, F.greatest(size, F.lit(0)))


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text, the first occurrence included."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = F.zip_with(p, shifted(p, 1), lambda x, y: x["h"] == y["h"])  # null against the last
            both = F.zip_with(F.concat(F.array(F.lit(False)), same), same, lambda x, y: x | F.coalesce(y, F.lit(False)))
            marked = F.zip_with(p, both, lambda x, b: F.when(b, x["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        def total(s: Column) -> Column:
            steps = F.zip_with(s, shifted(s, 1), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(placed, lambda p: let(starts(p), total))

    def when_repeated(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(windows))

    # five words: two pairs and one more
    return let(joined(joined(pairs, pairs, 2, F.size(pairs) - 2), hashes, 4, F.size(hashes) - 4), when_repeated)


def hashed(text: Column) -> Column:
    """Struct of the characters in words, the hash of each word and the hash of each word pair of a non-null text."""
    chars = lambda w: F.char_length(F.array_join(w, "")).cast("long").alias("chars")
    both = lambda w, h: F.struct(chars(w), h.alias("h"), joined(h, h, 1, F.size(h) - 1).alias("p"))
    return let(words_of(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: both(w, h)))


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(feature, F.lit(buckets)).cast("int")


def log_ratio_weights(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """One row: the array of log ratios by bucket. ``trusted`` holds doc_id; broadcast only if its size proves small."""
    ids = sized(trusted.select(F.col("doc_id").alias("__trusted")).where("__trusted is not null").distinct())
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select("doc_id", text.alias("text")).join(ids, F.col("doc_id") == F.col("__trusted"), "left")
    words = marked.select(F.col("__trusted").isNotNull().cast("int").alias("good"), hashed(F.col("text")).alias("w"))
    found = words.select("good", F.explode(F.concat("w.h", "w.p")).alias("x")).select("good", bucket(F.col("x"), buckets).alias("f"))
    counted = found.groupBy("f").agg(F.sum("good").alias("t"), F.count(F.lit(1)).alias("r"))
    table = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("f")).join(counted, "f", "left").na.fill(0, ["t", "r"])
    rows = table.agg(F.array_sort(F.collect_list(F.struct("f", "t", "r"))).alias("a"), F.sum("t").alias("tt"), F.sum("r").alias("rr"))
    ratio = lambda x: F.log((x["t"] + 1) / (F.col("tt") + buckets)) - F.log((x["r"] + 1) / (F.col("rr") + buckets))
    return rows.select(F.transform("a", ratio).alias("weights"))


def scored(docs: DataFrame, trusted: DataFrame, least_score: float = -0.12, buckets: int = 1 << 14) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    weights = log_ratio_weights(docs, trusted, buckets).scalar()
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        hashed(F.col("text")).alias("w"),
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.get(F.col("weights"), bucket(x, buckets)))
    features = F.concat("w.h", "w.p")
    counts = base.withColumn("weights", weights).select(
        "doc_id", F.size("w.h").cast("long").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", "n_dup_lines",
        repeated_words(F.col("w.h"), F.col("w.p")).alias("n_repeat_words"),
        (total(features) / F.greatest(F.size("w.h") + F.size("w.p"), F.lit(1))).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= least_score))
