"""Mixing sources to target weights, with DataFrame functions only."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import count_words, prefix_sums, stored

SOURCES = 100_000  # sources (some 10 MB) up to which their cuts are sent to every task


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``taken`` to ``docs`` (doc_id, text, source).

    ``size`` counts words. Sources in code point order, null last, get ``weights`` in turn and
    share ``share`` of all words; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight. Every source is walked in the order of hash-random
    keys: whole passes first, then documents until the exact budget, the last one in part.

    Every row is kept. Null text has size 0 and is never taken; a null source is a source of its
    own; a null doc_id is keyed by the text. Rows equal in key and size share what is left
    at the budget's end equally, so reruns agree. Columns of these four names are replaced.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    sized = docs.select(
        *names, count_words(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("_g"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("-")))).alias("_key"))
    slim = stored(sized.groupBy("_g", "_key", "size").agg(F.count("*").alias("_n")))
    cuts = stored(_cuts(slim, _targets(slim, weights, share, most)))
    # One row per source: up to a fixed number of sources texts need not be shuffled for them.
    cuts = F.broadcast(cuts) if cuts.count() <= SOURCES else cuts
    later = (F.col("_key") > F.col("_cut_key")) | ((F.col("_key") == F.col("_cut_key")) & (F.col("size") > F.col("_cut_size")))
    last = (F.col("_key") == F.col("_cut_key")) & (F.col("size") == F.col("_cut_size"))
    rest = F.when(F.col("_cut_key").isNull() | later, F.lit(0)).when(last, F.col("_cut_words")).otherwise(F.col("size"))
    return (sized.join(cuts, "_g")
            .select(*names, "size", "source_size", "target", (F.col("_passes") * F.col("size") + rest).alias("taken")))


def _targets(slim: DataFrame, weights: tuple, share: float, most: int) -> DataFrame:
    """One row per source: ``source_size``, ``target``. Only as many rows as sources meet in a window.

    With sources in the order of cap by weight, the words a unit of weight gets once the
    first k are capped rise with k while caps are reached and fall after; the largest is the level.
    """
    sources = slim.groupBy("_g").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy("_g")) - 1
    ranked = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_g")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    capped = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("_level", (total - capped) / others)
    level = level.withColumn("_level", F.max("_level").over(Window.partitionBy()))
    return level.select("_g", "source_size",
                        F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_level")).alias("target"))


def _cuts(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """Add each source's whole passes and the row at which its last pass ends."""
    targets = stored(
        targets.withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_left", F.floor(F.col("target") - F.col("_passes") * F.col("source_size")).cast("long")))
    walked = prefix_sums(slim.withColumn("_words", F.col("size") * F.col("_n")), "_g", ["_key", "size"], "_words", "_at")
    ends = (walked.join(targets.select("_g", "_left"), "_g")
            .where("_at <= _left and _left < _at + _words")
            .select("_g", F.col("_key").alias("_cut_key"), F.col("size").alias("_cut_size"),
                    F.floor((F.col("_left") - F.col("_at")) / F.col("_n")).cast("long").alias("_cut_words")))
    return targets.drop("_left").join(ends, "_g", "left")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: one row per document and pass, with ``pass`` and the words that pass takes.

    A document cut by the budget keeps the start of its text, up to the last word taken. Takes
    the result of ``mix``; documents of which nothing is taken are left out.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    part = F.col("taken") - whole * F.col("size")
    passes = mixed.where("taken > 0").withColumn(
        "pass", F.explode(F.sequence(F.lit(0), (whole + F.when(part > 0, 1).otherwise(0) - 1).cast("int"))))
    words = F.when(F.col("pass") < whole, F.col("size")).otherwise(part)
    start = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, words.cast("int")), "")
    return passes.withColumn("text", F.when(words < F.col("size"), start).otherwise(F.col("text")))
