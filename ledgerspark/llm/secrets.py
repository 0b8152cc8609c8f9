"""Secret scan with a random forest against false positives, with DataFrame functions only."""

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored

# A candidate is a run of 16 or more of these characters with a digit in it, or a value beside a secret word.
RUN = r"[A-Za-z0-9_+/=\-]{16,}"
BLANK = r"[\x20\x09-\x0D]+"
# Words beside a candidate that speak of secrets, or of harmless numbers.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "private")
HARMLESS_WORDS = ("sha", "commit", "checksum", "digest", "uuid", "id", "order", "invoice", "card", "phone", "example", "version")
FEATURES = ("length", "transitions", "classes", "digits", "coverage", "distinct", "path", "quoted", "assigned", "secret_word", "harmless_word")


# A name that ends in a secret word, what may stand between it and its value, and what is not part of a value.
NAME = r"(?:^|[^a-z])(?:" + "|".join(SECRET_WORDS) + r")s?"
SIGN = r"(?:=>|:=|[=:])"
MARKS = "[\"'`]*"
VALUE = "(?i)" + NAME + MARKS + SIGN + "(?:\"([^\"]+)\"?|'([^']+)'?|`([^`]+)`?|([^\"'`].*))"
QUOTED = "^[=:>(\\[{<]*([\"'`])(.+?)\\1.*$"
OUTER = "^[=:>\"'`(\\[{<]+|[\"'`)\\]}>.,;]+$"


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: ``doc_id``, ``text_key``, ``word_no``, ``found`` and its features.

    ``text_key`` is a hash of the text. Long runs count whole, every occurrence in a word of its own
    row; null texts have none. So do values of any length and characters that are assigned to a
    secret word or stand next to one; marks around them are left out. Path and neighbouring words are
    features: whether the run looks like a path or link, and which words stand in the three places
    before it and the one after.
    """
    # Only texts with such a run or a secret word are split into words.
    some = docs.select("doc_id", "text").where(F.col("text").rlike(RUN) | F.lower("text").rlike(NAME + "([^a-z]|$)"))
    parts = some.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", BLANK).alias("_w"))
    at = lambda i: F.lower(F.coalesce(F.get("_w", i), F.lit("")))
    hit = lambda w: w.rlike(RUN) & w.rlike("[0-9]")
    # The value's word comes after the name, after a sign or verb behind it, or before the name.
    beside = lambda i: (at(i - 1).rlike(NAME + MARKS + SIGN + "?" + MARKS + "$")
                        | (at(i - 1).rlike("^(?:" + SIGN + "|is|was|are)$") & at(i - 2).rlike(NAME + MARKS + "$"))
                        | at(i + 1).rlike("^[\"'`(]*" + NAME + "([^a-z]|$)"))
    assigned = lambda w: w.rlike(VALUE)
    spots = F.filter(F.transform("_w", lambda w, i: F.when(hit(w) | assigned(w) | beside(i), F.struct(
        i.alias("no"), w.alias("word"), beside(i).alias("beside"),
        F.lower(F.array_join(F.slice("_w", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ")).alias("before"),
        F.lower(F.array_join(F.slice("_w", i + 2, 1), " ")).alias("after")))), lambda s: s.isNotNull())
    spot = parts.select("doc_id", "text_key", F.explode(spots).alias("s"))
    runs = F.filter(F.regexp_extract_all("s.word", F.lit(RUN), F.lit(0)), lambda x: x.rlike("[0-9]"))
    quoted = [F.regexp_extract("s.word", VALUE, k) for k in (1, 2, 3)]
    values = F.array(*quoted, F.regexp_replace(F.regexp_extract("s.word", VALUE, 4), OUTER, ""),
                     F.when(F.col("s.beside") & ~assigned(F.col("s.word")), F.regexp_replace(F.regexp_replace("s.word", QUOTED, "$2"), OUTER, "")).otherwise(""))
    # A name with its sign is no value.
    values = F.filter(values, lambda x: x.rlike(r"[\p{L}0-9]") & ~F.lower(x).rlike("^" + NAME + MARKS + SIGN + "$"))
    rows = spot.select("doc_id", "text_key", F.col("s.no").alias("word_no"), "s.word", "s.before", "s.after",
                       F.explode(F.array_distinct(F.concat(runs, values))).alias("found"))
    return rows.withColumns(_features())


def _features() -> dict[str, Column]:
    found, word = F.col("found"), F.col("word")
    n = F.length(found).cast("double")
    less = lambda chars: n - F.length(F.regexp_replace(found, chars, ""))
    # Each character as its class, then runs of a class as one: what is left counts the changes.
    kinds = F.translate(found, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    changes = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    said = lambda names, col: col.rlike(r"(^|[^a-z])(" + "|".join(names) + r")s?([^a-z]|$)")
    around = F.concat_ws(" ", F.col("before"), F.lower(F.split_part(word, found, F.lit(1))))
    flag = lambda c: c.cast("double")
    return {
        "length": F.least(n, F.lit(512.0)), "transitions": changes / n,
        "classes": flag(found.rlike("[a-z]")) + flag(found.rlike("[A-Z]")) + flag(found.rlike("[0-9]")) + flag(found.rlike(r"[_+/=\-]")),
        "digits": less("[0-9]") / n,
        "distinct": F.size(F.array_distinct(F.split(found, ""))) / n,
        "path": flag(word.rlike(r"://|^/|^\./|\.[a-z]{2,4}$|(/[a-z0-9_\-]+){2}")),
        "quoted": flag(word.rlike("[\"'`]")),
        "assigned": flag(around.rlike(r"[=:]\s*[\"'`]?$")),
        "secret_word": flag(said(SECRET_WORDS, F.concat_ws(" ", around, F.col("after")))),
        "harmless_word": flag(said(HARMLESS_WORDS, F.concat_ws(" ", around, F.col("after")))),
    }


def with_coverage(rows: DataFrame, docs: DataFrame, common: int = 20) -> DataFrame:
    """Add ``coverage``: the share of a candidate's characters in dictionary words.

    A candidate's runs of three letters and more count when the corpus has them as words ``common``
    times or more. Words are counted over all texts, but only those that some candidate holds.
    """
    letters = F.explode_outer(F.regexp_extract_all(F.lower("found"), F.lit("[a-z]{3,}"), F.lit(0)))
    pieces = rows.select("found").distinct().select("found", letters.alias("piece"))
    asked = pieces.select("piece").where("piece is not null").distinct()
    every = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}0-9]+")).alias("piece")).where("length(piece) between 3 and 64")
    counted = every.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= common)
    known = asked.join(counted, "piece").select("piece", F.lit(1).alias("known"))
    share = (pieces.join(known, "piece", "left").groupBy("found")
             .agg(F.coalesce(F.sum(F.when(F.col("known") == 1, F.length("piece"))), F.lit(0)).alias("_in"))
             .select("found", F.least(F.col("_in") / F.length("found"), F.lit(1.0)).alias("coverage")))
    return rows.join(share, "found")


def label_findings(rows: DataFrame) -> DataFrame:
    """Labelled findings out of candidates: ``label`` 1 or 0 where the case is clear, no row otherwise.

    Clear findings are assigned values beside a secret word that hold no dictionary words; clear
    false positives are plain numbers, paths, and names made of words, and dictionary words that
    only stand beside a secret word.
    """
    yes = "assigned = 1 and secret_word = 1 and path = 0 and coverage < 0.4 and digits < 1 and distinct >= 0.15"
    no = "secret_word = 0 and (digits = 1 or path = 1 or coverage >= 0.5 or transitions < 0.1) or (assigned = 0 and coverage >= 0.5)"
    return rows.withColumn("label", F.when(F.expr(yes), 1.0).when(F.expr(no), 0.0)).where("label is not null")


def train(findings: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 5) -> RandomForestClassificationModel | None:
    """Fit the forest on at most ``sample`` findings of each label, chosen by hash.

    None if there are not findings of both labels. Equal features count as often as they occur.
    """
    kinds = findings.groupBy(*FEATURES, "label").agg(F.count("*").cast("double").alias("_n"))
    order = F.xxhash64(*FEATURES)
    bounded = stored(kinds.where("label = 1").orderBy(order, *FEATURES).limit(sample)
                     .union(kinds.where("label = 0").orderBy(order, *FEATURES).limit(sample)))
    sums = {r["label"]: r["n"] for r in bounded.groupBy("label").agg(F.sum("_n").alias("n")).collect()}
    if len(sums) < 2:
        return None
    weighed = bounded.withColumn("_weight", F.col("_n") / F.when(F.col("label") == 1, sums[1.0]).otherwise(sums[0.0]) * F.lit(1000.0))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(weighed)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", weightCol="_weight", numTrees=trees, maxDepth=depth,
                                    minInstancesPerNode=1, featureSubsetStrategy="sqrt", seed=5)
    return forest.fit(ready)


def scan(docs: DataFrame, findings: DataFrame | None = None, sample: int = 20_000, least: float = 0.5) -> DataFrame:
    """All candidates of ``docs`` (doc_id, text) with ``score`` and ``is_secret``.

    ``findings`` are labelled candidates with all features; without them the clear cases of the
    corpus itself are the labels. If only one label exists there is no forest, and the score is 1 for
    what ``label_findings`` calls clear and 0 otherwise. Every occurrence is a row; rows with a
    null doc_id are scanned like others, null and empty texts give none.
    """
    rows = stored(with_coverage(candidates(docs), docs))
    model = train(label_findings(rows) if findings is None else findings, sample)
    if model is None:
        clear = label_findings(rows).where("label = 1").select("doc_id", "text_key", "word_no", "found").distinct()
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc_id", "text_key", "word_no", "found")]
        scored = (rows.alias("r").join(clear.withColumn("_y", F.lit(1.0)).alias("c"), same, "left")
                  .select("r.*", F.coalesce("_y", F.lit(0.0)).alias("score")))
    else:
        # Equal features are scored once per row in the JVM; no Python runs.
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(rows)
        scored = (model.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_k").transform(ready)
                  .withColumn("score", vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_k"))
    return scored.withColumn("is_secret", F.col("score") >= least)


def redact(docs: DataFrame, found: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every confirmed secret of a text replaced by ``mask``; all rows and columns stay.

    Long runs are replaced wherever they stand, other values where no letter or digit stands beside them.
    """
    longest_first = F.array_sort(F.collect_set("found"), lambda a, b: F.length(b) - F.length(a))
    secrets = found.where("is_secret").groupBy("text_key").agg(longest_first.alias("_secrets"))
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    whole = lambda s: F.concat(F.lit("(?<![\\p{L}0-9])\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![\\p{L}0-9])"))
    plain = F.lit(mask.replace("\\", "\\\\").replace("$", "\\$"))
    text = F.aggregate("_secrets", F.col("text"), lambda t, s: F.when(s.rlike(f"^{RUN}$") & s.rlike("[0-9]"), F.replace(t, s, F.lit(mask)))
                       .otherwise(F.regexp_replace(t, whole(s), plain)))
    return (keyed.join(secrets, keyed["_key"] == secrets["text_key"], "left")
            .withColumn("text", F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(text))
            .select(*docs.columns))
