"""Secret scans: candidates of the texts, scored by a random forest that removes false positives.

A candidate is any run in a word of at least ``SHORTEST`` characters of the alphabets that keys are written in, with a
digit or letters of both cases inside. Its features are its length, its character transitions, how much of
it dictionary words cover, whether it looks like a path or address, and the words beside it. The dictionary is
the corpus itself: words that enough documents hold. The forest is trained on labelled findings; where a caller
has none, :func:`label_findings` labels the findings whose form decides the case.

All steps are DataFrame functions and Spark's own forest. Every document is scanned whole; findings, not texts,
are shuffled. The forest is fitted on ``SAMPLE`` labelled findings at most, chosen by hash.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut_lineage

SHORTEST = 16
RUN = rf"[A-Za-z0-9_+/=.-]{{{SHORTEST},}}"
MIXED = r"[0-9]|[a-z][A-Z]"
#: Labelled findings the forest is fitted on, and documents that must hold a word of the dictionary.
SAMPLE, WORD_DOCS = 20_000, 3
SECRET_NAMES = r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)\b"
FEATURES = [
    "length", "distinct_share", "digit_share", "upper_share", "symbol_share", "case_changes", "class_changes", "hex_only", "digits_only",
    "entropy", "dictionary", "path_like", "address_like", "quoted", "assigned", "named", "capital_before", "plain_after",
]


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, at, candidate, before2, before, word, after)``, a row per candidate.

    ``at`` is the place of the word in the text (from 0, in blank-separated words), ``before`` and ``after`` are the
    words beside it (empty at the ends). A word with several runs gives each, told apart by ``part``, and ``word`` is then
    the run with up to 80 characters of the pieces beside it. Null and empty texts have none.
    """
    blanks = F.lit(" \t\n\x0b\f\r")
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(MIXED) & F.col("text").rlike(RUN))
    some = some.select("doc_id", F.split(F.trim("text", blanks), r"[\x20\x09-\x0D]+").alias("w"))
    fits = lambda x: (F.length(x) >= SHORTEST) & x.rlike(RUN) & x.rlike(MIXED)
    marked = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), fits(x).alias("fits"))), lambda s: s["fits"])
    rows = some.select("doc_id", "w", F.explode(marked).alias("m"))
    word = lambda shift: F.coalesce(F.get("w", F.col("m.at") + F.lit(shift)), F.lit(""))
    rows = rows.select(
        "doc_id", F.col("m.at").cast("long").alias("at"), word(0).alias("word"), word(-2).alias("before2"), word(-1).alias("before"), word(1).alias("after")
    )
    # runs and what is between them, in turn; of a word with several runs each takes what is beside it
    pieces = F.split(F.regexp_replace("word", f"({RUN})", "\u0001$1\u0001"), "\u0001")
    rows = rows.withColumn("pieces", pieces)
    piece = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))
    beside = lambda x, i: F.struct(
        i.cast("long").alias("part"), x.alias("run"), F.concat(F.right(piece(i - 2), F.lit(80)), F.right(piece(i - 1), F.lit(80))).alias("lead"),
        F.substring(piece(i + 1), 1, 80).alias("rest"),
    )
    runs = F.filter(F.transform("pieces", beside), lambda s: s["run"].rlike(f"^{RUN}$"))
    rows = rows.select("doc_id", "at", "before2", "before", "after", "word", (F.size("pieces") > 3).alias("several"), F.explode(runs).alias("r"))
    name = F.regexp_extract("r.run", rf"^[A-Za-z][A-Za-z0-9_.-]*=(?={RUN}$)", 0)
    rows = rows.withColumn("run", F.expr("r.run")).withColumn("name", name)
    rows = rows.withColumn("word", F.when(F.col("several"), F.concat("r.lead", "run", "r.rest")).otherwise(F.col("word")))
    bare = F.when(F.col("several"), F.expr("substring(run, length(name) + 1)")).otherwise(F.col("run"))
    clean = rows.withColumn("candidate", F.regexp_replace(bare, r"^[.=/+_-]+|[.+/_-]+$", ""))
    return clean.where((F.length("candidate") >= SHORTEST) & F.col("candidate").rlike(MIXED)).select(
        "doc_id", "at", "candidate", "before2", "before", "word", "after", F.col("r.part").alias("part")
    )


def dictionary(docs: DataFrame, text: str = "text", least: int = WORD_DOCS) -> DataFrame:
    """``(word, docs)``: runs of 3 to 20 letters, in lower case, that ``least`` documents or more hold."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), lambda w: F.length(w).between(3, 20)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the columns ``FEATURES``; equal candidates are measured once."""
    c = F.col("candidate")
    n = F.length(c)
    parts = F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    texts = found.select("candidate").distinct()
    # letters of a candidate that are words of the dictionary
    covered = (
        texts.select("candidate", F.explode(parts).alias("word")).join(words.select("word"), "word")
        .groupBy("candidate").agg(F.sum(F.length("word")).alias("__covered"))
    )
    chars = F.split(c, "")
    counts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    measured = texts.join(covered, "candidate", "left").select(
        "candidate",
        n.cast("double").alias("length"),
        (F.size(F.array_distinct(chars)) / n).alias("distinct_share"),
        _share("[0-9]").alias("digit_share"), _share("[A-Z]").alias("upper_share"), _share("[^A-Za-z0-9]").alias("symbol_share"),
        _share("[a-z](?=[A-Z])|[A-Z](?=[a-z])").alias("case_changes"),
        _share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[A-Za-z0-9](?=[^A-Za-z0-9])").alias("class_changes"),
        c.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex_only"), c.rlike(r"^[0-9]+$").cast("double").alias("digits_only"),
        (-F.aggregate(counts, F.lit(0.0), lambda s, p: s + p * F.log2(p))).alias("entropy"),
        F.least(F.lit(1.0), F.coalesce("__covered", F.lit(0)) / n).alias("dictionary"),
        c.rlike(r"/[a-z]{2,}/|^[a-z]+(?:/|\.[a-z]+$)").cast("double").alias("path_like"),
        c.rlike(r"(?i)\.(?:com|net|org|io)\b|^www\.").cast("double").alias("address_like"),
    )
    rows = found.join(measured.withColumnRenamed("candidate", "__candidate"), F.col("candidate") == F.col("__candidate")).drop("__candidate")
    near = F.concat_ws(" ", "before2", "before", F.expr("substring_index(word, candidate, 1)"))
    return (
        rows.withColumn("quoted", F.expr("""word rlike '["\\'`]'""").cast("double"))
        .withColumn("assigned", near.rlike(r"[=:]\W*$").cast("double")).withColumn("named", near.rlike(SECRET_NAMES).cast("double"))
        .withColumn("capital_before", F.col("before").rlike("^[A-Z]").cast("double")).withColumn("plain_after", F.col("after").rlike(r"^[\p{L}]+[,.]?$").cast("double"))
    )


def label_findings(found: DataFrame) -> DataFrame:
    """``found`` (with features) and ``label``: 1, 0, or null where the form does not decide.

    A secret: assigned to a name of secrets, in quotes, with little of the dictionary and many different characters.
    None: a number, an address, a path, or a run that the dictionary covers by half.
    """
    yes = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & (F.col("dictionary") < 0.3) & (F.col("entropy") > 2.5)
    no = (F.col("digits_only") == 1) | (F.col("address_like") == 1) | (F.col("path_like") == 1) | (F.col("dictionary") >= 0.5) | F.col("word").contains("@")
    return found.withColumn("label", F.when(yes & ~no, 1.0).when(no & ~yes, 0.0))


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = 24, depth: int = 6) -> RandomForestClassificationModel | None:
    """Fit the forest on at most ``sample`` rows (half of each class) with ``FEATURES`` and ``label``; one class only: no model.

    Rows are taken by hash, in one order and one partition, so the same findings give the same forest.
    """
    order = [F.xxhash64("candidate", "word", "before", "after"), F.col("candidate"), F.col("doc_id").asc_nulls_last(), F.col("at")]
    rows = labelled.where("label in (0, 1)").select("doc_id", "at", "candidate", "word", "before", "after", "label", *FEATURES)
    part = [rows.where(F.col("label") == v).orderBy(*order).limit(sample // 2) for v in (0.0, 1.0)]
    chosen = cut_lineage(part[0].unionByName(part[1]).coalesce(1))
    if chosen.select("label").distinct().count() < 2:
        return None
    shaped = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen.orderBy(*order))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=2, subsamplingRate=0.8)
    return forest.fit(shaped)


def score(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Add ``probability`` and ``is_secret`` (0.5 or more). Without a model the probability is null and every finding stays one."""
    if model is None:
        return found.withColumn("probability", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    shaped = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    scored = model.transform(shaped).withColumn("__p", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "prediction", "probability").withColumnRenamed("__p", "probability").withColumn(
        "is_secret", F.col("probability") >= 0.5
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """Every finding of ``docs`` with its features, ``probability`` and ``is_secret``.

    ``labels`` may give labelled findings ``(doc_id, at, label)``. Rows without an id and repeated rows are scanned
    like others. No finding: an empty result.
    """
    found = cut_lineage(findings(docs, doc_id, text))
    ready = cut_lineage(features(found, dictionary(docs, text)))
    if labels is None:
        known = label_findings(ready)
    else:
        known = ready.join(labels.select("doc_id", "at", F.col("label").cast("double").alias("label")).dropDuplicates(["doc_id", "at"]), ["doc_id", "at"])
    return score(ready, train(known))
