"""Licence scans with a trained paragraph classifier.

Every line of a text is a paragraph. Its word n-grams (one to three words, at
least one of them not a common word) that the training paragraphs know make a
sparse vector; logistic regression gives the chance of each family, of a licence
of unknown family, and of none. Two probabilities are calibrated on paragraphs
kept apart, so that at most ``MAX_WRONG`` of them are wrong: the largest of none
at which a line is still reported, and the smallest at which its family is named.
Below it a likely licence is "unknown". A named family is confirmed if the paragraph's n-grams match one of
the family's templates, and so corrected if another family's matches far better.

A line without any known uncommon word has an empty vector, which is no licence
by definition, so texts without such a word are passed over unread by the model.
Everything is DataFrame functions and Spark's own learners; nothing is shuffled
but the few scored lines.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from classweave.llm.license_texts import (
    COMMON_WORDS,
    OTHER_LICENSES,
    PLAIN_TEXTS,
    TEMPLATES,
)
from classweave.session import materialise

NONE, UNKNOWN = "none", "unknown"
MAX_N = 3
# lines of the corpus that stand for prose in training
NEGATIVE_DOCUMENTS = 300
MAX_WRONG = 0.02
LEAST_THRESHOLD = 0.3
MOST_LIMIT = 0.9
CONFIRMED = 0.5
CORRECTED = 0.25

_NOT_WORD = "[^\\p{L}\\p{N}]+"


def words_of(text: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), _NOT_WORD), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """N-grams of up to ``MAX_N`` words with an uncommon word among them.

    ``words`` must be a column of its own, as it is read at every place.
    """
    common = F.array(*(F.lit(w) for w in COMMON_WORDS))

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(
            F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.slice(words, at, n))

    found = F.filter(F.concat(*(runs(n) for n in range(1, MAX_N + 1))),
                     lambda run: F.size(F.array_except(run, common)) > 0)
    return F.transform(found, lambda run: F.array_join(run, " "))


def literal_rows(spark: SparkSession, rows: Iterable[tuple], names: list[str]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(
        F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows))))


def training_texts(spark: SparkSession) -> DataFrame:
    """``family, text, template``: the paragraphs, their halves and sentences.

    Parts of a paragraph are learned too, as texts break them over lines.
    """
    rows = [(family, text, True) for family, texts in TEMPLATES.items() for text in texts]
    rows += [(UNKNOWN, text, False) for text in OTHER_LICENSES]
    rows += [(NONE, text, False) for text in PLAIN_TEXTS]
    whole = literal_rows(spark, rows, ["family", "text", "template"])
    words = F.split("text", " ")
    parts = whole.where("template").select(
        "family", words.alias("w"), F.explode(F.sequence(
            F.lit(1), F.greatest(F.size(words) - 4, F.lit(1)), F.lit(8))).alias("at")
    ).where(F.size("w") > 12).select(
        "family", F.array_join(F.slice("w", F.col("at"), 12), " ").alias("text"),
        F.lit(False).alias("template"))
    return whole.union(parts)


class Scanner(NamedTuple):
    """A fitted classifier, its threshold, and the templates."""

    model: PipelineModel
    families: list[str]
    vocabulary: list[str]
    threshold: float
    limit: float
    templates: list[tuple[str, list[str]]]


def fit(docs: DataFrame, negatives: int = NEGATIVE_DOCUMENTS) -> Scanner:
    """Train on the fixed paragraphs and on lines of ``docs`` as prose.

    The lines are those of the ``negatives`` documents with the smallest hash of
    their id; lines that share an n-gram of three words with a template, or have
    no known word, are left out. Every fifth paragraph is kept for calibration.
    """
    spark = docs.sparkSession
    texts = training_texts(spark)
    known = materialise(texts.select(
        "family", "text", "template", words_of(F.col("text")).alias("words")))
    known = materialise(known.withColumn("grams", grams_of(F.col("words"))))
    templates = [(r.family, sorted(set(r.grams))) for r in known.where(
        "template").select("family", "grams").collect()]
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(negatives)
    lines = materialise(docs.select("doc_id", "text").join(
        F.broadcast(chosen), "doc_id").select(  # at most ``negatives`` ids
        F.explode(F.split("text", "\n")).alias("text")).select(
        F.lit(NONE).alias("family"), "text", words_of(F.col("text")).alias("words")))
    triples = sorted({g for _, grams in templates for g in grams if g.count(" ") == 2})
    prose = lines.withColumn("grams", grams_of(F.col("words"))).where(
        ~F.arrays_overlap("grams", F.array(*(F.lit(t) for t in triples)))).select(
        "family", "text", F.lit(False).alias("template"), "words", "grams")
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(
        known.select("grams"))
    rows = counter.transform(known.union(prose)).where(
        (F.col("family") != NONE) | (F.size(F.array_intersect(
            "grams", F.array(*(F.lit(v) for v in counter.vocabulary if " " not in v)))) > 0))
    rows = materialise(rows.withColumn("apart", ~F.col("template") & (
        F.pmod(F.xxhash64("text"), F.lit(5)) == 0)).select("family", "features", "apart"))
    index = StringIndexer(inputCol="family", outputCol="label").fit(rows)
    sized = rows.groupBy("family").count()
    weighted = index.transform(rows).where("not apart").join(
        F.broadcast(sized), "family").withColumn(  # one row per family
        "weight", 1.0 / F.col("count"))
    model = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", family="multinomial",
        elasticNetParam=0.0, regParam=1e-3, maxIter=60).fit(weighted)
    scanner = Scanner(PipelineModel([counter, model]), index.labels, [
        v for v in counter.vocabulary if " " not in v], 1.0, 0.5, templates)
    judged = best_family(scanner, model.transform(rows.where("apart"))).select(
        "family", "chance", "no_license").collect()
    threshold, limit = calibrate([(r.family, r.chance, r.no_license) for r in judged])
    return scanner._replace(threshold=threshold, limit=limit)


def calibrate(judged: list[tuple[str, float, float]]) -> tuple[float, float]:
    """The smallest chance that names a family, the largest of none to report.

    Judged are the paragraphs kept apart: their family, the chance of the best
    named family and that of none. Of paragraphs of no named family at most
    ``MAX_WRONG`` are named, and of prose at most that share is reported.
    """
    foreign = sorted((c for family, c, _ in judged if family in (NONE, UNKNOWN)), reverse=True)
    over = foreign[int(len(foreign) * MAX_WRONG):][:1]
    prose = sorted(n for family, _, n in judged if family == NONE)
    under = prose[int(len(prose) * MAX_WRONG):][:1]
    return (max(LEAST_THRESHOLD, min(over[0] + 1e-6 if over else 0.0, 0.9)),
            max(0.5, min(under[0] - 1e-6 if under else 1.0, MOST_LIMIT)))


def best_family(scanner: Scanner, scored: DataFrame) -> DataFrame:
    """Add the likeliest named family, its chance, and the chance of none."""
    chance = vector_to_array("probability")
    at = {family: i for i, family in enumerate(scanner.families)}
    named = F.array(*(F.struct(
        chance[i].alias("chance"), F.lit(family).alias("family"))
        for family, i in sorted(at.items()) if family not in (NONE, UNKNOWN)))
    best = F.array_max(named)
    return scored.withColumns({
        "guess": best["family"], "chance": best["chance"],
        "no_license": chance[at[NONE]]})


def paragraphs(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """``doc_id, line, text, words`` of all lines with a known uncommon word."""
    known = F.array(*(F.lit(w) for w in scanner.vocabulary))
    texts = docs.select("doc_id", "text").where(F.arrays_overlap(
        F.split(F.lower("text"), _NOT_WORD), known))
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.withColumn("words", words_of(F.col("text"))).where(
        F.arrays_overlap("words", known))


def template_match(scanner: Scanner, known: Column, n: Column) -> Column:
    """For each family its best match, an array of (match, family).

    ``known`` holds the paragraph's distinct n-grams that any template has and
    ``n`` counts all its distinct ones. The match is the share of the
    paragraph's n-grams, or of the template's if those are fewer, that both have.
    """
    found = []
    for family, template in scanner.templates:
        both = F.size(F.array_intersect(known, F.array(*(F.lit(g) for g in template))))
        least = F.greatest(F.least(n, F.lit(len(template))), F.lit(1))
        found.append(F.struct((both / least).alias("match"), F.lit(family).alias("family")))
    return F.array(*found)


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """One row per line that is a licence: where, which family, how sure.

    ``doc_id, line, family, chance, similarity, confirmed, text``. ``family`` is
    "unknown" for a licence of no known family. Lines count from zero. Null and
    empty texts have none; repeated rows are all reported. Reads ``doc_id`` and
    ``text`` only; an empty table gives no rows.
    """
    every = F.array(*(F.lit(g) for g in sorted(
        {g for _, template in scanner.templates for g in template})))
    # few lines are left; written, so that words and n-grams are worked out once
    lines = materialise(paragraphs(docs, scanner)).withColumn(
        "grams", grams_of(F.col("words")))
    scored = best_family(scanner, scanner.model.transform(lines)).where(
        F.col("no_license") < scanner.limit).select(
        "doc_id", "line", "text", "guess", "chance", F.array_distinct("grams").alias("grams"))
    scored = materialise(scored.select(
        "doc_id", "line", "text", "guess", "chance", F.size("grams").alias("n"),
        F.array_intersect("grams", every).alias("known")))
    scored = scored.withColumn(
        "_matches", template_match(scanner, F.col("known"), F.col("n")))
    of_guess = F.array_max(F.transform(
        F.filter("_matches", lambda m: m["family"] == F.col("guess")), lambda m: m["match"]))
    scored = scored.withColumns({"_own": of_guess, "_best": F.array_max("_matches")})
    corrected = F.col("_best.match") >= F.col("_own") + CORRECTED
    family = F.when(corrected, F.col("_best.family")).otherwise(F.col("guess"))
    similarity = F.when(corrected, F.col("_best.match")).otherwise(F.col("_own"))
    sure = (F.col("chance") >= scanner.threshold) & (similarity >= CONFIRMED)
    sure = sure | (corrected & (F.col("_best.match") >= 0.9))
    return scored.select(
        "doc_id", "line", F.when(sure, family).otherwise(UNKNOWN).alias("family"),
        F.round("chance", 6).alias("chance"), F.round(similarity, 6).alias("similarity"),
        sure.alias("confirmed"), "text")
