"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are densities of lexicon words, how near they are to a second person,
capitals, punctuation and obfuscation. Besides a short list of insults the
lexicon is learnt: words and word beginnings that are surely more frequent in
toxic than in other labelled texts. Spark counts them, Spark's own trees and
isotonic regression are fitted, and all documents are scored where they lie.

Fitting is bounded by ``FIT_TEXTS`` labelled documents. Their texts are dealt to
four folds by their digest. A text's features are taken with the lexicon of the
other folds; of two tree models each learns from two folds, and calibration is
fitted on what each says of the other's folds.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.shared import discard, materialise, ship, small_batches

#: Labelled documents that models are fitted on at most: those whose ids have the smallest digests.
FIT_TEXTS = 16_384
FOLDS = 4
TREES, DEPTH = 20, 3
#: Characters of a text that are worked on at once.
PIECE = 1 << 20
#: Lengths of word beginnings that the lexicon can hold, besides whole words.
STEMS = range(4, 9)
#: An entry's weight is the log ratio of its shares in toxic and other texts, less so many standard errors; entries below LEAST are left out.
ERRORS, LEAST, STRONG = 2.0, 0.5, 1.5
#: Words between a lexicon word and a second person that count as near.
NEAR = 4
#: Share of the uncalibrated probability in a score, which keeps documents of one calibrated value apart.
MIXED = 1e-3

# Insults, second persons, letters that look alike.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers clown pathetic worthless disgusting scum trash garbage imbecile fool jerk crap bastard bitch asshole retard whore slut "
    "arschloch dumm dummkopf vollidiot abschaum wichser hurensohn schlampe connard imbécile salaud crétin débile ordure pute idiota imbécil estúpido estúpida basura cabrón puta gilipollas".split()
)
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine deiner ihr euch euer tu toi vous votre vos usted ustedes tú vosotros".split())
ALIKE = str.maketrans("013457@$!|", "oieastasil")

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$!|*") + "«»„“”‚‘’…–—¿¡"
_LONG_RUN = re.compile(r"(.)\1{2,}")
_NO_LETTER = re.compile(r"[\W\d_]+")
_SINGLES = re.compile(r"(?<!\w)(?:[^\W\d_][\s.\-_*]+){2,}[^\W\d_](?!\w)")


def _plain(raw: str) -> tuple[str, bool]:
    """A word's letters in lower case with look-alikes undone, and whether that took more than cutting punctuation around it."""
    word = raw.strip(_EDGE).rstrip("!|*$").lower()
    if word.isalpha() and not _LONG_RUN.search(word):
        return word, False
    if not any(c.isalpha() for c in word):
        return "", False
    inner = _LONG_RUN.sub(r"\1", _NO_LETTER.sub("", word.translate(ALIKE)))
    return inner, len(inner) >= 3


def _keys(word: str):
    """Under which a word is counted: itself, and its beginnings with a star."""
    yield word
    for n in STEMS:
        if n >= len(word):
            break
        yield word[:n] + "*"


def _pieces(text: str):
    """A text's runs of about PIECE characters, cut between words; a word longer than that is cut."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        if hi < len(text):
            cut = max(text.rfind(" ", lo, hi), text.rfind("\n", lo, hi))
            hi = cut + 1 if cut > lo else hi
        yield text[lo:hi]
        lo = hi


NAMES = (
    "strong", "weak", "listed", "log_strong", "most", "three_most", "mean_weight", "by_stem", "second", "near_second", "near_share",
    "capitals", "capital_words", "exclamations", "questions", "doubled_marks", "symbols", "obfuscated", "obfuscated_hits", "spaced", "log_words", "letters",
)
_MARKS = re.compile(r"[!?]{2,}")


class Features:
    """Feature rows of texts, by a lexicon {word or beginning*: weight}."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}
        self.starts = {k[:3] for k in lexicon} | {k[:3] for k in INSULTS}

    def weigh(self, word: str) -> tuple[float, bool]:
        """Largest weight of a word's keys, and whether only a beginning gives it."""
        if word[:3] not in self.starts:
            return 0.0, False
        own = self.lexicon.get(word, 0.0)
        most = max((self.lexicon.get(k, 0.0) for k in _keys(word)), default=0.0)
        return most, most > own

    def _look(self, raw: str):
        """(weight, by a beginning, listed, second person, all capitals, obfuscated, plain word), or None for a word that is none of these."""
        word, odd = _plain(raw)
        weight, stem = self.weigh(word)
        caps = len(raw) >= 3 and raw.isupper() and word.isalpha()
        found = (weight, stem, word in INSULTS, word in SECOND, caps, odd, word)
        return found if weight or caps or odd or found[2] or found[3] else None

    def row(self, text: str) -> list[float]:
        words = strong = weak = listed = stems = second = near = caps = odd = odd_hits = spaced = marks = 0
        total, chars, last_you, waiting = 0.0, np.zeros(256, np.int64), -NEAR - 1, []
        hits: dict[str, float] = {}
        for piece in _pieces(text):
            cut = piece.split()
            for raw, n in Counter(cut).items():
                try:
                    seen = self.known[raw]
                except KeyError:
                    if len(self.known) > 300_000:
                        self.known.clear()
                    seen = self.known[raw] = self._look(raw) if len(raw) <= 64 else None
                if seen is None:
                    continue
                weight, stem, insult, you, capital, disguised, word = seen
                if weight >= STRONG or insult:
                    strong += n
                    hits[word] = max(weight, STRONG if insult else 0.0)
                weak += n * (weight > 0)
                listed += n * insult
                stems += n * (stem and weight >= STRONG)
                second += n * you
                caps += n * capital
                odd += n * disguised
                odd_hits += n * (disguised and (weight >= STRONG or insult))
                total += n * weight
            # without both kinds of words only the last ones can be near to some of the next piece
            span = cut if hits and second else cut[-NEAR:]
            for i, raw in enumerate(span, words + len(cut) - len(span)):
                seen = self.known.get(raw)
                if seen is None:
                    continue
                if seen[3]:
                    near += sum(i - j <= NEAR for j in waiting)
                    last_you, waiting = i, []
                if seen[0] >= STRONG or seen[2]:
                    if i - last_you <= NEAR:
                        near += 1
                    else:
                        waiting = [j for j in waiting if i - j <= NEAR] + [i]
            for run in _SINGLES.findall(piece):
                word = _NO_LETTER.sub("", run).lower()
                if word in INSULTS or self.weigh(word)[0] >= STRONG:
                    spaced += 1
                    hits[word] = STRONG
            words += len(cut)
            marks += len(_MARKS.findall(piece))
            chars += np.bincount(np.frombuffer(piece.encode("utf-8", "replace"), np.uint8), minlength=256)
        size, n = max(int(chars.sum()), 1), max(words, 1)
        upper, lower = int(chars[65:91].sum()), int(chars[97:123].sum())
        beyond = int(chars[0xC0:].sum())
        count = lambda s: sum(int(chars[ord(c)]) for c in s)
        best = sorted(hits.values(), reverse=True)[:3]
        return [
            strong / n, weak / n, listed / n, math.log1p(strong), max(best, default=0.0), sum(best), total / n, stems / n, second / n, near / n, near / max(strong, 1),
            upper / max(upper + lower, 1), caps / n, count("!") / n, count("?") / n, marks / n, count("#*$%&|<>@^~") / size, odd / n, odd_hits / n, float(spaced), math.log1p(words), (upper + lower + beyond) / size,
        ]


def _feature_rows(lexicons: list[dict[str, float]], folds: bool):
    """Adds ``features`` to rows (.., text[, fold]); the text leaves."""

    def run(batches):
        by = [Features(x) for x in lexicons]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            which = batch.column("fold").to_pylist() if folds else [0] * len(texts)
            rows = [by[f].row(t or "") for f, t in zip(which, texts)]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.record_batch([*(batch.column(n) for n in kept), pa.array(rows, pa.list_(pa.float64()))], [*kept, "features"])

    return run


#: Keys that a task counts before it hands them on.
HELD_KEYS = 500_000


def _key_counts(batches):
    """(key, fold, toxic and other texts that hold it), summed over a task's texts."""
    held: dict[tuple[str, int], list[int]] = {}

    def out():
        keys, folds = zip(*held)
        toxic, other = zip(*held.values())
        return pa.record_batch([pa.array(keys), pa.array(folds, pa.int32()), pa.array(toxic, pa.int64()), pa.array(other, pa.int64())], ["key", "fold", "toxic", "other"])

    for batch in batches:
        for text, fold, label in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "label"))):
            words = {w for piece in _pieces(text or "") for w in piece.split() if len(w) <= 64}
            for key in {k for w in words if (p := _plain(w)[0]) for k in _keys(p)}:
                held.setdefault((key, fold), [0, 0])[0 if label else 1] += 1
            if len(held) > HELD_KEYS:
                yield out()
                held.clear()
    if held:
        yield out()


def entry_weight(toxic, other, all_toxic, all_other):
    """Log ratio of an entry's shares in toxic and other texts, less ERRORS standard errors."""
    ratio = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((other + 0.5) / (all_other + 1))
    return ratio - ERRORS * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


def learn_lexicons(fit: DataFrame) -> list[dict[str, float]]:
    """The lexicon of all folds but one, for each, and last that of all.

    What reaches the driver are entries of at most FIT_TEXTS texts that three
    toxic ones share and that are surely more frequent in those.
    """
    sizes = {(r["fold"], r["label"]): r["count"] for r in fit.groupBy("fold", "label").count().collect()}
    size = lambda label, but: sum(n for (f, x), n in sizes.items() if x == label and f != but)
    per = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("toxic", "other")]
    counts = fit.mapInArrow(_key_counts, "key string, fold int, toxic bigint, other bigint").groupBy("key").agg(*per)
    toxic, other = (sum(F.col(f"{c}{f}") for f in range(FOLDS)) for c in ("toxic", "other"))
    # the weight itself needs no more than this at the least
    likelier = (toxic >= 3) & (toxic * max(size(0.0, -1), 1) > other * max(size(1.0, -1), 1))
    rows = counts.where(likelier).toPandas()
    out = []
    for but in [*range(FOLDS), -1]:
        n = {c: sum(rows[f"{c}{f}"].to_numpy(np.float64) for f in range(FOLDS) if f != but) for c in ("toxic", "other")}
        weights = entry_weight(n["toxic"], n["other"], size(1.0, but), size(0.0, but))
        keep = (n["toxic"] >= 3) & (weights >= LEAST)
        out.append(dict(zip(rows["key"][keep], weights[keep].tolist())))
    return out


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label must not be learnt from; without an id it is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame, doc_id: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """(text, label, fold) of the labelled rows to learn from: each text once, with the label that most of its ids have (ties: toxic).

    Ids are chosen first, by their digest, so no more than ``limit`` of them
    meet the documents; of an id with several texts the least is taken.
    """
    one = labels.where(F.col(label_col).isin(0, 1) & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("__id")).agg(F.avg(F.col(label_col).cast("double")).alias("__toxic"))
    chosen = one.orderBy(F.sha2(F.col("__id").cast("string").cast("binary"), 256)).limit(limit)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("__id"), text.alias("text")).join(F.broadcast(chosen), "__id")
    # an id can have many rows: its least text is found in their tasks first
    least = rows.groupBy("__id").agg(F.min("text").alias("text"), F.min("__toxic").alias("toxic"))
    distinct = least.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("text").alias("text"), F.avg("toxic").alias("toxic"))
    return distinct.select("text", (F.col("toxic") >= 0.5).cast("double").alias("label"), (F.conv(F.substring("digest", 1, 4), 16, 10).cast("int") % FOLDS).alias("fold"))


@dataclass
class ToxicityModel:
    """A lexicon, two tree models and a calibration; or a single score where the labels have one class."""

    lexicon: dict[str, float]
    trees: list
    calibration: object
    prior: float

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with an array ``features`` get ``score`` in its place."""
        if not self.trees:
            return rows.withColumn("score", F.lit(self.prior)).drop("features")
        out = raw_scores(rows.withColumn("__v", array_to_vector("features")).drop("features"), self.trees, "__raw")
        out = self.calibration.transform(out)
        score = F.least(F.greatest((1 - MIXED) * F.col("__level") + MIXED * F.col("__raw"), F.lit(0.0)), F.lit(1.0))
        return out.withColumn("score", score).drop("__v", "__raw", "__level")


def raw_scores(rows: DataFrame, trees: list, name: str) -> DataFrame:
    """The models' mean probability of a toxic text."""
    given = rows.columns
    for i, model in enumerate(trees):
        rows = model.setFeaturesCol("__v").setProbabilityCol(f"__p{i}").setRawPredictionCol(f"__r{i}").setPredictionCol(f"__y{i}").transform(rows)
    return rows.select(*given, (sum(vector_to_array(F.col(f"__p{i}"))[1] for i in range(len(trees))) / len(trees)).alias(name))


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = FIT_TEXTS) -> ToxicityModel:
    """A model of the labelled texts that aren't held out, at most ``limit`` of them.

    Labels other than 0 and 1 are left out, an id with several has their
    majority. Without toxic texts in both halves of the folds, and others, every score is
    the toxic share of the texts (0 without any).
    """
    spark = docs.sparkSession
    ship(spark)
    fit = materialise(labelled_texts(docs, labels, doc_id, text_col, label_col, limit), "labelled")
    n = {(r["half"], r["label"]): r["count"] for r in fit.groupBy((F.col("fold") % 2).alias("half"), "label").count().collect()}
    toxic, every = sum(c for (_, x), c in n.items() if x), sum(n.values())
    prior = toxic / every if every else 0.0
    if len(n) < 4:
        discard(fit)
        return ToxicityModel({}, [], None, prior)
    with small_batches(spark):
        *others, lexicon = learn_lexicons(fit)
        featured = fit.mapInArrow(_feature_rows(others, True), "label double, fold int, features array<double>")
        table = materialise(featured, "features")
    rows = table.withColumn("__v", array_to_vector("features")).withColumn("half", F.col("fold") % 2).coalesce(2 * max(1, spark.sparkContext.defaultParallelism // 4))
    learner = GBTClassifier(labelCol="label", featuresCol="__v", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=1, minInstancesPerNode=3)
    halves = [learner.fit(rows.where(f"half = {h}").select("__v", "label")) for h in (0, 1)]
    said = [raw_scores(rows.where(f"half = {1 - h}").select("__v", "label"), [halves[h]], "__raw") for h in (0, 1)]
    calibration = IsotonicRegression(featuresCol="__raw", labelCol="label", predictionCol="__level").fit(said[0].unionByName(said[1]).select("__raw", "label"))
    discard(fit, table)
    return ToxicityModel(lexicon, halves, calibration, prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = FIT_TEXTS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only the text makes a score. Null and empty texts are scored as texts
    without words. Equal texts have equal scores; repeated rows are scored
    each. Whole texts are read, by pieces of a megabyte; a word beyond 64
    characters is no lexicon word. Other columns don't matter, whatever their
    names. Empty tables: no rows, or, without labels, scores of 0.
    """
    model = fit_toxicity(docs, labels, doc_id, text_col, label_col, limit)
    rows = docs.select(F.col(doc_id).alias("__id"), held_out(doc_id).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["__id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        featured = materialise(rows.mapInArrow(_feature_rows([model.lexicon], False), f"__id {kind}, held_out boolean, features array<double>"), "features")
    scored = model.score(featured)
    return scored.select(F.col("__id").alias(doc_id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
