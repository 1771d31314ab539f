"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text, whatever its labels, is unlabelled. Linear classifiers are
trained in numpy with the non-negative estimator of the risk:

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]),     l(z) = log(1 + exp(-z))

where pi is the class prior. When the second term, the risk on the unseen negatives, falls below zero, the classifier
has begun to fit the unlabelled set itself, and the step goes against that term. Steps take the unlabelled texts in
small batches; the mean of the later half of the steps is the classifier. Its bias is then moved to where the same
estimator, with the zero-one loss for l, is least, halfway to the next text below, so that a score of 0.5 parts the
classes.

Features are words, and beginnings of words (so many characters) at several LEVELS: whether a text has it so many
times. Those that the positives have more often than chance allows are used (Chernoff's bound on a Poisson count, with
the expectation from all unlabelled texts); what isn't over-represented counts against toxicity by the bias alone.

Every document that isn't held out is unlabelled text to learn from: its features are counted over all of them, and all
of them are dealt to shards of about SHARD_TEXTS texts, whose CLASSIFIERS classifiers are trained in a task of their own. The model is
the mean of their weights, summed as whole numbers, so it depends neither on the order of rows nor on partitions. Equal
texts count once, or one document's words would pass for many's.

Settings are chosen by `fold_errors` and `best`: folds of the labelled rows that are learned from, each left out of the
texts and labels once. Rows that are held out from learning have no part in it.

Bound: at most MAX_POSITIVE labelled positives are learned from, those with the lowest hashes of their doc_ids; they
bound the features, and with them what is broadcast or sent to the driver. Scores cover every word of every document.

Defined cases: null text counts as empty and is scored by the bias alone; very long texts are read whole, one at a time;
a null doc_id is held out and never learned from; labels without a document and null labels are ignored; repeated
labels of a document count once, toxic if any of them is; rows that agree in doc_id and text count once, and each gets
its row of scores. Without confirmed positives every score is near 0; with fewer than LEAST_DOCUMENTS different texts
of them no feature is learned, and every text gets the score of the bias. Equal texts get equal scores. An empty table gives no rows. Only doc_id and text (and
the labels' doc_id and toxic) are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled positives that are learned from.
MAX_POSITIVE = 5_000
#: Times that a text has a beginning, powers of two.
LEVELS = (1, 2, 4, 8, 16)
#: Positives that must have a feature; how unlikely its count there must be by chance: so many nats beyond one false find among all features tried (below 0: some false finds, which training weighs down).
LEAST_DOCUMENTS, SURPRISE = 3, -3.0
#: Part of the documents that is not learned from: those with crc32(doc_id) mod FOLDS = 0.
FOLDS = 5
#: Unlabelled texts of one classifier; steps and their size.
SHARD_TEXTS, STEPS, RATE = 10_000, 800, 0.3
#: Classifiers of each shard, which differ in the order of their batches.
CLASSIFIERS = 3
#: Size of the step against a negative risk that has fallen below zero.
BACK = 0.5
#: Weights are summed in this unit.
UNIT = 2.0**-24
#: Words whose features a worker remembers.
REMEMBERED = 300_000

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """prefixes: lengths of the beginnings of longer words; batch, positive_batch: unlabelled texts and positives in a step; decay: of weights."""

    prefixes: tuple[int, ...] = (6,)
    batch: int = 1024
    positive_batch: int = 384
    decay: float = 1e-3


DEFAULT = Settings()
#: What `best` chose the default from.
_FIVE = replace(DEFAULT, prefixes=(5,))
GRID = (_FIVE, replace(_FIVE, decay=3e-4), replace(_FIVE, decay=3e-3), replace(_FIVE, prefixes=(4,)), replace(_FIVE, prefixes=(6,)), replace(_FIVE, batch=512, positive_batch=192))


def keys_of(word: str, prefixes: tuple[int, ...] = DEFAULT.prefixes) -> list[str]:
    """The word and its beginnings, which "^" tells from words."""
    return [word, *("^" + word[:q] for q in prefixes if len(word) > q)]


def levels_of(key: str) -> tuple[int, ...]:
    return LEVELS if key[0] == "^" else LEVELS[:1]


@dataclass
class Features:
    """upto: by key, for each number of levels that a text reaches, the columns of those that are used. seen: words looked at so far; known: those of them with keys among these: the word's own columns, and its beginnings."""

    upto: dict[str, list[list[int]]]
    prefixes: tuple[int, ...] = DEFAULT.prefixes
    seen: set[str] = field(default_factory=set)
    known: dict[str, tuple[list[int], list[str]]] = field(default_factory=dict)

    def of(self, text: str | None) -> list[int]:
        """Columns of the features that the text has, in no order."""
        words, upto = Counter(_WORD.findall((text or "").lower())), self.upto
        if new := words.keys() - self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen, self.known, new = set(), {}, words.keys()
            self.seen |= new
            for word in new:
                own, starts = upto.get(word), [k for k in keys_of(word, self.prefixes)[1:] if k in upto]
                if own or starts:
                    self.known[word] = own[1] if own else [], starts
        out: list[int] = []
        counts: dict[str, int] = {}
        for word in words.keys() & self.known.keys():
            own, starts = self.known[word]
            out += own
            for k in starts:
                counts[k] = counts.get(k, 0) + words[word]
        most = len(LEVELS)
        for k, n in counts.items():
            out += upto[k][min(n.bit_length(), most)]
        return out

    @classmethod
    def numbered(cls, features, prefixes: tuple[int, ...] = DEFAULT.prefixes) -> Features:
        """features: (key, level) pairs; their columns are their places."""
        upto: dict[str, list[list[int]]] = {}
        for at, (key, level) in enumerate(features):
            reached = upto.setdefault(key, [[] for _ in range(len(LEVELS) + 1)])
            for k in range(LEVELS.index(level) + 1, len(LEVELS) + 1):
                reached[k].append(at)
        return cls(upto, prefixes)


@dataclass
class Model:
    """weights: of each column, and last the bias."""

    features: Features
    weights: np.ndarray

    def score(self, texts) -> np.ndarray:
        w, bias = self.weights[:-1], self.weights[-1]
        return sigmoid(np.array([w[sorted(self.features.of(t))].sum() for t in texts], dtype=float) + bias)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def as_sparse(lists) -> tuple[np.ndarray, np.ndarray]:
    """(start of each row and the end, columns)."""
    ends = np.cumsum([0, *map(len, lists)])
    return ends, np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)


def rows_of(sparse, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries of some rows, which are numbered anew."""
    ends, columns = sparse
    lengths = ends[some + 1] - ends[some]
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.arange(len(some)), lengths), columns[np.arange(lengths.sum()) + np.repeat(ends[some] - before, lengths)]


def deal(rng, n: int, size: int) -> Iterator[np.ndarray]:
    """Batches of 0 to n - 1 without end, each round in a new order."""
    while True:
        order = rng.permutation(n)
        yield from (order[at : at + size] for at in range(0, n, size))


def train(positive, unlabelled, n_columns: int, prior: float, seed: int = 0, settings: Settings = DEFAULT) -> np.ndarray:
    """Weights and bias of one classifier. positive, unlabelled: lists of columns of each text."""
    rng, bias = np.random.default_rng(seed), np.log(prior / (1 - prior))
    of_positive, of_unlabelled = as_sparse(positive), as_sparse(unlabelled)
    w, later = np.append(np.zeros(n_columns), bias), np.zeros(n_columns + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    next_positive, next_unlabelled = deal(rng, len(positive), settings.positive_batch), deal(rng, len(unlabelled), settings.batch)
    for step in range(1, STEPS + 1):
        chosen, some = next(next_positive), next(next_unlabelled)
        (p_rows, p_columns), (rows, columns) = rows_of(of_positive, chosen), rows_of(of_unlabelled, some)
        gp = np.bincount(p_rows, w[p_columns], len(chosen)) + w[-1]
        gu = np.bincount(rows, w[columns], len(some)) + w[-1]
        back_p, back_u = -prior / len(chosen) * sigmoid(gp), sigmoid(gu) / len(some)  # slopes of the risk on negatives
        if np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean() >= 0:
            back_p -= prior / len(chosen) * sigmoid(-gp)
        else:
            back_p, back_u = -BACK * back_p, -BACK * back_u
        grad = np.append(np.bincount(p_columns, back_p[p_rows], n_columns) + np.bincount(columns, back_u[rows], n_columns), back_p.sum() + back_u.sum())
        grad[:-1] += settings.decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if step > STEPS // 2:
            later += w
    w = later / (STEPS - STEPS // 2)
    gp, gu = (np.bincount(rows, w[columns], len(ends) - 1) + w[-1] for ends, columns in (of_positive, of_unlabelled) for rows in [np.repeat(np.arange(len(ends) - 1), np.diff(ends))])
    cuts = np.unique(gp)
    missed, marked_u = np.searchsorted(np.sort(gp), cuts, "left") / len(gp), 1 - np.searchsorted(np.sort(gu), cuts, "left") / len(gu)
    cut = cuts[np.argmin(prior * missed + np.maximum(0.0, marked_u - prior * (1 - missed)))]
    below = np.concatenate((gp[gp < cut], gu[gu < cut]))
    w[-1] -= (cut + below.max()) / 2 if len(below) else cut - 1
    return w


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = DEFAULT) -> Model:
    """Learns from rows that aren't held out."""
    spark = docs.sparkSession
    common.small_batches(spark)
    labels = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n_known, n_toxic = labels.agg(F.count("*"), F.sum("toxic")).first()
    none = Model(Features({}), np.array([-35.0]))
    if not n_toxic:
        return none
    prior = min(max(n_toxic / n_known, 1e-3), 0.9)
    ids = common.materialise(labels.filter("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POSITIVE))
    learned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(common.text_or_empty(), F.octet_length(common.text_or_empty())).alias("same")).filter(F.col("doc_id").isNotNull()).filter(~held_out())
    learned = learned.join(F.broadcast(ids.select(F.col("doc_id").alias("toxic_id"))), F.col("doc_id") == F.col("toxic_id"), "left")  # MAX_POSITIVE ids
    groups = common.materialise(learned.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max(F.col("toxic_id").isNotNull()).alias("p")))
    n_u, n_p = groups.agg(F.count("*"), F.count_if("p")).first()
    if not n_p:
        return none
    copied = common.materialise(groups.filter("n > 1").select("same", "first"))
    once = common.lookup(learned, copied, "same", "left").filter(F.coalesce(F.col("first") == F.col("doc_id"), F.lit(True)))
    each_once = once.filter("first IS NULL").select("text").unionByName(once.filter("first IS NOT NULL").groupBy("same").agg(F.min("text").alias("text")).select("text"))  # of copies, a row that is there twice

    @F.pandas_udf("array<string>")
    def all_features(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            counts: Counter = Counter()
            for word, n in Counter(_WORD.findall((text or "").lower())).items():
                for k in keys_of(word, settings.prefixes):
                    counts[k] += n
            out.append([f"{level} {k}" for k, n in counts.items() for level in levels_of(k) if n >= level])
        return pd.Series(out)

    positives = learned.filter(F.col("toxic_id").isNotNull()).groupBy("same").agg(F.min("text").alias("text"))
    found = positives.select(F.explode(all_features("text")).alias("feature")).groupBy("feature").count().filter(F.col("count") >= LEAST_DOCUMENTS)
    in_positive = {r["feature"]: r["count"] for r in found.collect()}  # bounded by the positives
    split = lambda names: [(n.partition(" ")[2], int(n.partition(" ")[0])) for n in names]
    names = sorted(in_positive)
    candidates = spark.sparkContext.broadcast(Features.numbered(split(names), settings.prefixes))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums = candidates.value, Counter()
        for pdf in batches:
            for text in pdf["text"]:
                sums.update(own.of(text))
        yield pd.DataFrame({"at": list(sums), "n": list(sums.values())})

    counts = {r["at"]: r["n"] for r in each_once.mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # by feature
    p = np.array([in_positive[n] for n in names], dtype=float)
    e = (np.array([counts.get(k, 0) for k in range(len(names))]) + 1) * n_p / n_u
    surprise = p * np.log(p / e) - p + e
    picked = np.flatnonzero((p > e) & (surprise >= np.log(max(1, len(names))) + SURPRISE))
    features = Features.numbered(split([names[k] for k in picked]), settings.prefixes)
    shared = spark.sparkContext.broadcast(features)

    @F.pandas_udf("array<int>")
    def columns_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([sorted(shared.value.of(t)) for t in some])

    texts = common.materialise(once.select("same", columns_of("text").alias("at")).groupBy("same").agg(F.min("at").alias("at")))
    toxic = groups.filter("p").select("same")
    positive = spark.sparkContext.broadcast([list(r["at"]) for r in texts.join(F.broadcast(toxic), "same").orderBy("same").select("at").collect()])  # MAX_POSITIVE texts
    n_shards = max(1, round(n_u / SHARD_TEXTS))

    def learn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        unlabelled = list(pdf.sort_values("same")["at"])
        w = np.mean([train(positive.value, unlabelled, len(picked), prior, CLASSIFIERS * int(key[0]) + k, settings) for k in range(CLASSIFIERS)], axis=0)
        return pd.DataFrame({"place": np.arange(len(w)), "w": np.rint(w / UNIT).astype(np.int64)})

    dealt = texts.select("same", "at", F.pmod(F.xxhash64("same"), F.lit(n_shards)).cast("int").alias("shard"))
    trained = dealt.groupBy("shard").applyInPandas(learn, "place int, w long")
    sums = {r["place"]: (r["w"], r["n"]) for r in trained.groupBy("place").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()}
    weights = np.array([sums[k][0] / sums[k][1] * UNIT for k in range(len(picked) + 1)])
    return Model(features, weights)


def scorer(spark, model: Model):
    """A function of a text column that gives its scores."""
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the positives

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series(shared.value.score(some))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(docs.sparkSession, model)(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fold_of(folds: int):
    """The fold of a row that is learned from, independent of held_out."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(folds)).cast("int")


def fold_errors(docs: DataFrame, labels: DataFrame, grid=GRID, folds: int = 4) -> list[tuple[Settings, int, int, int]]:
    """(settings, right, wrong, missed) for each of the grid: labelled rows of all folds that are toxic and marked, marked only, toxic only.

    A fold's rows are left out of the texts and of the labels that its model learns from, and rows that are held out
    from learning are left out throughout, so the choice sees none of their labels. Costs a `fit` for each fold and setting.
    """
    learned = docs.filter(F.col("doc_id").isNotNull()).filter(~held_out())
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    known = common.materialise(known.withColumn("fold", fold_of(folds)))
    out = []
    for settings in grid:
        total = np.zeros(3, dtype=int)
        for k in range(folds):
            model = fit(learned.filter(fold_of(folds) != k), known.filter(F.col("fold") != k).select("doc_id", F.col("toxic").cast("int").alias("toxic")), settings)
            asked = learned.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known.filter(F.col("fold") == k), "doc_id")
            marked = asked.select("toxic", (scorer(docs.sparkSession, model)("text") >= 0.5).alias("marked"))
            total += np.array(marked.agg(*[F.count_if(F.expr(e)) for e in ("toxic AND marked", "NOT toxic AND marked", "toxic AND NOT marked")]).first())
        out.append((settings, *map(int, total)))
    return out


def best(errors) -> Settings:
    """The settings of the highest F1; of equal ones the first in the grid."""
    f1 = lambda right, wrong, missed: 2 * right / max(1, 2 * right + wrong + missed)
    return max(errors, key=lambda e: f1(*e[1:]))[0]


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted to be toxic, with all their columns."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series(shared.value.score(some) < 0.5)

    return docs.filter(clean(F.col("text").cast("string")))


def op2_toxicity(spark, sf_dir) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
