"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 severe, ...  All thresholds share one
weight vector w:  P(grade <= j) = sigmoid(theta_j - w.x), theta_0 < theta_1 < ...
The expected severity is the sum over j of P(grade > j).

Features are the distinct words of the whole text and the beginnings of those
words, each hashed into one fixed space; x counts the distinct words of a
bucket, so w.x is a sum over words.  No feature is chosen beforehand: an L1
penalty leaves most weights at exactly zero.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table, written

#: The fit takes at most so many labelled documents (lowest hashes of doc_id).
MAX_LABELLED = 8_000
LETTERS = r"[^\p{L}]+"
#: Hashed features: the space is fixed, beginnings have so many characters, 0 is the word itself.
BUCKETS = 1 << 18
LENGTHS = (0, 4, 5, 6, 7)
#: Labelled documents are held out by parts, to choose the penalty and the threshold.
FOLDS = 3
N_GRADES = 3
PENALTIES = (0.006, 0.003)
STEPS = 60
#: Fewer toxic ones than this can't place a threshold: the first penalty and 0.5 are taken.
ENOUGH = 50


@dataclass
class CumulativeLink:
    """Weights of the buckets that have one, and the ordered thresholds."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    reject_at: float = 0.5


def word_set(text: Column) -> Column:
    """Distinct lower-case runs of letters; empty for null."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), LETTERS)), lambda w: w != "")


def bucket(word: Column, length: int) -> Column:
    """The bucket of a word (length 0), or of its beginning of so many characters."""
    part = F.substring(word, 1, length) if length else word
    return F.xxhash64(part, F.lit(length)).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def buckets(words: Column) -> Column:
    """The bucket of each word and of each of its beginnings, repeats included."""

    def of(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.char_length(w) >= k), lambda w: bucket(w, k))

    return F.concat(*map(of, LENGTHS))


# The sparse fit


@dataclass
class Rows:
    """Sparse rows in coordinates: row `doc[i]` has `value[i]` in bucket `at[i]`."""

    doc: np.ndarray
    at: np.ndarray
    value: np.ndarray
    n: int

    def part(self, chosen: np.ndarray) -> Rows:
        number = (np.cumsum(chosen) - 1).astype(np.int32)
        keep = chosen[self.doc]
        return Rows(number[self.doc[keep]], self.at[keep], self.value[keep], int(chosen.sum()))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, w[self.at] * self.value, self.n)

    def transposed(self, r: np.ndarray, d: int) -> np.ndarray:
        return np.bincount(self.at, r[self.doc] * self.value, d)


def slopes(eta: np.ndarray, theta: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the mean log loss by each row's eta and by each threshold."""
    n, k = len(eta), len(theta)
    s = 1 / (1 + np.exp(-np.clip(theta[None, :] - eta[:, None], -30, 30)))
    edge = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], axis=1)
    slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
    rows = np.arange(n)
    prob = np.maximum(edge[rows, grade + 1] - edge[rows, grade], 1e-9)
    up, down = slope[rows, grade + 1] / prob, slope[rows, grade] / prob
    by_theta = np.array([((down * (grade == j + 1)).sum() - (up * (grade == j)).sum()) / n for j in range(k)])
    return (up - down) / n, by_theta


def start(grade: np.ndarray, n_grades: int) -> np.ndarray:
    """Thresholds of the grades' shares, without any features."""
    share = np.array([np.clip((grade <= j).mean(), 1e-4, 1 - 1e-4) for j in range(n_grades - 1)])
    return np.maximum.accumulate(np.log(share / (1 - share)) + 1e-2 * np.arange(n_grades - 1))


def feature_scale(total: np.ndarray, square: np.ndarray, n: int) -> np.ndarray:
    """One over the root of each feature's standard deviation, from its sums over n rows; 0 where it never occurs."""
    spread = np.sqrt(np.maximum(square / n - (total / n) ** 2, 0))
    return np.where(square > 0, np.maximum(spread, 1 / np.sqrt(n)) ** -0.5, 0)


def fit_sparse(rows: Rows, grade: np.ndarray, n_grades: int, l1: float, *, d: int = BUCKETS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least log loss + l1 * sum |w_j| * s_j, by accelerated proximal gradient steps.

    s_j is the root of the standard deviation of feature j, which lies between
    a penalty on the raw and on the standardised features.  Features whose
    gradient without any weights is under half of the penalty are left at zero
    from the start, as the penalty would set them there.  What is left is
    fitted again with a tenth of the penalty.
    """
    theta = start(grade, n_grades)
    scale = feature_scale(np.bincount(rows.at, rows.value, d), np.bincount(rows.at, rows.value**2, d), rows.n)
    first = rows.transposed(slopes(np.zeros(rows.n), theta, grade)[0], d) * scale
    active = np.flatnonzero(np.abs(first) > l1 / 2)
    w, theta = _descend(rows, grade, scale, active, theta, np.zeros(len(active)), l1, steps)
    chosen = np.flatnonzero(w)
    w, theta = _descend(rows, grade, scale, active[chosen], theta, w[chosen], l1 / 10, steps)  # the penalty has chosen; now it would only shrink
    weights = np.zeros(d)
    weights[active[chosen]] = w * scale[active[chosen]]
    return weights, theta


def _descend(rows: Rows, grade: np.ndarray, scale: np.ndarray, active: np.ndarray, theta: np.ndarray, w: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient steps over the scaled features in `active`, from w and theta on."""
    if not len(active):
        return w, theta
    m, first = len(active), np.arange(len(theta)) == 0
    place = np.full(len(scale), -1, dtype=np.int32)
    place[active] = np.arange(m)
    keep = place[rows.at] >= 0
    x = Rows(rows.doc[keep], place[rows.at[keep]], (rows.value * scale[rows.at])[keep], rows.n)
    v = np.ones(m)
    for _ in range(8):  # the greatest curvature, by power iteration
        v = x.transposed(x.times(v), m) / rows.n
        curve = np.linalg.norm(v)
        v /= max(curve, 1e-12)
    step = 1 / (0.3 * (curve + 1))
    ahead, ahead_theta, t = w.copy(), theta.copy(), 1.0
    for _ in range(steps):
        by_eta, by_theta = slopes(x.times(ahead), ahead_theta, grade)
        new = ahead - step * x.transposed(by_eta, m)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_theta = ahead_theta - step * by_theta
        new_theta = np.where(first, new_theta, np.maximum.accumulate(new_theta) + 1e-3)  # stay ordered
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_theta = new + (t - 1) / after * (new - w), new_theta + (t - 1) / after * (new_theta - theta)
        w, theta, t = new, new_theta, after
    return w, theta


def fit_thresholds(x: np.ndarray, grade: np.ndarray, n_grades: int, l1: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for the rows of a dense matrix."""
    doc, at = np.nonzero(x)
    return fit_sparse(Rows(doc, at, x[doc, at].astype(np.float64), len(x)), grade, n_grades, l1, d=x.shape[1], steps=steps)


def best_threshold(p: np.ndarray, toxic: np.ndarray, above: float) -> tuple[float, float]:
    """F1 and threshold, of those greater than `above`, that tell held-out rows best; on ties the nearest to 0.5."""
    tried = [t for t in np.arange(5, 96) / 100 if t > above] or [0.99]
    f1 = [2 * float(toxic[p >= t].sum()) / max(1, (p >= t).sum() + toxic.sum()) for t in tried]
    best = min(range(len(tried)), key=lambda i: (-f1[i], abs(tried[i] - 0.5)))
    return f1[best], float(tried[best])


def sample(documents: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Features, grades and parts of the labelled documents, each different text once.

    Grades come from the labels alone: 0 where toxic is 0, 1 where it is 1,
    and 2 where quality, if there is such a column, is 0 besides.
    """
    worse = F.when(F.col("quality") == 0, 1).otherwise(0) if "quality" in labels.columns else F.lit(0)
    grade = F.when(F.col("toxic") == 0, 0).otherwise(1 + worse)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = documents.select("doc_id", text.alias("text")).join(F.broadcast(known), "doc_id")
    found = found.select(F.md5("text").alias("key"), "grade", buckets(word_set(F.col("text"))).alias("at")).groupBy("key").agg(F.max("grade").alias("grade"), F.any_value("at").alias("at"))
    fold = F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int")
    got = written(found.select("grade", fold.alias("fold"), "at"), "toxicity").toArrow()  # at most max_labelled rows
    grade = np.array(got["grade"], dtype=np.int64)

    def portions():
        for i in range(0, got.num_rows, 500):  # repeats are counted by portions, so that little is held at once
            at = got["at"].slice(i, 500).combine_chunks()
            sizes = np.asarray(at.value_lengths(), dtype=np.int64)
            pair, value = np.unique(np.repeat(np.arange(i, i + len(sizes)), sizes) * BUCKETS + np.asarray(at.flatten(), dtype=np.int64), return_counts=True)
            yield (pair // BUCKETS).astype(np.int32), (pair % BUCKETS).astype(np.int32), value.astype(np.float32)

    # what a fit to all rows leaves at zero from the start needn't be held for the fits to parts of them, either
    by_eta = slopes(np.zeros(len(grade)), start(grade, N_GRADES), grade)[0] if len(grade) else np.zeros(0)
    total, square, first = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for doc, at, value in portions():
        total += np.bincount(at, value, BUCKETS)
        square += np.bincount(at, value * value, BUCKETS)
        first += np.bincount(at, by_eta[doc] * value, BUCKETS)
    held = np.abs(first) * feature_scale(total, square, max(1, len(grade))) > min(PENALTIES) / 4
    parts = [(doc[k], at[k], value[k]) for doc, at, value in portions() for k in [held[at]]]
    doc, at, value = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
    return Rows(doc, at, value, got.num_rows), grade, np.array(got["fold"], dtype=np.int64)


def fit(documents: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> CumulativeLink:
    """Fits the model to labels(doc_id, toxic[, quality]), toxic 0 or 1.

    Bound: the max_labelled doc_ids with the lowest hash, a doc_id labelled
    more than once counting by its highest grade, equal texts counting once.
    The penalty and reject_at are those of the greatest F1 on labelled
    documents that the weights were not taken from: each of FOLDS parts is
    judged by a fit to the others; with fewer than ENOUGH toxic ones they are
    the first penalty and 0.5.  Null doc_ids and labels are left out; without
    both toxic and clean examples (an empty table among them) the model finds
    everything clean.
    """
    rows, grade, fold = sample(documents, labels, max_labelled=max_labelled)
    toxic = (grade > 0).astype(int)
    if not 0 < toxic.sum() < len(toxic):
        return CumulativeLink(thresholds=[30.0, 31.0])
    l1, reject_at = PENALTIES[0], 0.5
    if toxic.sum() >= ENOUGH:
        scores = {}
        for tried in PENALTIES:
            held, above = np.zeros(rows.n), 0.0
            for k in range(FOLDS):
                w, theta = fit_sparse(rows.part(fold != k), grade[fold != k], N_GRADES, tried)
                held[fold == k] = 1 / (1 + np.exp(np.clip(theta[0] - rows.part(fold == k).times(w), -30, 30)))
                above = max(above, 1 / (1 + np.exp(theta[0])))  # a text without any word that is known
            scores[tried] = best_threshold(held, toxic, above)
        l1 = max(PENALTIES, key=lambda v: scores[v][0])
        reject_at = scores[l1][1]
    w, theta = fit_sparse(rows, grade, N_GRADES, l1)
    return CumulativeLink({int(i): float(w[i]) for i in np.flatnonzero(w)}, [float(t) for t in theta], max(reject_at, 1 / (1 + float(np.exp(theta[0]))) + 0.01))


def severity(text: Column, model: CumulativeLink) -> Column:
    """w.x of the whole text: the sum of its distinct words' weights, each looked up by its place in an array."""
    if not model.weights:
        return F.lit(0.0)
    dense = np.zeros(BUCKETS)
    dense[list(model.weights)] = list(model.weights.values())
    # a constant that the optimizer folds into one array, not a column for each element
    weights = F.from_json(F.lit(json.dumps([round(v, 7) if v else 0 for v in dense.tolist()], separators=(",", ":"))), "array<double>")
    words, empty = word_set(text), F.lit(0.0)

    def summed(table: Column) -> Column:
        def weight(w: Column, k: int) -> Column:
            found = F.get(table, bucket(w, k))
            return found if k == 0 else F.when(F.char_length(w) >= k, found).otherwise(empty)

        return F.aggregate(words, empty, lambda s, w: sum((weight(w, k) for k in LENGTHS), s))

    return F.transform(F.array(weights), summed)[0]  # so that the plan holds the array once


def probability(text: Column, model: CumulativeLink, least: int = 1) -> Column:
    """P(grade >= least)."""
    return 1 / (1 + F.exp(F.lit(model.thresholds[least - 1]) - severity(text, model)))


def clean(documents: DataFrame, model: CumulativeLink, *, reject_at: float | None = None) -> DataFrame:
    """The rows that aren't rejected, with their own columns alone, whatever those are called."""
    return documents.where(probability(F.col("text"), model) < F.lit(model.reject_at if reject_at is None else reject_at))


def score(documents: DataFrame, model: CumulativeLink, *, reject_at: float | None = None) -> DataFrame:
    """documents with p_toxic, p_severe, expected_severity, grade and rejected.

    One pass over the rows, without shuffle or Python.  grade is the most
    likely one (the lower on ties); a document is rejected when p_toxic, the
    probability of grade 1 or more, reaches reject_at (the model's, if not
    given).  Null and empty texts have no words; texts of any length count
    whole; repeated rows are scored alike; an empty table gives no rows; other
    columns stay; those named like the new ones are replaced.
    """
    eta, reject_at = "__eta", model.reject_at if reject_at is None else reject_at
    p = [1 / (1 + F.exp(F.lit(t) - F.col(eta))) for t in model.thresholds]
    out = documents.withColumn(eta, severity(F.col("text"), model))
    out = out.withColumns({"p_toxic": p[0], "p_severe": p[-1], "expected_severity": sum(p[1:], p[0])})
    none, mild = 1 - F.col("p_toxic"), F.col("p_toxic") - F.col("p_severe")
    grade = F.when((none >= mild) & (none >= F.col("p_severe")), 0).when(mild >= F.col("p_severe"), 1).otherwise(2)
    return out.withColumns({"grade": grade, "rejected": F.col("p_toxic") >= reject_at}).drop(eta)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", "p_toxic", "p_severe", "expected_severity", "grade", "rejected")
