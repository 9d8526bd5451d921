"""Toxicity by weak supervision (operator 10).

Lexicon voters are lists of terms, one list for each kind of evidence (a word; one, two or three different words on one stem) and
each of six strata of precision; terms are chosen from labelled rows. Pattern voters look at how many such terms there are and how dense they
are, and the annotator's label is a voter like the others. A voter says toxic when it fires, clean when it had words enough to
fire on and did not, and else abstains; one pattern voter fires for clean texts. A generative label model (expectation maximisation over a latent class, begun from the
voters' majority, not from the annotator) estimates each voter's accuracy in either class and the voters' correlations within the classes, which set
how much each may say. Its posteriors are the labels on which a linear classifier over the text's voters is trained; that classifier scores every document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, filtered, hash_place, hash_share, text_column, trimmed

#: Labelled rows of each class from which words are chosen and the models fitted, at most (in expectation).
PER_CLASS = 8000
#: Words and stems in the lexicon, at most; the least count and lift of each.
WORDS, LEAST_COUNT, LEAST_LIFT = 2048, 5, 20.0
#: Kinds of evidence times strata of precision.
LEXICON_VOTERS, KINDS = 24, 4
PATTERN_VOTERS = 7
#: Words from which on a voter that does not fire says clean.
ENOUGH = 12
#: Bytes of a stem; a stem is a term for one, two and three different words that begin with it.
STEMS = (4, 5)
THRESHOLD = 0.3
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes | None) -> tuple[set[bytes], int]:
    """Distinct words (runs of letters and non-ASCII bytes, lower case) with their stems, and how many words there are."""
    words = (text or b"").translate(_FOLD).split()
    out = set(words)
    stems: list[bytes] = []
    for k in STEMS:
        left = sorted(w[:k] for w in out if len(w) > k)
        stems += {x + b"*" for x in left}
        stems += {x + b"**" for x, y in zip(left, left[1:]) if x == y}
        stems += {x + b"***" for x, y in zip(left, left[2:]) if x == y}
    out.update(stems)
    return out, len(words)


class Model:
    def __init__(self, lexicon: dict[bytes, int], weights: np.ndarray, accuracies=None):
        self.lexicon, self.weights, self.accuracies = lexicon, weights, accuracies
        self.keys = frozenset(lexicon)

    def votes(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """One row a text: which lexicon voters, then which pattern voters fire; and whether the text has words enough for a say of clean.

        The last pattern voter fires where no term of the lexicon is found in a text of enough words: it speaks for clean."""
        out, enough = np.zeros((len(texts), LEXICON_VOTERS + PATTERN_VOTERS)), np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            found, n = terms(t)
            hits = found & self.keys
            k = stems = 0
            for w in hits:
                voter = self.lexicon[w]
                out[i, voter] = 1
                if voter < LEXICON_VOTERS // 2:  # the stronger strata
                    stems += w.endswith(b"*")
                    k += not w.endswith(b"*")
            enough[i] = n >= ENOUGH
            out[i, LEXICON_VOTERS:] = (k >= 1, k >= 2, k >= 3, stems >= 2, stems >= 4, 100 * k >= n > 0, not hits and enough[i])
        return out, enough

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        x = self.votes(texts)[0] @ self.weights[1:] + self.weights[0]
        return np.round(1 / (1 + np.exp(-x)), 6)


def label_model(v: np.ndarray, rounds: int = 60):
    """Posterior of the toxic class for each row of votes (1 toxic, -1 clean, 0 abstains); each voter's rate of saying toxic in either
    class among its votes; the voters' correlations within the classes; the share of the toxic class.

    Voters that repeat one another share their say: it is found by generalised least squares, R**-1 1, from the correlations R
    within the classes, pooled, anew in each round. The first guess of the posterior is the share of the says that are toxic, each voter
    counted by how rarely it says so and by its say under the correlations in all rows."""
    says, toxic = v != 0, v > 0
    rate = (toxic.sum(0) + 1) / (says.sum(0) + 2)
    say = _say(_correlations(toxic, says, np.ones(len(v)), rate, rate)) * -np.log(rate)
    first = (toxic * say).sum(1) / np.maximum((says * say).sum(1), 1e-9)
    q = np.where(toxic.any(1), np.clip(2 * first, 0.05, 0.95), 0.05)
    for _ in range(rounds):
        prior = float(np.clip(q.mean(), 1e-4, 1 - 1e-4))
        one = (q @ toxic + 0.5) / (q @ says + 1)
        zero = ((1 - q) @ toxic + 0.5) / ((1 - q) @ says + 1)
        correlations = _correlations(toxic, says, q, one, zero)
        for_toxic, for_clean = np.log(one / zero), np.log((1 - one) / (1 - zero))
        odds = np.log(prior / (1 - prior)) + np.where(toxic, for_toxic, np.where(says, for_clean, 0)) @ _say(correlations)
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, one, zero, correlations, prior


def _say(correlations: np.ndarray) -> np.ndarray:
    n = len(correlations)
    return np.clip(np.linalg.solve(correlations + 0.05 * np.eye(n), np.full(n, 1.05)), 0.02, 1)


def _correlations(toxic, says, q, one, zero):
    """Correlations of the voters' says within the classes, pooled; negative ones, which come from terms that replace one another, count as none."""
    total, size = np.zeros((toxic.shape[1],) * 2), np.zeros((toxic.shape[1],) * 2)
    for weight, mean in ((q, one), (1 - q, zero)):
        r = np.where(says, toxic - mean, 0) * np.sqrt(weight)[:, None]
        c, n = r.T @ r, (says * weight[:, None]).T @ says
        sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
        # A class counts by how much its members vary there.
        total += c
        size += n * sd * sd[:, None]
    c = np.clip(total / np.maximum(size, 1e-9), 0, 1)
    np.fill_diagonal(c, 1)
    return c


def linear_fit(x: np.ndarray, q: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - q) + ridge * np.r_[0, w[1:]]
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def fit(docs: DataFrame, labels: DataFrame, trains=None) -> Model:
    """Learn from text and labels.toxic of the rows for which `trains` (over doc_id) holds. Without both classes, as in empty tables: a model that scores 0.

    Reads at most about PER_CLASS rows a class, chosen by a hash of the id, each text once; of several labels of an id the largest. Terms that
    tie in count go by their bytes. Null ids and labels are not read, nor are other columns of either table."""
    rows = labels.select("doc_id", "toxic").where((F.lit(True) if trains is None else trains) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model({}, np.r_[-20.0, np.zeros(LEXICON_VOTERS + PATTERN_VOTERS)])
    share = F.when(F.col("toxic") == 1, hash_share(PER_CLASS, sizes[1])).otherwise(hash_share(PER_CLASS, sizes[0]))
    ids = rows.where(hash_place("doc_id") < share)  # about 2 PER_CLASS at most, so it may be broadcast
    sample = bounded(docs).select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", "text")

    def count(batches):
        seen, n = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for k, t in dict(zip(text_column(batch, "text"), batch.column(0).to_pylist())).items():
                k, v = v_of(t, k)
                seen[k].update(v)
                n[k] += 1
        for k in (0, 1):
            if n[k]:
                yield pa.RecordBatch.from_arrays([pa.array([b"", *seen[k]], pa.binary()), pa.array([n[k] * k, *(c * k for c in seen[k].values())], pa.int64()), pa.array([n[k] * (1 - k), *(c * (1 - k) for c in seen[k].values())], pa.int64())], ["term", "one", "zero"])

    def v_of(label, text):
        return int(label == 1), terms(text)[0]

    counts = sample.mapInArrow(trimmed(count), "term binary, one bigint, zero bigint").groupBy("term").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    n1, n0 = max(sizes[1], 1), max(sizes[0], 1)
    total1, total0 = min(n1, PER_CLASS), min(n0, PER_CLASS)
    lift = ((F.col("one") + 0.5) / (total1 + 1)) / ((F.col("zero") + 0.5) / (total0 + 1))
    chosen = counts.where((F.col("term") != F.lit(b"")) & (F.col("one") >= LEAST_COUNT) & (lift >= LEAST_LIFT)).orderBy(F.desc("one"), "term").limit(WORDS).collect()
    # Terms of like precision share a stratum; a stratum has a voter for each kind of evidence.
    strata = LEXICON_VOTERS // KINDS
    by_strength = sorted(chosen, key=lambda r: (-r["one"] / (r["one"] + (r["zero"] + 0.5) * total1 / total0), -r["one"], bytes(r["term"])))
    lexicon = {bytes(r["term"]): KINDS * (i * strata // len(by_strength)) + min(bytes(r["term"]).count(b"*"), KINDS - 1) for i, r in enumerate(by_strength)}
    model = Model(lexicon, np.zeros(LEXICON_VOTERS + PATTERN_VOTERS + 1))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def vote(batches):
        m = Model(shared.value, np.zeros(1))
        for batch in batches:
            v, enough = m.votes(text_column(batch, "text"))
            bits = (np.column_stack([v, enough]).astype(np.int64) << np.arange(v.shape[1] + 1)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(bits, pa.int64())], ["toxic", "votes"])

    # Voters are few, so rows of votes fold to their counts; no more rows come here than the sample has.
    cast = sample.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(trimmed(vote), "toxic int, votes bigint").groupBy("votes", "toxic").agg(F.count("*").alias("n")).collect()
    bits = np.repeat([r["votes"] for r in cast], [r["n"] for r in cast]).astype(np.int64)
    toxic = np.repeat([r["toxic"] for r in cast], [r["n"] for r in cast])
    both = bits[:, None] >> np.arange(LEXICON_VOTERS + PATTERN_VOTERS + 1) & 1
    v, enough = both[:, :-1].astype(float), both[:, -1:] == 1
    if not len(v):  # labels without a document
        return Model({}, np.r_[-20.0, np.zeros(LEXICON_VOTERS + PATTERN_VOTERS)])
    # The voter for clean texts says clean where it fires; the annotator is one more voter, whom the classifier does not see.
    said = np.where(v == 1, 1, np.where(enough, -1, 0))
    said[:, -1] = np.where(v[:, -1] == 1, -1, np.where(enough[:, 0], 1, 0))
    q, *model.accuracies = label_model(np.column_stack([said, np.where(toxic == 1, 1, -1)]))
    model.weights = linear_fit(v, q)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, score in 0 to 1, predicted. Null and empty texts get the score of a text without words; very long ones are read whole.
    Repeated rows repeat, no rows give none, ids may be null; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))

    def rows(batches):
        m = Model(*shared.value)
        for batch in batches:
            s = m.score(text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return bounded(docs).select("doc_id", "text").mapInArrow(trimmed(rows), "doc_id bigint, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs scored below THRESHOLD, all columns whatever their names, without a shuffle; nulls and the rest as in score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))

    def make():
        m = Model(*shared.value)
        return lambda texts: (m.score(texts) < THRESHOLD).tolist()

    return filtered(docs, make)
