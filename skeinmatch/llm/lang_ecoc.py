"""Language identification by error-correcting output codes (operator 1).

Every language gets a codeword. For each bit a binary n-gram classifier (multinomial log odds over byte bigrams and hashed
trigrams of the lower-cased text) predicts on which side of the split the text lies. Loss-weighted decoding takes the codeword
with the least sum of logistic losses, each bit weighted by how well it separates the languages; close seconds are flagged.
"""

from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, chunked, filtered, hash_place, hash_share, text_column, trimmed

#: Training documents a language, at most (in expectation), taken by a hash of the id.
PER_LANGUAGE = 4000
#: A second language whose share of the decoded weight comes this close makes a prediction ambiguous.
AMBIGUOUS = 0.10
#: A loss of the nearest codeword from here on is that of a text in no learned language: held-out rows of sf0.1 stay below 0.29, noise
#: and other languages mostly lie above; a coin's toss would lose 0.69.
MOST_LOSS = 0.35
CODES = 32
_SIZE = 1 << 16
_SEGMENT = 1 << 18
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _grams(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram and trigram cells at each byte, and where the bigram is not white space alone."""
    a = np.frombuffer(buffer, np.uint8).astype(np.uint32)
    two = a[:-2] | a[1:-1] << 8
    three = (two * np.uint32(0x9E3779B1) + a[2:] * np.uint32(0x85EBCA6B)) >> 16
    return two, three, two != 0x2020


def gram_counts(texts: list[bytes | None]) -> np.ndarray:
    out = np.zeros((2, _SIZE), np.int64)
    for lo, hi in chunked(texts):
        two, three, real = _grams(b"  ".join([b"", *(t.translate(_FOLD) for t in texts[lo:hi] if t), b""]))
        out[0] += np.bincount(two[real], minlength=_SIZE)
        out[1] += np.bincount(three[real], minlength=_SIZE)
    return out


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: the exhaustive code up to 6 languages; else of CODES fixed random codes without equal or constant
    columns that whose nearest two codewords are furthest apart. Bits grow with the logarithm of n, and so does the model."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        return np.array([(1, *c) for c in product((1, -1), repeat=n - 1)][1:], np.int8).T
    best = None
    for seed in range(CODES):
        rng, columns = np.random.default_rng(seed), []
        while len(columns) < int(np.ceil(10 * np.log2(n))):
            c = tuple(rng.permutation(np.resize([1, -1], n)).tolist())
            if c not in columns and tuple(-x for x in c) not in columns:
                columns.append(c)
        code = np.array(columns, np.int8).T
        wide = code.astype(np.int32)
        least = ((code.shape[1] - wide @ wide.T) // 2 + np.eye(n, dtype=np.int32) * code.shape[1]).min()
        if best is None or least > best[0]:
            best = least, code
    return best[1]


class Model:
    """langs, code (languages x bits), weights (2 x cells x bits), bit_weights and the margin scale."""

    def __init__(self, langs: list[str], counts: list[np.ndarray]):
        self.langs, self.code = langs, codewords(len(langs))
        if not langs:
            return
        p = np.stack([(c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * _SIZE) for c in counts])
        bits = self.code.shape[1]
        w = np.zeros((2, _SIZE, bits))
        for b in range(bits if len(langs) > 1 else 0):
            one, two = p[self.code[:, b] > 0].mean(0), p[self.code[:, b] < 0].mean(0)
            w[:, :, b] = np.log(one / two)
        self.weights = w.astype(np.float32)
        expected = np.einsum("lkc,kcb->lb", p, w) / 2 * self.code  # mean margin of each language at each bit, positive if right
        worst = np.maximum(expected.min(0), 1e-3)
        self.bit_weights = worst / worst.sum()
        self.scale = 6 / np.median(worst)

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        """Mean log odds of each bit over the text's n-grams."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for lo, hi in chunked(texts):
            part = [(t or b"").translate(_FOLD) for t in texts[lo:hi]]
            buffer = b"  ".join([b"", *part, b""])
            first = np.cumsum([0, *(len(t) + 2 for t in part)])[:-1]
            sums, n = np.zeros((len(part), self.code.shape[1])), np.zeros(len(part))
            for s in range(0, len(buffer) - 2, _SEGMENT):
                two, three, real = _grams(buffer[s : s + _SEGMENT + 2])
                d0 = np.searchsorted(first, s, "right") - 1
                d1 = np.searchsorted(first, s + len(two), "left")
                cuts = np.maximum(first[d0:d1] - s, 0)
                got = self.weights[0][two] + self.weights[1][three]
                got[~real] = 0
                sums[d0:d1] += np.add.reduceat(got, cuts, axis=0)
                n[d0:d1] += np.add.reduceat(real.astype(np.int64), cuts)
            out[lo:hi] = sums / np.maximum(n, 1)[:, None] / 2
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, share of the decoded weight, whether the second codeword is close, and the nearest codeword's loss."""
        known = [has_letter(t) and bool(self.langs) for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.ones(len(texts))
        m = self.margins(texts) * self.scale
        loss = (np.logaddexp(0, -m[:, None, :] * self.code[None]) * self.bit_weights).sum(2)
        share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        top = np.sort(share, 1)[:, ::-1]
        close = top[:, 0] - (top[:, 1] if share.shape[1] > 1 else 0) < AMBIGUOUS
        score = np.where(known, np.round(top[:, 0], 6), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], score, close | ~np.array(known, bool), loss.min(1)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return text.lower() != text.upper() or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def fit(docs: DataFrame, trains=None) -> Model:
    """Learn from text and non-null lang of the rows for which `trains` holds; at most about PER_LANGUAGE rows of a language,
    chosen by a hash of id and text. No such rows, as in an empty table: a model that names no language. Other columns are not read."""
    rows = docs.where((F.lit(True) if trains is None else trains) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [])
    share = F.create_map(*(x for k in langs for x in (F.lit(k), hash_share(PER_LANGUAGE, sizes[k]))))
    sample = rows.where(hash_place("doc_id", "text") < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, texts = batch.column(0).to_pylist(), text_column(batch, "text")
            for k in set(lang):
                c = gram_counts([t for t, x in zip(texts, lang) if x == k])
                seen[k] = seen[k] + c if k in seen else c
        if seen:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(seen)), "counts": pa.array([zlib.compress(c.tobytes(), 1) for c in seen.values()], pa.binary())})

    def add(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.frombuffer(zlib.decompress(blob), np.int64)
                seen[k] = seen[k] + c if k in seen else c
        if seen:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(seen)), "counts": pa.array([zlib.compress(c.tobytes(), 1) for c in seen.values()], pa.binary())})

    kind = "lang string, counts binary"
    tables = bounded(sample).mapInArrow(trimmed(count), kind).repartition(min(len(langs), 64), "lang").mapInArrow(trimmed(add), kind)
    total = {k: np.zeros((2, _SIZE), np.int64) for k in langs}
    for r in tables.collect():  # a table for each language
        total[r["lang"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64).reshape(2, _SIZE)
    return Model(langs, [total[k] for k in langs])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, lang_pred, score, ambiguous, loss. Null or empty text or no letter: und, 0, ambiguous. Very long texts are read
    whole. Languages that tie go by their names. Rows repeat as they are, no rows give none, ids may be null; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, getattr(model, "weights", None), getattr(model, "bit_weights", None), getattr(model, "scale", None)))

    def rows(batches):
        m = restored(shared.value)
        for batch in batches:
            lang, score, close, loss = m.predict(text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_()), pa.array(np.round(loss, 6), pa.float64())], ["doc_id", "lang_pred", "score", "ambiguous", "loss"])

    return bounded(docs).select("doc_id", "text").mapInArrow(trimmed(rows), "doc_id bigint, lang_pred string, score double, ambiguous boolean, loss double")


def restored(state) -> Model:
    m = Model([], [])
    m.langs, m.weights, m.bit_weights, m.scale = state
    m.code = codewords(len(m.langs))
    return m


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language the decoding is sure of: texts without a letter, those between two codewords and those whose
    nearest codeword loses MOST_LOSS or more go. All columns stay, whatever their names, without a shuffle; nulls and the rest as in predict."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, getattr(model, "weights", None), getattr(model, "bit_weights", None), getattr(model, "scale", None)))

    def make():
        m = restored(shared.value)

        def sure(texts):
            lang, _, close, loss = m.predict(texts)
            return [x != "und" and not c and y < MOST_LOSS for x, c, y in zip(lang, close, loss)]

        return sure

    return filtered(docs, make)
