"""Threshold-scaled fingerprints (operator 3).

A sketch keeps every shingle hash below a fixed fraction of the hash range, so a longer text keeps more. The union of two sketches is
the sketch of the joined sets, and the share of the smaller sketch that the other holds estimates containment, also
between very unequal texts. Shingles are WIDTH bytes of UTF-8, about four words; a shorter text is one shingle.

Fingerprint: 16 hex digits (hash of the whole text), then the kept hashes, sorted, 32 bits each (the hash below the threshold, scaled to
32 bits), in base64.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, chunked, mix, trimmed

WIDTH = 24
#: One hash in 2**FRACTION_LOG2 is kept.
FRACTION_LOG2 = 3
_STEP = 1 << 20


def _hashes(a: np.ndarray) -> np.ndarray:
    """The hash of the WIDTH bytes from each place on."""
    n = len(a) - WIDTH + 1
    view = lambda k: np.ndarray((n,), "<u8", buffer=a, offset=k, strides=(1,))
    h = view(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = (h + view(8)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h = (h + view(16)) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct kept hashes of each text, as unsigned 32-bit integers."""
    kept, owner = [], []
    for lo, hi in chunked(texts, _STEP):
        part = texts[lo:hi]
        data = np.frombuffer(b"".join(part), np.uint8)
        ends = np.cumsum([len(t) for t in part])
        for s in range(0, max(len(data) - WIDTH + 1, 0), _STEP):  # a long text in steps
            h = _hashes(np.ascontiguousarray(data[s : s + _STEP + WIDTH - 1]))
            at = np.flatnonzero(h < np.uint64(1 << (64 - FRACTION_LOG2)))
            who = np.searchsorted(ends, at + s, "right")
            ok = at + s + WIDTH <= ends[who]
            kept.append((h[at[ok]] >> np.uint64(32 - FRACTION_LOG2)).astype(np.uint32))
            owner.append(who[ok] + lo)
        for i, t in enumerate(part):
            if 0 < len(t) < WIDTH:
                h = mix(_hashes(np.frombuffer(t.ljust(WIDTH, b"\0"), np.uint8)) + np.uint64(len(t)))
                if h[0] < np.uint64(1 << (64 - FRACTION_LOG2)):
                    kept.append((h >> np.uint64(32 - FRACTION_LOG2)).astype(np.uint32))
                    owner.append(np.array([lo + i]))
    h, who = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.uint64) for x in (kept, owner))
    both = np.unique(who << np.uint64(32) | h)
    cuts = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
    return [low[b:e] for b, e in zip(cuts, cuts[1:])]


def pack(text: bytes, sketch: np.ndarray) -> str:
    return hashlib.blake2b(text, digest_size=8).hexdigest() + base64.b64encode(sketch.tobytes()).decode()


def unpack(fingerprint: str) -> tuple[str, np.ndarray]:
    return fingerprint[:16], np.frombuffer(base64.b64decode(fingerprint[16:]), "<u4")


def merge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles."""
    return np.union1d(one, two)


def likeness(one: tuple[str, np.ndarray], two: tuple[str, np.ndarray]) -> float:
    """Estimated containment of the smaller in the other, 0 to 1. Equal whole-text hashes: 1. An empty sketch is like nothing else."""
    if one[0] == two[0]:
        return 1.0
    a, b = one[1], two[1]
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float((b[at] == a).mean())


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): rows dealt to parts in ascending doc_id order, sorted within, each part followed by the first row of the next
    (after the last part: the first row of all), which has look = 1. Columns part, look, doc_id, text.

    Parts are ranges between ids that stand in the data, so the row to look ahead to is known by its id; only such rows are sent twice."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, least, missing = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10000), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    bounds, first = np.array(sorted(set(bounds or [])), np.int64), None if missing else least
    last = len(bounds)

    @F.pandas_udf("array<int>")
    def places(doc_id: pd.Series) -> pd.Series:
        null = doc_id.isna().to_numpy()
        ids = doc_id.fillna(0).to_numpy().astype(np.int64)
        at = np.where(null, 0, np.searchsorted(bounds, ids, "right"))
        out = [[2 * int(p)] for p in at]
        ahead = ~null & np.isin(ids, bounds)
        for i in np.flatnonzero(ahead):
            out[i].append(2 * int(at[i]) - 1)  # looked at from the part before
        for i in np.flatnonzero(null if first is None else ~null & (ids == first)):
            out[i].append(2 * last + 1)
        return pd.Series(out)

    placed = docs.select(F.explode(places("doc_id")).alias("place"), "doc_id", "text")
    return placed.select(F.floor(F.col("place") / 2).cast("int").alias("part"), F.pmod("place", F.lit(2)).alias("look"), "doc_id", "text").repartition(n, "part").sortWithinPartitions("part", "look", "doc_id", "text")


def _fingerprinted(batches):
    held = None  # the row that waits for the next one

    def pairs():
        nonlocal held
        for batch in batches:
            for part, look, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if held and held[0] == part:
                    yield held[1], held[2], text
                    held = None
                if not look:
                    held = (part, doc, text or "")

    def out(group):
        texts = [t.encode() for _, t, _ in group]
        nexts = [(x or "").encode() for _, _, x in group]
        edited = []
        for _, t, x in group:
            k = len(t) // 4
            edited.append((t[: len(t) - k] + (x or "")[:k]).encode())
        # The next row's text is the next entry's own text, but for the last of a part.
        own = [(p[:16], s) for p, s in ((pack(t, s), s) for t, s in zip(texts, sketches(texts)))]
        ed = [(p[:16], s) for p, s in ((pack(t, s), s) for t, s in zip(edited, sketches(edited)))]
        known = {t: f for t, f in zip(texts, own)}
        other = [x for x in dict.fromkeys(nexts) if x not in known]
        known |= {x: (hashlib.blake2b(x, digest_size=8).hexdigest(), s) for x, s in zip(other, sketches(other))}
        text_of = lambda f: f[0] + base64.b64encode(f[1].tobytes()).decode()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _, _ in group], pa.int64()),
                pa.array([len(t) for _, t, _ in group], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([text_of(f) for f in own], pa.string()),
                pa.array([text_of(f) for f in ed], pa.string()),
                pa.array([likeness(f, e) for f, e in zip(own, ed)], pa.float64()),
                pa.array([likeness(f, known[x]) for f, x in zip(own, nexts)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    group, size = [], 0
    for row in pairs():
        group.append(row)
        size += len(row[1])
        if size > 4 << 20 or len(group) >= 5000:
            yield out(group)
            group, size = [], 0
    if group:
        yield out(group)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty. The next document is the next in ascending doc_id (null ids first; equal ids by text); after the last comes the
    first, so a single row is its own next. Very long texts are read whole. Repeated rows follow each other, and all rows of one id, or of
    null ids, are in one part, as their order asks for. No rows give none; other columns are not read."""
    return with_next(bounded(docs).select("doc_id", "text")).mapInArrow(trimmed(_fingerprinted), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
