"""Benchmark decontamination by q-gram lemma filtering (operator 9).

An item is cut into overlapping windows; an item of up to WINDOW bytes is one window. A window of m bytes that occurs in a text with
at most k edits shares at least T = m - q + 1 - kq of its q-grams with it, and all within k diagonals of one another. So the shared
q-grams are counted by overlapping bands of diagonals; a band that reaches T is a region, and a banded alignment of the window
against it decides. A document holds an item if it holds a window of it, so a quoted part of an item counts from one
and a half windows on, wherever it begins.

Texts are compared in lower case with runs of ASCII punctuation and white space as one space, whole, in overlapping stretches that
every occurrence fits into; so the memory depends neither on a text's length nor on how often its q-grams repeat.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, filtered, mix, text_column, trimmed, written

Q = 12
#: Edits allowed in a window, as a share of its length.
EDIT_SHARE = 0.05
#: Bytes of a window; the next one begins half a window later, the last one ends with the item.
WINDOW = 256
#: Bytes of windows in one index; a larger benchmark is matched in several blocks.
BLOCK_BYTES = 4 << 20
#: Bytes of text that are searched at once, over those that the next stretch sees again.
STRETCH, _OVERLAP = 1 << 15, 2 * WINDOW
#: Shared q-grams that are counted at once, and windows whose diagonals are counted together.
_HITS, _TOGETHER = 1 << 20, 64
_BITS = 22
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normal(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(_FOLD).split())


def budget(m: int) -> int:
    """Edits allowed in a window of m bytes: the share, or fewer where the lemma needs it to ask for a shared q-gram."""
    return max(0, min(int(m * EDIT_SHARE), (m - Q) // Q))


def windows(item: bytes) -> list[bytes]:
    """The windows of a normalised item."""
    if len(item) <= WINDOW:
        return [item]
    return [item[at : at + WINDOW] for at in [*range(0, len(item) - WINDOW, WINDOW // 2), len(item) - WINDOW]]


def _gram_hashes(a: np.ndarray) -> np.ndarray:
    n = len(a) - Q + 1
    low = np.ndarray((n,), "<u8", buffer=a, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    high = np.ndarray((n,), "<u4", buffer=a, offset=8, strides=(1,)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(low + high)


class Index:
    """The q-grams of a block of items' windows: sorted hashes with window and run of places, and a bit table that most other q-grams miss."""

    def __init__(self, items: list[tuple[int, bytes]]):
        owners: dict[bytes, list] = {}
        for i, s in items:
            for w in set(windows(s)) if s else ():
                owners.setdefault(w, []).append(i)
        self.windows = sorted(owners)
        self.owners = [owners[w] for w in self.windows]
        self.short = [k for k, w in enumerate(self.windows) if len(w) < Q]
        h, who, at = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for k, w in enumerate(self.windows):
            if len(w) >= Q:
                g = _gram_hashes(np.frombuffer(w, np.uint8))
                h.append(g)
                who.append(np.full(len(g), k, np.int32))
                at.append(np.arange(len(g), dtype=np.int32))
        h, who, at = np.concatenate(h), np.concatenate(who), np.concatenate(at)
        order = np.argsort(h, kind="stable")  # windows and places stay in order
        h, who, at = h[order], who[order], at[order]
        # A window's q-gram at consecutive places, as in a run of one character, is one entry.
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
        self.hashes, self.who, self.at = h[new], who[new], at[new]
        self.run = np.diff(np.append(np.flatnonzero(new), len(h))).astype(np.int32)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        m = np.array([len(w) for w in self.windows], np.int64)
        self.k = np.array([budget(x) for x in m], np.int64)
        self.least = m - Q + 1 - self.k * Q

    def matches(self, text: bytes | None) -> dict[int, int]:
        """The least edits of each item of which a window occurs within its budget."""
        s = normal(text)
        found: dict[int, int] = {}
        padded = b" " + s + b" "
        for k in self.short:
            if b" " + self.windows[k] + b" " in padded:
                found[k] = 0
        if len(self.hashes):
            for at in range(0, max(len(s) - _OVERLAP, 1), STRETCH):
                self._search(s[at : at + STRETCH + _OVERLAP], found)
        out: dict[int, int] = {}
        for k, edits in found.items():
            for i in self.owners[k]:
                out[i] = min(edits, out.get(i, edits))
        return out

    def _search(self, s: bytes, found: dict[int, int]) -> None:
        if len(s) < Q:
            return
        h = _gram_hashes(np.frombuffer(s, np.uint8))
        places = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(places):
            return
        low, high = (np.searchsorted(self.hashes, h[places], side) for side in ("left", "right"))
        real = high > low
        places, low, n = places[real], low[real], (high - low)[real]
        if not len(places):
            return
        # No band of a window holds more q-grams than the whole stretch.
        total = np.zeros(len(self.windows), np.int64)
        for entry, _ in self._entries(places, low, n):
            total += np.bincount(self.who[entry], self.run[entry], len(total)).astype(np.int64)
        left = [k for k in np.flatnonzero((total >= self.least) & (total > 0)).tolist() if found.get(k) != 0]
        for k in [k for k in left if self.windows[k] in s]:
            found[k] = 0
        left = [k for k in left if found.get(k) != 0]
        for b in range(0, len(left), _TOGETHER):
            part = np.array(left[b : b + _TOGETHER])
            for k, shared in zip(part.tolist(), self._diagonals(part, places, low, n, len(s))):
                edits = banded_edits(self.windows[k], s, self._regions(k, shared), 2 * (int(self.k[k]) + 1), int(self.k[k]))
                if edits is not None and edits < found.get(k, edits + 1):
                    found[k] = edits

    @staticmethod
    def _entries(places, low, n):
        """(entries of the index, places in the text) of shared q-grams, a bounded number at once."""
        ends = np.cumsum(n)
        b = 0
        while b < len(n):
            e = max(b + 1, int(np.searchsorted(ends, (ends[b - 1] if b else 0) + _HITS, "right")))
            m = n[b:e]
            yield np.repeat(low[b:e] - (np.cumsum(m) - m), m) + np.arange(m.sum()), np.repeat(places[b:e], m)
            b = e

    def _diagonals(self, part, places, low, n, size: int) -> np.ndarray:
        """For each window of part, the shared q-grams on each diagonal from -WINDOW on. A run of q-grams is a range of diagonals."""
        width = size + WINDOW + 1
        change = np.zeros(len(part) * width, np.int32)
        for entry, place in self._entries(places, low, n):
            at = np.minimum(np.searchsorted(part, self.who[entry]), len(part) - 1)
            mine = part[at] == self.who[entry]
            entry, place, at = entry[mine], place[mine], at[mine]
            last = place - self.at[entry] + WINDOW
            change += np.bincount(at * width + last - self.run[entry] + 1, minlength=len(change)).astype(np.int32)
            change -= np.bincount(at * width + last + 1, minlength=len(change)).astype(np.int32)
        return np.cumsum(change.reshape(len(part), width), 1, dtype=np.int32)

    def _regions(self, k: int, shared: np.ndarray) -> np.ndarray:
        """The first diagonals of the bands, each of 2 (k + 1) diagonals from a multiple of k + 1 on, that hold enough shared q-grams of window k.

        k + 1 diagonals in a row always lie in one band."""
        step = int(self.k[k]) + 1
        firsts = np.arange(-WINDOW // step - 1, (len(shared) - WINDOW) // step + 1) * step
        before = np.concatenate([[0], np.cumsum(shared)])
        held = before[np.clip(firsts + 2 * step + WINDOW, 0, len(shared))] - before[np.clip(firsts + WINDOW, 0, len(shared))]
        return firsts[held >= max(self.least[k], 1)]


def banded_edits(item: bytes, text: bytes, firsts, width: int, most: int) -> int | None:
    """The least edits that turn item into a stretch of text whose alignment keeps within diagonals first to first + width - 1, for
    one of the firsts; None if over most. The stretch may begin and end anywhere, so row 0 costs nothing in the band."""
    firsts = np.asarray(firsts, np.int64)
    if not len(firsts):
        return None
    p, m = np.frombuffer(item, np.uint8), len(item)
    far = np.int32(most + 1)  # more than most is all the same
    # Letters at places first to first + m + width - 1 of each band; 256 where there is no text.
    wide = np.full(len(text) + 2 * (m + width), 256, np.int16)
    wide[m + width : m + width + len(text)] = np.frombuffer(text, np.uint8)
    letters = wide[np.clip(firsts[:, None] + np.arange(m + width) + m + width, 0, len(wide) - 1)]
    steps = np.arange(width, dtype=np.int32)
    # Cell d of row i: item[:i] against text that ends before place first + d + i.
    ends = firsts[:, None] + steps
    row = np.where((ends >= 0) & (ends <= len(text)), 0, far).astype(np.int32)
    for i in range(m):
        drop = np.full_like(row, far)
        drop[:, :-1] = row[:, 1:] + 1
        row = np.minimum(row + (letters[:, i : i + width] != p[i]), drop)
        row = np.minimum(np.minimum(row, np.minimum.accumulate(row - steps, axis=1) + steps), far)
        alive = (row < far).any(1)
        if not alive.all():
            row, letters = row[alive], letters[alive]
            if not len(row):
                return None
    return int(row.min())


def blocks(benchmark: DataFrame, size: int | None = None):
    """The items (item_id, text), as lists of bounded size; null and empty texts match nothing and are left out."""
    size = BLOCK_BYTES if size is None else size
    held, n = [], 0
    for r in benchmark.where("text is not null").select("item_id", F.col("text").cast("binary").alias("t")).distinct().toLocalIterator():
        s = normal(bytes(r["t"]))
        if s:
            more = sum(map(len, windows(s)))
            if held and n + more > size:
                yield held
                held, n = [], 0
            held.append((r["item_id"], s))
            n += more
    if held:
        yield held


_FOUND = "items array<bigint>, least_edits bigint"


def _key():
    """Tells rows with one id apart by their text."""
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def _searched(docs: DataFrame, block: list, kept: list[str], hits_only: bool) -> DataFrame:
    """The columns kept of docs with the items of a block found in each row, ascending, and the least edits."""
    shared = docs.sparkSession.sparkContext.broadcast(sorted(block, key=str))

    def rows(batches):
        index = Index(shared.value)
        for batch in batches:
            found = [index.matches(t) for t in text_column(batch, "text")]
            items = pa.array([sorted(f, key=lambda k: (k is not None, k or 0)) for f in found], pa.list_(pa.int64()))
            least = pa.array([min(f.values(), default=None) for f in found], pa.int64())
            out = pa.RecordBatch.from_arrays([*batch.select(kept).columns, items, least], [*kept, "items", "least_edits"])
            yield out.filter(pa.array(list(map(bool, found)), pa.bool_())) if hits_only else out

    fields = "".join(f"{docs.schema[c].name} {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return bounded(docs).mapInArrow(trimmed(rows), fields + _FOUND)


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame | list:
    """The one block of a benchmark, as a list; or of a larger one the rows (doc_id, key, items, least_edits) that hold an item, as a
    written table, a scan of the texts for each block: only ids and digests are kept between blocks."""
    left = blocks(benchmark)
    block, after = next(left, []), next(left, None)
    if after is None:
        return block
    keyed = docs.select("doc_id", "text", _key().alias("key"))
    parts = [written(_searched(keyed, x, ["doc_id", "key"], True), "found") for x in chain([block, after], left)]
    return reduce(DataFrame.union, parts)


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, contaminated, n_items, items (ascending ids of the items found), least_edits (null if none).

    Null and empty texts are clean; very long ones are searched whole. Repeated rows repeat. Items shorter than a q-gram must stand as
    whole words. An empty benchmark leaves all clean, and no documents give no rows. Equal items each count; ties do not arise. Other
    columns, of either table, are not read."""
    hits = _hits(docs, benchmark)
    if isinstance(hits, list):
        out = _searched(docs.select("doc_id", "text"), hits, ["doc_id"], False)
    else:
        hits = hits.groupBy("doc_id", "key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("least_edits").alias("least_edits"))
        hits = hits.withColumnsRenamed({"doc_id": "i", "key": "k"})
        rows = docs.select("doc_id", _key().alias("key"))
        out = rows.join(hits, rows.doc_id.eqNullSafe(hits.i) & (rows.key == hits.k), "left").select("doc_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), "least_edits")
    return out.select("doc_id", F.col("least_edits").isNotNull().alias("contaminated"), F.size("items").cast("bigint").alias("n_items"), "items", "least_edits")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark item occurs, all columns, whatever their names; nulls and the rest as in contaminations."""
    hits = _hits(docs, benchmark)
    if isinstance(hits, list):
        return filtered(docs, _clean_of(docs.sparkSession.sparkContext.broadcast(sorted(hits, key=str))))
    gone = written(hits.select("doc_id", "key").distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == gone["key"]), "left_anti")


def _clean_of(shared):
    def make():
        index = Index(shared.value)
        return lambda texts: [not index.matches(t) for t in texts]

    return make
