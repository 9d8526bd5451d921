"""N-gram Jaccard join (operator 8): an exact grouped prefix join over five-word shingles.

Steps:
1. One pass counts all shingles in a table of fixed size. Cells far above the mean mark frequent shingles; the global
   order puts unmarked shingles first, by hash, and marked ones last, by class and hash. The order only steers work.
2. A second pass takes each document's set digest, size and prefix: the first n - ceil(3n/4) + 1 shingles in that order.
   Sets at similarity 3/4 share a prefix shingle. Documents with equal prefix and size form a group, which is indexed once.
3. Groups meet by prefix shingle, in packed blocks; a frequent shingle's entries go in pieces of bounded size. A list of up to
   ALL_PAIRS groups gives its pairs, by length and position filter; a longer one gives each member's pairs with a few centres,
   and is kept for step 5.
4. Pairs of members pass a bitmap filter: parities of hash cells bound the symmetric difference of two sets from below.
   What passes is verified on the whole sets; links give components.
5. Kept lists (and groups with several members) that hold more than one component are settled in rounds. The members of the
   list's largest component wait in chunks of bounded size; each other member meets every chunk and names its nearest
   members of other components by parities, a few at first. Each round verifies and joins components; members that could have named more do so in
   the next one, and in the last all that the bounds let through. A pair inside a component could only confirm it,
   so the components are exact, and the pairs sent grow with the members outside the largest component.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, mix, text_column, trimmed, written
from .components import components
from .shingles import shingle_sets

#: Cells of the table of shingle counts (4 bytes each on a worker, 1 byte each broadcast).
CELLS_LOG2 = 22
#: Longest list of groups that gives all its pairs at once.
ALL_PAIRS = 6
#: Centres of a longer list.
CENTRES = 2
#: Most rows of a slim table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Least and most cells of the short parity table by which members of a kept list are compared; a set's own has its size or up to twice that.
SHORT_CELLS = 64, 4096
#: Entries of one shingle that meet in one piece.
PIECE = 1 << 20
#: Entries that one task brings together, about.
BUCKET = 400_000
#: Members of a kept list in one chunk.
CHUNK = 1 << 14
#: How many nearest members a member names for each chunk, round by round; None: all that the bounds let through.
ROUNDS = (2, 32, None)
#: Rows that a task takes at least, of pairs to filter, of pairs to verify, of lists' entries: small steps go in few tasks.
FILTERED, VERIFIED, LISTED = 2000, 500, 5000
_SLICES = 64


def _counted(batches):
    cells = np.zeros(1 << CELLS_LOG2, np.uint32)
    held, size = [], 0
    total = 0

    def flush():
        if held:
            cells[:] += np.bincount(np.concatenate(held), minlength=len(cells)).astype(np.uint32)
            held.clear()

    for batch in batches:
        for s in shingle_sets(text_column(batch, "text")):
            held.append((s >> np.uint64(64 - CELLS_LOG2)).astype(np.int32))
            size += len(s)
            total += len(s)
            if size > 1_000_000:
                flush()
                size = 0
    flush()
    if total:
        parts = np.split(cells, _SLICES)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES), pa.int32()), "cells": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})


def _added(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
            sums[k] = sums[k] + part if k in sums else part
    if sums:
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "cells": pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())})


def frequency_classes(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A class for each cell: 0 where its count may be chance, else 1 and more, by powers of two above that; and for each
    class how many pieces of PIECE entries its largest count makes."""
    rows = docs.select("text").mapInArrow(trimmed(_counted), "slice int, cells binary").repartition(_SLICES, "slice").mapInArrow(trimmed(_added), "slice int, cells binary").collect()
    counts = np.zeros((_SLICES, (1 << CELLS_LOG2) // _SLICES))
    for r in rows:
        counts[r["slice"]] = np.frombuffer(zlib.decompress(r["cells"]), np.uint64)
    counts = counts.ravel()
    mean = np.median(counts)  # hot shingles do not move it
    limit = mean + 6 * np.sqrt(mean) + 16
    classes = np.where(counts > limit, 1 + np.floor(np.log2(np.maximum(counts, 1) / limit)), 0).astype(np.uint8)
    most = limit * 2.0 ** np.arange(int(classes.max()) + 1)
    return classes, np.ceil(most / PIECE).astype(np.int64)


def _prefixed(shared, kept):
    def rows(batches):
        classes = shared.value[0]
        for batch in batches:
            ids, n, cid, gid, prefixes, bits, words = batch.column(batch.schema.names.index("doc_id")), [], [], [], [], [], []
            for s in shingle_sets(text_column(batch, "text")):
                n.append(len(s))
                cid.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                c = classes[(s >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)]
                if c.any():
                    s = s[np.argsort(c, kind="stable")]  # s is sorted by hash
                p = s[: len(s) // 4 + 1].tobytes()  # n - ceil(3n/4) = floor(n/4)
                gid.append(hashlib.blake2b(p, digest_size=16, salt=str(len(s)).encode()[:16]).digest())
                prefixes.append(p)
                bits.append(_parities(s, max(64, 2 * len(s))))
                words.append(_parities(s >> np.uint64(32), min(max(SHORT_CELLS[0], len(s)), SHORT_CELLS[1])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (cid, gid, prefixes, bits)), pa.array(words, pa.binary()), *batch.select(list(kept)).columns], ["doc_id", "n", "cid", "gid", "prefix", "bits", "words", *kept])

    return rows


def _parities(s: np.ndarray, least: int) -> bytes:
    """Whether each of m cells, the power of two from `least` on, holds an odd number of the hashes."""
    m = 1 << (least - 1).bit_length()
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).tobytes()


def _folded(a: np.ndarray, size: int) -> np.ndarray:
    """Tables of bytes, brought to a smaller size: cells that agree modulo it go together."""
    return np.bitwise_xor.reduce(a.reshape(*a.shape[:-1], -1, size), axis=-2)


def _near_enough(batches):
    """Pairs whose parities differ in no more cells than sets at similarity 3/4 may differ in shingles, (n1 + n2) / 7."""
    for batch in batches:
        keep = []
        for n1, n2, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            size = min(len(x), len(y))
            keep.append(7 * int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= n1 + n2)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


_ENTRY = np.dtype([("token", "<u8"), ("group", "<u2"), ("place", "<u2")])
_GROUP = np.dtype([("id", "V16"), ("n", "<u4")])


def _pieces(shared, token: np.ndarray) -> np.ndarray:
    classes, pieces = shared.value
    return pieces[classes[(token >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)]]


def _packed(buckets: int, shared):
    """Rows (bucket, groups, entries): prefix entries of many groups, by ranges of the shingle hash; a shingle of several pieces
    goes to as many buckets, by its groups' ids. Equal groups of a task go once."""

    def flush(held):
        held = [(g, n, p) for g, (n, p) in held.items()]
        groups = np.array([(g, n) for g, n, _ in held], _GROUP)
        sizes = [len(p) for _, _, p in held]
        e = np.empty(sum(sizes), _ENTRY)
        e["token"] = np.concatenate([p for _, _, p in held])
        e["group"] = np.repeat(np.arange(len(held)), sizes)
        starts = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        e["place"] = np.minimum(np.arange(len(e)) - starts, 65535)
        at = (e["token"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        pieces = _pieces(shared, e["token"])
        if (pieces > 1).any():
            which = mix(np.frombuffer(groups["id"].tobytes(), np.uint64)[::2])[e["group"]] % pieces.astype(np.uint64)
            at = (at + which) % np.uint64(buckets)
        order = np.argsort(at, kind="stable")
        e, at = e[order], at[order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        out = []
        for part, b in zip(np.split(e, cuts), at[np.concatenate([[0], cuts])]):
            used, part_group = np.unique(part["group"], return_inverse=True)
            part = part.copy()
            part["group"] = part_group
            out.append((int(b), groups[used].tobytes(), part.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "groups", "entries"])

    def rows(batches):
        held, size = {}, 0
        for batch in batches:
            for g, n, p in zip(*(batch.column(k).to_pylist() for k in ("gid", "n", "prefix"))):
                if not n or g in held:
                    continue
                held[g] = (n, np.frombuffer(p, np.uint64))
                size += len(p) // 8
                if len(held) == 65535 or size > BUCKET:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return rows


def _binary16(a: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary())


def _may_link(n1, p1, n2, p2):
    """Length filter, and the position filter for a first common shingle at places p1 and p2."""
    n1, p1, n2, p2 = (x.astype(np.int64) for x in (n1, p1, n2, p2))
    most = np.minimum(n1 - p1, n2 - p2)
    return (4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)) & (7 * most >= 3 * (n1 + n2))


def _met(shared):
    """From all rows of a bucket: rows (0, -, a, b, -) for pairs of groups, (1, token, group, -, place) for the entries of kept
    lists, (2, token, centre, -, -) for the centres of the pieces of one shingle."""

    def rows(batches):
        return _met_rows(shared, batches)

    return rows


def _met_rows(shared, batches):
    parts: dict[int, list] = {}
    for batch in batches:
        for b, g, e in zip(*(batch.column(k).to_pylist() for k in range(3))):
            parts.setdefault(b, []).append((np.frombuffer(g, _GROUP), np.frombuffer(e, _ENTRY)))
    for held in parts.values():
        base = np.cumsum([0, *(len(g) for g, _ in held)])
        groups = np.concatenate([g for g, _ in held])
        token = np.concatenate([e["token"] for _, e in held])
        group = np.concatenate([e["group"].astype(np.int64) + k for k, (_, e) in zip(base, held)])
        place = np.concatenate([e["place"] for _, e in held])
        # A group that several tasks sent: its first copy stays.
        _, one, same = np.unique(np.frombuffer(groups["id"].tobytes(), np.uint64).reshape(-1, 2), axis=0, return_index=True, return_inverse=True)
        only = one[same.ravel()][group] == group
        token, group, place = token[only], group[only], place[only]
        order = np.argsort(token, kind="stable")
        token, group, place = token[order], group[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(first, len(token)))
        whole = _pieces(shared, token[first]) == 1
        pairs = [np.empty((0, 2), np.int64)]
        for m in range(2, ALL_PAIRS + 1):
            at = first[(length == m) & whole]
            for i in range(m if len(at) else 0):
                for j in range(i + 1, m):
                    x, y = group[at + i], group[at + j]
                    ok = _may_link(groups["n"][x], place[at + i], groups["n"][y], place[at + j])
                    pairs.append(np.stack([x[ok], y[ok]], 1))
        kept, heads = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
        ranks = [mix(np.frombuffer(groups["id"].tobytes(), np.uint64)[::2] + np.uint64(k * 0x9E37 + 1)) for k in range(CENTRES)]
        long = (length > ALL_PAIRS) | ~whole
        for at, m, alone in zip(first[long], length[long], whole[long]):
            g = group[at : at + m]
            centre = g[np.argmin(ranks[int(token[at] % np.uint64(CENTRES))][g])]
            n1, n2 = groups["n"][g].astype(np.int64), int(groups["n"][centre])
            ok = (g != centre) & (4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2))
            pairs.append(np.stack([g[ok], np.full(ok.sum(), centre)], 1))
            kept.append(np.arange(at, at + m))
            if not alone:
                heads.append(np.array([[at, centre]]))
        p = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
        for lo in range(0, len(p), 100_000):
            a, b = p[lo : lo + 100_000].T
            yield _found(0, np.zeros(len(a), np.int64), groups["id"][a], groups["id"][b], np.zeros(len(a), np.int64))
        k, h = np.concatenate(kept), np.concatenate(heads)
        for kind, at, which, where in ((1, k, group[k], place[k]), (2, h[:, 0], h[:, 1], np.zeros(len(h)))):
            for lo in range(0, len(at), 100_000):
                x = slice(lo, lo + 100_000)
                yield _found(kind, token[at[x]].view(np.int64), groups["id"][which[x]], groups["id"][which[x]], where[x].astype(np.int64))


def _found(kind, token, a, b, place):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(token), _binary16(a), _binary16(b), pa.array(place)], ["kind", "token", "a", "b", "place"])


def _sets(batches):
    for batch in batches:
        sets = list(shingle_sets(text_column(batch, "text")))
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "shingles"])


def _verified(batches):
    for batch in batches:
        keep, held = [], (None, None)
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if held[0] != x:
                held = (x, np.frombuffer(x, np.uint64))
            a, b = held[1], np.frombuffer(y, np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
            keep.append(both > 0 and 100 * both >= 75 * (len(a) + len(b) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most BROADCAST_IDS rows (of some 50 bytes); else it is shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _tasked(df: DataFrame, rows: int, least: int) -> DataFrame:
    """df in no more tasks than one for each `least` rows."""
    tasks = max(1, -(-rows // least))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of set digests, those at similarity 3/4 or more, by their whole sets.

    The texts are found by the smallest id of their class, null ids as one id; sets that are not asked for go by their digest."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "asked")
    few = ids.count() <= BROADCAST_IDS
    asked = written(classes.join(F.broadcast(ids) if few else ids, "cid", "left_semi").select("cid", "n", "bits", "rep"), "asked")
    first = pairs.join(asked.select(F.col("cid").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("x")), "a")
    full = first.join(asked.select(F.col("cid").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("y")), "b")
    near = written(_tasked(full.select("a", "b", "n1", "n2", "x", "y"), pairs.count(), FILTERED).mapInArrow(trimmed(_near_enough), "a binary, b binary"), "near")
    if near.isEmpty():
        discard(ids, asked)
        return near
    ends = written(asked.join(near.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi").select("cid", "rep"), "ends")
    reps = ends.select(F.col("rep").alias("id")).distinct()
    texts = docs.join(F.broadcast(reps) if few else reps, docs.doc_id.eqNullSafe(F.col("id")), "left_semi").select("text")
    # Both joins read the one shuffle that tells the sets apart.
    sets = texts.mapInArrow(trimmed(_sets), "cid binary, shingles binary").join(F.broadcast(ends.select("cid")) if few else ends.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])
    first = near.join(sets.withColumnsRenamed({"cid": "b", "shingles": "y"}), "b")
    full = first.join(sets.withColumnsRenamed({"cid": "a", "shingles": "x"}), "a").select("a", "b", "x", "y")
    links = written(_tasked(full, near.count(), VERIFIED).mapInArrow(trimmed(_verified), "a binary, b binary"), "verified")
    discard(ids, asked, near, ends)
    return links


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


class _Chunk:
    """Members of a list, to be compared with probes."""

    def __init__(self, members):
        self.ids, sizes, places, parts, tables = zip(*members)
        self.sizes, self.places = np.array(sizes), np.array(places)
        self.codes: dict = {}
        self.parts = np.array([self.codes.setdefault(p, len(self.codes)) for p in parts])
        widths = np.array([len(t) for t in tables])
        self.by_width = [(w, at, np.frombuffer(b"".join(tables[i] for i in at), np.uint8).reshape(-1, w)) for w in np.unique(widths).tolist() for at in [np.flatnonzero(widths == w)]]

    def near(self, n: int, place: int, part, table: bytes, most: int | None) -> tuple[list, bool]:
        """The `most` nearest members of other components that the bounds let through, and whether there are others."""
        room = np.minimum(n - place, self.sizes - self.places)
        fit = (4 * np.minimum(self.sizes, n) >= 3 * np.maximum(self.sizes, n)) & (7 * room >= 3 * (self.sizes + n)) & (self.parts != self.codes.get(part, -1))
        if not fit.any():
            return [], False
        own, at, apart = np.frombuffer(table, np.uint8), [], []
        for width, who, tables in self.by_width:
            mine = np.flatnonzero(fit[who])
            if len(mine):
                size = min(width, len(own))
                differ = _folded(tables[mine], size) ^ _folded(own, size)
                at.append(who[mine])
                apart.append(np.bitwise_count(differ).sum(1, dtype=np.int64))
        at, apart = np.concatenate(at), np.concatenate(apart)
        near = 7 * apart <= self.sizes[at] + n
        at, apart = at[near], apart[near]
        more = most is not None and len(at) > most
        if more:
            at = at[np.argpartition(apart, most - 1)[:most]]
        return [self.ids[i] for i in at], more


def _nearest(most: int | None):
    """Rows (token, chunk, probe, cid, n, place, part, words), a (token, chunk) together and its chunk's members before its probes: the
    pairs (a, b) of each probe a with the `most` nearest members of other components that the bounds let through (None: with all);
    more: whether there are others."""

    def rows(batches):
        at, held, chunk = None, [], None
        for batch in batches:
            out = []
            for token, part_of, probe, cid, n, place, part, words in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if (token, part_of) != at:
                    at, held, chunk = (token, part_of), [], None
                if not probe:
                    held.append((cid, n, place, part, words))
                elif held:
                    chunk = chunk or _Chunk(held)
                    ids, more = chunk.near(n, place, part, words, most)
                    out += [(token, cid, x, more) for x in ids]
            if out:
                kinds = pa.int64(), pa.binary(), pa.binary(), pa.bool_()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["token", "a", "b", "more"])

    return rows


def _open_lists(entries: DataFrame, named: DataFrame) -> DataFrame:
    """The entries (token, gid, place) of lists that hold several components, with how many chunks their list takes and its largest component."""
    sizes = entries.join(named.select("gid", "part"), "gid").groupBy("token", "part").agg(F.count("*").alias("size"))
    lists = sizes.groupBy("token").agg(F.max_by("part", F.struct("size", "part")).alias("largest"), F.ceil(F.sum("size") / CHUNK).alias("chunks"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    return entries.select("token", "gid", "place").join(_small(written(lists, "open")), "token")


def _candidates(lists: DataFrame, member: DataFrame, probes: DataFrame | None, most: int | None) -> DataFrame:
    """Pairs (token, a, b, more) of members of different components: each probe (token, cid) against all chunks of its list; where no
    probes are given, the members outside the list's largest component."""
    rows = lists.join(member, "gid")
    if probes is None:
        rows = rows.withColumn("asks", F.col("part") != F.col("largest"))
    else:
        rows = rows.join(probes.withColumn("asks", F.lit(True)), ["token", "cid"], "left")
    home = F.array(F.struct(F.pmod(F.xxhash64("cid"), F.col("chunks")).alias("chunk"), F.lit(False).alias("probe")))
    meets = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("probe")))).otherwise(F.array().cast("array<struct<chunk:bigint,probe:boolean>>"))
    dealt = rows.select("token", F.explode(F.concat(home, meets)).alias("to"), "cid", "n", "place", "part", "words").select("token", "to.chunk", "to.probe", "cid", "n", "place", "part", "words")
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(n, "token", "chunk").sortWithinPartitions("token", "chunk", "probe")
    return _tasked(ordered, lists.count(), LISTED).mapInArrow(trimmed(_nearest(most)), "token bigint, a binary, b binary, more boolean")


def _moved(rows: DataFrame, moved: DataFrame | None) -> DataFrame:
    """rows (..., part, component) with what `moved` says of their part."""
    if moved is None:
        return rows
    joined = rows.join(moved, "part", "left").withColumns({"component": F.when(F.col("root").isNull(), F.col("component")).otherwise(F.col("least")), "part": F.coalesce("root", "part")})
    return joined.select(*rows.columns)


def _classified(docs: DataFrame, *kept: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, cid, kept columns) of docs (doc_id, text, kept columns), and for each cid its component's root and smallest id."""
    spark = docs.sparkSession
    docs = bounded(docs.select("doc_id", "text", *kept))
    shared = spark.sparkContext.broadcast(frequency_classes(docs))
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    rows = written(docs.mapInArrow(trimmed(_prefixed(shared, kept)), f"doc_id bigint, n bigint, cid binary, gid binary, prefix binary, bits binary, words binary{kinds}").drop("prefix"), "prefixes")
    classes = written(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("gid").alias("gid"), F.max("bits").alias("bits"), F.max("words").alias("words")), "classes")
    entries = rows.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    buckets = max(1, -(-entries // BUCKET))

    def entered(batches):  # the prefixes are made again: they would take more disk than all else
        yield from _packed(buckets, shared)(_prefixed(shared, ())(batches))

    packed = docs.mapInArrow(trimmed(entered), "bucket int, groups binary, entries binary")
    found = written(packed.repartition(buckets, "bucket").mapInArrow(trimmed(_met(shared)), "kind int, token bigint, a binary, b binary, place bigint"), "found")

    slim = written(rows.select("doc_id", "n", "cid", *kept), "rows")
    discard(rows)

    # Centres of groups stand for them; each member is also paired with its own centre.
    centres = written(classes.groupBy("gid").agg(F.min("cid").alias("centre"), F.count("*").alias("members")), "centres")
    own = classes.join(centres.where("members > 1"), "gid").select(F.col("centre").alias("a"), F.col("cid").alias("b"))
    heads = found.where("kind = 2").select("token", "a")
    meeting = written(_ordered(found.where("kind = 0").select("a", "b").union(heads.join(heads.groupBy("token").agg(F.min("a").alias("b")), "token").select("a", "b"))), "meeting")
    across = meeting
    for side in ("a", "b"):
        across = across.join(centres.select(F.col("gid").alias(side), F.col("centre").alias(f"{side}c")), side)
    used = [found, centres, meeting]
    tried = written(_ordered(across.select(F.col("ac").alias("a"), F.col("bc").alias("b")).union(own)), "pairs")
    links = _links(tried, classes, docs)
    used += [tried, links]
    found_in = components(links, classes.select(F.col("cid").alias("v"), F.col("rep").alias("rank")))
    named = classes.select("cid", "gid", "rep").join(_small(found_in).withColumnRenamed("v", "cid"), "cid", "left")
    named = written(named.select("cid", "gid", F.coalesce("root", "cid").alias("part"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("component")).alias("component")), "named")
    used += [named, found_in]

    # What the centres could not settle: lists that still hold several components. A group with several members is a list of its own, and of one with each group that it meets.
    many = centres.where("members > 1").select("gid")
    touched = meeting.join(many.select(F.col("gid").alias("a")), "a", "left_semi").union(meeting.join(many.select(F.col("gid").alias("b")), "b", "left_semi").select("a", "b")).distinct()
    touched = touched.union(many.select(F.col("gid").alias("a"), F.col("gid").alias("b")))
    both = touched.select(F.xxhash64("a", "b").alias("token"), F.explode(F.array_distinct(F.array("a", "b"))).alias("gid"), F.lit(0).cast("bigint").alias("place"))
    lists = found.where("kind = 1").select("token", F.col("a").alias("gid"), "place").union(both)
    lists = written(_open_lists(lists, named), "lists")
    gids = written(lists.select("gid").distinct(), "gids")
    member = written(classes.join(_small(gids), "gid", "left_semi").select("cid", "gid", "n", "words").join(named.select("cid", "part"), "cid"), "members")
    used += [lists, gids, member]
    probes = moved = None  # moved: (part, root, least) of the components that rounds have joined
    for most in () if lists.isEmpty() else ROUNDS:
        near = written(_candidates(lists, member, probes, most), "candidates")
        more = written(_ordered(near).join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(more)
        probes = written(near.where("more").select("token", F.col("a").alias("cid")).distinct(), "probes")
        used += [near, more, probes]
        last = probes.isEmpty()
        further = more if more.isEmpty() else _links(more, classes, docs)
        used.append(further)
        if not further.isEmpty():
            # Components of components: few vertices, whatever the size of each.
            ends = named.join(_small(written(further.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "ends")), "cid", "left_semi").select("cid", "part", "component")
            ends = written(_moved(ends, moved), "ends")
            bridges = further
            for side in ("a", "b"):
                bridges = bridges.join(ends.select(F.col("cid").alias(side), F.col("part").alias(f"{side}p")), side)
            bridges = written(bridges.select(F.col("ap").alias("a"), F.col("bp").alias("b")).where("a != b").distinct(), "bridges")
            merged = components(bridges, ends.select(F.col("part").alias("v"), F.col("component").alias("rank")).distinct())
            used += [ends, bridges, merged]
            merged = merged.select(F.col("v").alias("part"), "root", F.col("component").alias("least"))
            if moved is not None:
                before = _moved(moved.select(F.col("part").alias("from"), F.col("root").alias("part"), F.col("least").alias("component")), merged).select(F.col("from").alias("part"), F.col("part").alias("root"), F.col("component").alias("least"))
                merged = before.union(merged.join(moved.select("part"), "part", "left_anti"))
            moved = written(merged, "moved")
            used.append(moved)
        if last:
            break
        # What asks again, and the lists it asks in.
        again = probes.select("token").distinct()
        lists = written(lists.join(again, "token", "left_semi"), "lists")
        member = member.join(lists.select("gid").distinct(), "gid", "left_semi").withColumn("component", F.lit(None).cast("bigint"))
        member = written(_moved(member, moved).drop("component"), "members")
        used += [lists, member]
    named = written(_moved(named.drop("gid"), moved), "components")
    discard(classes, *used)
    return slim, named


def jaccard_components(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...): one row per row with doc_id, n_shingles, component_id.

    Null, empty or wordless text: an empty set, linked with nothing, its own component. Equal sets: one class. Very long texts
    are sets like others. Repeated rows give equal rows; ties do not arise. No rows give none. Null ids get the component's smallest id, null
    if all of its ids are null. Other columns are not read."""
    rows, named = _classified(docs)
    return rows.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, all columns: that with the smallest doc_id, nulls last, then the smallest MD5 of its text.

    Rows are told apart by id and text, so one id on two texts is two documents; of rows that repeat both, one stays. Rows without
    words are components of their own. No rows give none. Columns of any name stay as they are."""
    keyed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    rows, named = _classified(keyed, "key")
    rows = written(rows.join(named, "cid", "left").select("doc_id", "key", F.when(F.col("n") > 0, F.col("part")).alias("part")).groupBy("doc_id", "key", "part").agg(F.count("*").alias("copies")), "decided")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))
    first = rows.where("part is not null").groupBy("part").agg(F.min(order).alias("first"))
    gone = written(rows.join(first, "part").where(order != F.col("first")).select("doc_id", "key"), "gone")

    def same(df, marked):
        return df["doc_id"].eqNullSafe(marked["doc_id"]) & (F.md5(F.coalesce(df["text"], F.lit("")).cast("binary")) == marked["key"])

    left = docs.join(gone, same(docs, gone), "left_anti")
    again = written(rows.where("copies > 1").select("doc_id", "key").distinct(), "again")
    if again.isEmpty():
        return left
    return left.join(again, same(left, again), "left_anti").union(left.join(again, same(left, again), "left_semi").dropDuplicates(["doc_id", "text"]))
