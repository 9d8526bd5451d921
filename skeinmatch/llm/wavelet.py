"""Token files as wavelet matrices (operator 4).

A shard file holds the ids of consecutive documents as a wavelet matrix: one bit plane for each bit of the (dense) alphabet. Planes are cut
into frames, each compressed by itself, and the file holds how many ones stand before each frame. So token access, counting and
occurrence lookup by rank and select read only the frames they pass through, and one compressed file serves all of them.

File: magic, header length, header (JSON: tokens, zeros of each plane, sizes of the parts), then the parts, each compressed with zstandard: alphabet, which
ids are null, ids, lengths, ones before each frame, sizes of the frames; then the frames, plane by plane.
"""

from __future__ import annotations

import codecs
import io
import json
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_transducer import byte_letters
from .common import Memo, as_uri, bounded, chunked, fresh_path, mix, open_fs, text_column, tokenizer_of, trimmed, written

END = 1
#: Tokens after which a partition begins another shard file.
SHARD_TOKENS = 4_000_000
#: Bytes of a frame before compression; frames that a matrix holds at a time; bits of a block, whose ones are counted when its frame is loaded.
FRAME_BYTES, HELD_FRAMES = 1 << 15, 256
_BLOCK = 512
_MAGIC = b"SKWAVE02"


class WaveletMatrix:
    """n values; zeros: how many each plane has, from the highest; ones[level]: how many stand before each frame, and in all; load(level, frame): a frame's bytes."""

    def __init__(self, n: int, zeros: list[int], ones: np.ndarray, load):
        self.n, self.zeros, self.ones, self.load = n, zeros, ones, load
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.loaded = 0

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, a = [], [], values
        for k in reversed(range(bits)):
            bit = (a & a.dtype.type(1 << k)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low = np.compress(~bit, a)  # by places, not by branches on random bits
            zeros.append(len(low))
            a = np.concatenate([low, np.compress(bit, a)])
        frames = -(-len(planes[0]) // FRAME_BYTES)
        cut = lambda level, f: planes[level][f * FRAME_BYTES : (f + 1) * FRAME_BYTES]
        counts = np.array([[int(np.bitwise_count(cut(level, f)).sum(dtype=np.int64)) for f in range(frames)] for level in range(bits)], np.int64).reshape(bits, frames)
        return cls(len(values), zeros, np.pad(np.cumsum(counts, 1), ((0, 0), (1, 0))), cut)

    def _frame(self, level: int, f: int) -> tuple[np.ndarray, np.ndarray]:
        """A frame as rows of blocks, and the ones before each block of it."""
        found = self.held.get((level, f))
        if found is None:
            self.loaded += 1
            data = np.frombuffer(self.load(level, f), np.uint8)
            blocks = np.pad(data, (0, -len(data) % (_BLOCK // 8))).reshape(-1, _BLOCK // 8)
            found = blocks, np.concatenate([[0], np.cumsum(np.bitwise_count(blocks).sum(1, dtype=np.int64))])
            while len(self.held) >= HELD_FRAMES:
                self.held.pop(next(iter(self.held)))
            self.held[level, f] = found
        return found

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        f, j = divmod(i, 8 * FRAME_BYTES)
        if f >= self.ones.shape[1] - 1 or not j:
            return int(self.ones[level, f])
        blocks, before = self._frame(level, f)
        block, rest = divmod(j, _BLOCK)
        if not rest:
            return int(self.ones[level, f] + before[block])
        row = blocks[block]
        part = int(np.bitwise_count(row[: rest >> 3]).sum()) + int(row[rest >> 3] & (1 << (rest & 7)) - 1).bit_count()
        return int(self.ones[level, f] + before[block]) + part

    def _bit(self, level: int, i: int) -> int:
        f, j = divmod(i, 8 * FRAME_BYTES)
        block, rest = divmod(j, _BLOCK)
        return int(self._frame(level, f)[0][block][rest >> 3] >> (rest & 7) & 1)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) bit of that value stands."""

        def before(ones, size):
            return ones if bit else np.arange(len(ones)) * size - ones

        frames = before(self.ones[level], 8 * FRAME_BYTES)
        f = int(np.searchsorted(frames, k, "right")) - 1
        f = min(f, len(frames) - 2)
        blocks, ones = self._frame(level, f)
        k -= int(frames[f])
        counts = before(ones, _BLOCK)
        block = min(int(np.searchsorted(counts, k, "right")) - 1, len(blocks) - 1)
        bits = np.unpackbits(blocks[block], bitorder="little")
        return f * 8 * FRAME_BYTES + block * _BLOCK + int(np.flatnonzero(bits == bit)[k - counts[block]])

    def access(self, i: int) -> int:
        """The value at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for level, z in enumerate(self.zeros):
            bit, one = self._bit(level, i), self._rank1(level, i)
            i = z + one if bit else i - one
            v = v << 1 | bit
        return v

    def access_many(self, places: np.ndarray) -> np.ndarray:
        """The values at many places, a level and a frame at a time."""
        at, out = np.array(places, np.int64), np.zeros(len(places), np.int64)
        for level, z in enumerate(self.zeros):
            frame, inside = np.divmod(at, 8 * FRAME_BYTES)
            bit, one = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            for f in np.unique(frame).tolist():
                who = np.flatnonzero(frame == f)
                blocks, before = self._frame(level, f)
                block, rest = np.divmod(inside[who], _BLOCK)
                byte = rest >> 3
                head = np.bitwise_count(blocks[block]) * (np.arange(_BLOCK // 8) < byte[:, None])
                last = blocks[block, byte].astype(np.int64)
                bit[who] = last >> (rest & 7) & 1
                one[who] = self.ones[level, f] + before[block] + head.sum(1, dtype=np.int64) + np.bitwise_count(last & (1 << (rest & 7)) - 1)
            at = np.where(bit == 1, z + one, at - one)
            out = out << 1 | bit
        return out

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (z + a, z + b) if value >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often value stands in places lo up to hi."""
        if value >> len(self.zeros):
            return 0
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of value."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._range(value, 0, self.n)[0] + k
        for level in reversed(range(len(self.zeros))):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def values(self) -> np.ndarray:
        """All values, from the lowest plane up."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k, z in enumerate(reversed(self.zeros)):
            level = len(self.zeros) - 1 - k
            plane = np.concatenate([np.frombuffer(self.load(level, f), np.uint8) for f in range(self.ones.shape[1] - 1)] or [np.empty(0, np.uint8)])
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~bit)] = out[:z]
            above[np.flatnonzero(bit)] = out[z:] | kind(1 << k)
            out = above
        return out


def shard_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    import zstandard

    present = np.zeros(int(ids.max(initial=0)) + 1, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype("<u4")
    dense = (np.cumsum(present) - 1).astype(np.uint16 if len(alphabet) <= 65536 else np.uint32)
    matrix = WaveletMatrix.build(dense[ids], max(1, int(len(alphabet) - 1).bit_length()))
    press = zstandard.ZstdCompressor(level=1)
    frames = [press.compress(np.ascontiguousarray(matrix.load(level, f)).tobytes()) for level in range(len(matrix.zeros)) for f in range(matrix.ones.shape[1] - 1)]
    parts = [alphabet, np.array([d is None for d in doc_ids], "u1"), np.array([d or 0 for d in doc_ids], "<i8"), np.array(lengths, "<i8"), matrix.ones.astype("<i8"), np.array([len(x) for x in frames], "<u4")]
    packed = [press.compress(p.tobytes()) for p in parts]
    head = json.dumps({"n": len(ids), "zeros": matrix.zeros, "sizes": [len(p) for p in packed]}).encode()
    return _MAGIC + struct.pack("<I", len(head)) + head + b"".join(packed) + b"".join(frames)


class Shard:
    """A shard file: documents and their tokens, by rank and select on the planes. file: bytes, or seekable and read by ranges."""

    def __init__(self, file):
        import zstandard

        self.file, self.press = io.BytesIO(file) if isinstance(file, bytes) else file, zstandard.ZstdDecompressor()
        magic = self._read(0, 12)
        if magic[:8] != _MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack_from("<I", magic, 8)
        head = json.loads(self._read(12, size))
        self.places = list(zip(np.cumsum([12 + size, *head["sizes"]]).tolist(), head["sizes"]))
        self.alphabet, ones, sizes = self._part(0, "<u4"), self._part(4, "<i8").reshape(len(head["zeros"]), -1), self._part(5, "<u4").astype(np.int64)
        begin = sum(self.places[-1]) + np.cumsum(sizes) - sizes
        frames = ones.shape[1] - 1

        def load(level: int, f: int) -> bytes:
            k = level * frames + f
            return self.press.decompress(self._read(int(begin[k]), int(sizes[k])))

        self.matrix = WaveletMatrix(head["n"], head["zeros"], ones, load)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _part(self, k: int, kind: str) -> np.ndarray:
        at, n = self.places[k]
        return np.frombuffer(self.press.decompress(self._read(at, n)), kind)

    @property
    def doc_ids(self) -> list[int | None]:
        return [None if m else int(d) for m, d in zip(self._part(1, "u1"), self._part(2, "<i8"))]

    @property
    def lengths(self) -> np.ndarray:
        return self._part(3, "<i8")

    def _dense(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def token(self, i: int) -> int:
        return int(self.alphabet[self.matrix.access(i)])

    def tokens_at(self, places: np.ndarray) -> np.ndarray:
        return self.alphabet[self.matrix.access_many(places)]

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        v = self._dense(token)
        return 0 if v is None else self.matrix.count(v, lo, hi)

    def occurrence(self, token: int, k: int) -> int:
        v = self._dense(token)
        if v is None:
            raise IndexError(k)
        return self.matrix.locate(v, k)

    def tokens(self) -> np.ndarray:
        return self.alphabet[self.matrix.values()].astype("<u4") if self.matrix.n else np.empty(0, "<u4")


class _Collision(Exception):
    """Two different words met under one 64-bit key; the block goes the longer way."""


#: Of each byte of plain text: 0 white space, 1 letter, 2 digit, 3 other. Then masks of the first 0 to 8 bytes.
_KIND = np.array([0 if b in b"\t\n\v\f\r " else 1 if b >= 128 or 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.uint8)
_ASCII = bytes(range(128))
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class WordEncoder:
    """Ids of texts by a vocabulary whose normaliser and word pattern drop white space.

    No token crosses ASCII white space, so a run of other bytes is encoded when it is first met. A run of ASCII and European letters is cut into
    words by the vocabulary's pattern and the words go to the library's model; other runs, and those that may hold a special token, go
    through the whole library tokenizer."""

    # The vocabulary's word pattern for lower-case text of ASCII and the letters U+00C0 to U+017F, in UTF-8; a line
    # break parts runs. Then the runs it serves: dotted capital I is left out, as its lower case is two characters.
    WORD = re.compile(rb"\n|'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+|[0-9]|[^\sa-z0-9\x80-\xff]+")
    PLAIN = re.compile(rb"(?:[\x00-\x7f]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])*")

    def __init__(self, tokenizer_path: str):
        self.tokenizer = tokenizer_of(tokenizer_path)
        self.model = self.tokenizer.model
        self.shown = "".join(map(byte_letters().__getitem__, range(256)))
        self.runs, self.words = Memo(100_000), Memo(200_000, hot=0)

    def _merged(self, words: list[bytes]) -> dict[bytes, bytes]:
        tokenize, shown, read = self.model.tokenize, self.shown, codecs.charmap_decode
        made = {w: array("I", [t.id for t in tokenize(read(w, "strict", shown)[0])]).tobytes() for w in words}
        if b"\n" in made:
            made[b"\n"] = b"\xff\xff\xff\xff"  # no id; it parts the runs
        return made

    def _encoded(self, runs: list[bytes]) -> dict[bytes, bytes]:
        plain = [r for r in runs if (r.isascii() or self.PLAIN.fullmatch(r)) and b"<|" not in r]
        words = self.WORD.findall("\n".join([r.decode() for r in plain]).lower().encode())
        joined = b"".join(*self.words.values([words], self._merged))
        cuts = (np.flatnonzero(np.frombuffer(joined, "<u4") == 0xFFFFFFFF) * 4).tolist()
        out = dict(zip(plain, (joined[b:e] for b, e in zip([0, *(c + 4 for c in cuts)], [*cuts, len(joined)]))))
        other = [r for r in runs if r not in out]
        for r, e in zip(other, self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in other], add_special_tokens=False)):
            out[r] = array("I", e.ids).tobytes()
        return out

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts of plain letters without apostrophes, where words are runs of letters, single digits and runs of other bytes.

        Words are cut and told apart in arrays: length, first and last eight bytes say all about a word of up to 16 bytes; longer
        words go through a map."""
        buffer = b"\n".join([b"", *texts, bytes(16)])
        a = np.frombuffer(buffer, np.uint8)
        kind = _KIND[a[: len(a) - 16]]
        cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
        word = kind[cuts] != 0
        starts, ends = cuts[word], np.append(cuts, len(kind))[1:][word]
        size = ends - starts
        eight = np.ndarray((len(a) - 7,), "<u8", buffer=a, strides=(1,))
        head = eight[starts] & _HEAD[np.minimum(size, 8)]
        tail = np.where(size > 8, eight[np.maximum(ends - 8, 0)], 0).astype(np.uint64)
        short = np.flatnonzero(size <= 16)
        key = mix(head[short] * np.uint64(0x9E3779B97F4A7C15) + mix(tail[short] + size[short].astype(np.uint64)))
        _, one, same = np.unique(key, return_index=True, return_inverse=True)
        one = short[one]
        twin = one[same]
        if not ((head[twin] == head[short]) & (tail[twin] == tail[short]) & (size[twin] == size[short])).all():
            raise _Collision
        which = np.empty(len(starts), np.int64)
        which[short] = same
        words = [buffer[b:e] for b, e in zip(starts[one].tolist(), ends[one].tolist())]
        far = np.flatnonzero(size > 16)
        long = [buffer[b:e] for b, e in zip(starts[far].tolist(), ends[far].tolist())]
        place = {w: len(words) + i for i, w in enumerate(dict.fromkeys(long))}
        which[far] = [place[w] for w in long]
        (values,) = self.words.values([[*words, *place]], self._merged)
        held = np.frombuffer(b"".join(values), "<u4")
        n = np.array([len(v) for v in values], np.int64) // 4
        begin = np.cumsum(n) - n
        count = n[which]
        until = np.cumsum(count)
        total = int(until[-1]) if len(until) else 0
        ids = held[np.repeat(begin[which] - (until - count), count) + np.arange(total)].tobytes()
        first = np.cumsum([1, *(len(t) + 1 for t in texts)])
        at = np.append(0, until)[np.searchsorted(starts, first)] * 4
        return [ids[b:e] for b, e in zip(at.tolist(), at[1:].tolist())]

    def encode(self, texts: list[bytes | None]):
        """Yields the ids of each text as little-endian unsigned 32-bit integers."""
        for lo, hi in chunked(texts, 4 << 20):
            part = [t or b"" for t in texts[lo:hi]]
            plain = [i for i, t in enumerate(part) if b"'" not in t and b"<|" not in t and self.PLAIN.fullmatch(t.translate(None, _ASCII))]
            try:
                out = dict(zip(plain, self._plain([part[i].decode().lower().encode() for i in plain])))
            except _Collision:
                out = {}
            rest = [i for i in range(len(part)) if i not in out]
            cut = [part[i].split() for i in rest]
            out.update(zip(rest, map(b"".join, self.runs.values(cut, self._encoded))))
            yield from map(out.__getitem__, range(len(part)))


_MANIFEST = "part int, path string, start bigint, n_tokens bigint, n_docs bigint"


def _writer(folder: str, tokenizer_path: str):
    def rows(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        encoder, fs, base = WordEncoder(tokenizer_path), *open_fs(folder)
        end = np.array([END], "<u4").tobytes()
        held: list[bytes] = []
        docs: list[int | None] = []
        size = 0

        def flush():
            ids = np.frombuffer(b"".join(held), "<u4")
            path = f"{base}/{part:06d}-{uuid.uuid4().hex}.wave"
            with fs.open_output_stream(path) as f:
                f.write(shard_bytes(ids, docs, [len(h) // 4 for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(docs)], pa.int64())], ["part", "path", "start", "n_tokens", "n_docs"])

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), encoder.encode(text_column(batch, "text"))):
                held.append(ids + end)
                docs.append(d)
                size += len(ids) // 4 + 1
                if size >= SHARD_TOKENS:
                    yield flush()
                    at, size = at + size, 0
                    held.clear()
                    docs.clear()
        if held:
            yield flush()

    return rows


def write_shards(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs (doc_id, text, ...) as shard files in the shared folder, in ascending doc_id order (null first, ties by text).

    Null and empty texts are documents of the end id alone; very long ones may make a file larger than others; repeated rows repeat. No
    rows write no files. Other columns are not read. Returns the manifest, a written table: path, start (ids in all files before it), n_tokens, n_docs. A file that a lost or repeated
    task left is not in it."""
    spark = docs.sparkSession
    folder = as_uri(spark, fresh_path(spark, "shards"))
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = bounded(docs).select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(trimmed(_writer(folder, tokenizer_path)), _MANIFEST), "manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a partition
    total, base_of = 0, []
    for r in parts:
        base_of.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(base_of, "part int, base bigint")
    return manifest.join(F.broadcast(offsets), "part").select(F.lit(folder).alias("folder"), "path", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "n_docs")


def _reader(batches):
    for batch in batches:
        for folder, path, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
            with open_fs(folder)[0].open_input_file(path) as f:
                shard = Shard(f)
                ids, doc_ids, lengths = shard.tokens(), shard.doc_ids, shard.lengths
                ends = np.cumsum(lengths)
                begins = ends - lengths
                # The same file by rank: every document ends with the end id where its length says so.
                for lo in range(0, len(ends), 1 << 14):
                    if (shard.tokens_at(ends[lo : lo + (1 << 14)] - 1) != END).any():
                        raise ValueError(f"{path}: a document does not end where it should")
            crc = [zlib.crc32(ids[b:e].tobytes()) for b, e in zip(begins, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens (with the end id), ids_crc32. An empty manifest gives none."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("folder", "path", "start").repartition(n, "path").mapInArrow(trimmed(_reader), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
