"""BPE encoding and decoding through a minimal acyclic transducer (operator 7).

The corpus's most frequent words (with the space before them) are compiled with their id sequences into a minimal acyclic
automaton that shares prefixes and suffixes; counts on its transitions number the words, and the number leads to the ids. The file
is memory-mapped by each worker. Words that are not in it are merged exactly by the tokenizers library.

Plain texts, of ASCII and the Latin letters of two bytes, are cut into the words of the byte-level pattern. Others are cut only before
a space that a byte other than white space of any alphabet follows, which never cuts such a word, so ids of the parts are ids of the
text; of these parts the plain ones are cut into words, and the library takes the rest whole.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import os
import re
import struct
from array import array
from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_uri, bounded, chunked, fresh_path, open_fs, text_column, tokenizer_of, trimmed, written

#: Words in the lexicon, and bytes of the longest one.
LEXICON, LONGEST = 262144, 32
#: Words whose ids a worker remembers from one batch to the next.
REMEMBERED = 160_000
# Fixed value: the byte-level vocabulary's word pattern, for plain texts, in which bytes over 127 are parts of letters.
_WORD = re.compile(rb" ?[A-Za-z\x80-\xff]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+")
#: ASCII and the letters from U+00C0 to U+024F.
_PLAIN = re.compile(rb"(?:[\x00-\x7f]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])*+")
_CUT = re.compile(rb" (?![\x09-\x0d\x1c-\x20\xc2\xe1\xe2\xe3]|\Z)")
_MAGIC = b"SKTRANS1"
_BATCH = 2 << 20


def plain(text: bytes) -> bool:
    """Whether the word pattern for plain texts holds for the text; one that might name a special token is not plain."""
    return _PLAIN.fullmatch(text) is not None and b"<|" not in text


def pieces(text: bytes) -> list[bytes]:
    """The text cut before single spaces; the pieces join to the text."""
    first, *rest = _CUT.split(text)
    return [first, *[b" " + p for p in rest]]


def words_of(text: bytes) -> list[bytes]:
    """The words of a plain text; else those of its plain pieces, and the other pieces whole. They join to the text."""
    if plain(text):
        return _WORD.findall(text)
    out: list[bytes] = []
    for p in pieces(text):
        out.extend(_WORD.findall(p) if plain(p) else (p,))
    return out


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The file of a minimal acyclic transducer from sorted distinct words to id sequences.

    States are built from sorted words; a finished state that equals a known one (same finality and transitions) is replaced by it.
    Each transition holds how many words precede those through it, so a path's sum is the word's rank, which indexes its ids."""
    known: dict[tuple, int] = {}
    finished: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # the last word's states: final, transitions

    def close(depth: int) -> None:
        while len(path) > depth:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in known:
                known[key] = len(finished)
                finished.append(key)
            if path:
                path[-1][1][-1] = (path[-1][1][-1][0], known[key])

    last = b""
    for w in words:
        common = len(os.path.commonprefix([w, last]))
        close(common + 1)
        for b in w[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    reach: list[int] = []
    for final, edges in finished:  # targets come before their sources
        reach.append(int(final) + sum(reach[t] for _, t in edges))
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(finished):
        skip = int(final)
        for b, t in edges:
            keys.append(s << 8 | b)
            targets.append(t)
            skips.append(skip)
            skip += reach[t]
    arrays = [np.array(keys, "<u4"), np.array(targets, "<u4"), np.array(skips, "<u4"), np.array([f for f, _ in finished], "u1")]
    arrays += [np.cumsum([0, *map(len, ids)]).astype("<u4"), np.concatenate([np.empty(0, "<u4"), *ids]).astype("<u4")]
    head = struct.pack("<8s8I", _MAGIC, len(finished) - 1, len(words), *(len(a) for a in arrays))
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 4) for a in arrays)


class Transducer:
    """A compiled lexicon over a buffer; lookups run over many words at a time."""

    def __init__(self, buffer):
        magic, self.root, self.size, *lengths = struct.unpack_from("<8s8I", buffer)
        if magic != _MAGIC:
            raise ValueError("not a lexicon file")
        at, arrays = struct.calcsize("<8s8I"), []
        for n, kind in zip(lengths, ("<u4", "<u4", "<u4", "u1", "<u4", "<u4")):
            arrays.append(np.frombuffer(buffer, kind, n, at))
            at += arrays[-1].nbytes + -arrays[-1].nbytes % 4
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = arrays

    @classmethod
    def opened(cls, uri: str) -> Transducer:
        """From a file of the shared folder: memory-mapped where that is a mounted file system, so that the workers of a machine share the
        pages they use; else read."""
        from pyarrow import fs

        system, path = open_fs(uri)
        if isinstance(system, fs.LocalFileSystem):
            return cls(pa.memory_map(path).read_buffer())
        with system.open_input_file(path) as f:
            return cls(f.read_buffer())

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 if it is not in the lexicon."""
        rank = np.full(len(words), -1, np.int64)
        if not self.size or not words:
            return rank
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        alive = np.flatnonzero(length <= LONGEST)
        state, total, depth = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64), 0
        while len(alive):
            ends = length[alive] == depth
            done = ends & (self.final[state] > 0)
            rank[alive[done]] = total[done]
            alive, state, total = alive[~ends], state[~ends], total[~ends]
            if not len(alive) or not len(self.keys):
                break
            key = (state << 8 | data[start[alive] + depth]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, state, total = alive[ok], self.targets[at[ok]].astype(np.int64), total[ok] + self.skips[at[ok]]
            depth += 1
        return rank


@functools.lru_cache(maxsize=1)
def vocabulary(tokenizer_path: str):
    """The tokenizer and the bytes of its ids; a worker reads them once."""
    table = token_bytes(tokenizer_path)
    held = np.empty(len(table), object)
    held[:] = table
    return tokenizer_of(tokenizer_path), held


class Codec:
    """Encodes and decodes whole texts as the tokenizers library does with the same vocabulary."""

    def __init__(self, transducer: Transducer, tokenizer_path: str):
        self.transducer, self.remembered = transducer, {}
        self.tokenizer, self.table = vocabulary(tokenizer_path)
        self.model, self.shown = self.tokenizer.model, "".join(map(byte_letters().__getitem__, range(256)))

    def encode(self, texts: list[bytes | None]):
        """Yields the ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        for lo, hi in chunked(texts, _BATCH):
            cut = [words_of(t) if t else [] for t in texts[lo:hi]]
            seen = set().union(*cut)
            if len(self.remembered) > REMEMBERED:  # forget those that this batch lacks
                self.remembered = {w: self.remembered[w] for w in seen & self.remembered.keys()}
            known = self.remembered
            known.update(self.ids(list(seen.difference(known))))
            for words in cut:
                yield b"".join(map(known.__getitem__, words))

    def ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word: by the lexicon; else, if plain, merged by the library's model; else by the whole library tokenizer."""
        ranks = self.transducer.ranks(words)
        found = ranks[ranks >= 0]
        starts, held = self.transducer.starts, self.transducer.ids
        ids = dict(zip(compress(words, (ranks >= 0).tolist()), (held[b:e].tobytes() for b, e in zip(starts[found].tolist(), starts[found + 1].tolist()))))
        tokenize, shown, read, other = self.model.tokenize, self.shown, codecs.charmap_decode, []
        for w in compress(words, (ranks < 0).tolist()):
            if plain(w):
                ids[w] = array("I", [t.id for t in tokenize(read(w, "strict", shown)[0])]).tobytes()
            else:
                other.append(w)
        if other:
            for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)):
                ids[w] = array("I", e.ids).tobytes()
        return ids

    def decode(self, ids: bytes) -> bytes:
        """The text's UTF-8; bytes that are not UTF-8 become replacement characters."""
        out = b"".join(self.table[np.frombuffer(ids, "<u4")].tolist())
        return out if _is_utf8(out) else out.decode("utf-8", "replace").encode()


def _is_utf8(data: bytes) -> bool:
    if data.isascii():
        return True
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 up, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


def token_bytes(tokenizer_path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    back = {c: b for b, c in byte_letters().items()}
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    table = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def frequent_words(docs: DataFrame, size: int = LEXICON) -> list[bytes]:
    """The most frequent words over all documents, at most `size`; words of one count are all taken or none."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in text_column(batch, "text"):
                if t:
                    seen.update(words_of(t))
            if len(seen) > 250_000:
                yield row(seen)
                seen = Counter()
        yield row(seen)

    def row(seen):
        kept = [(w, n) for w, n in seen.items() if len(w) <= LONGEST]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    counts = bounded(docs).select("text").mapInArrow(trimmed(count), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.where("n > 1"), "words")
    # The least count that leaves at most `size` words, from a row for each different count; then only those words come here.
    histogram = counts.groupBy("n").agg(F.count("*").alias("words"))
    above = histogram.withColumn("total", F.sum("words").over(Window.orderBy(F.desc("n"))))
    least = above.where(F.col("total") <= size).agg(F.min("n")).first()[0]
    return [] if least is None else [bytes(r["word"]) for r in counts.where(F.col("n") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer_path: str, size: int = LEXICON) -> bytes:
    words = sorted(frequent_words(docs, size))
    ids = Codec(Transducer(compile_lexicon([], [])), tokenizer_path).ids(words)
    return compile_lexicon(words, [np.frombuffer(ids[w], "<u4") for w in words])


def lexicon_file(docs: DataFrame, tokenizer_path: str, lexicon: bytes | None) -> str:
    """The lexicon (that of docs, unless given), written once as a file of the shared folder."""
    data = build_lexicon(docs, tokenizer_path) if lexicon is None else lexicon
    folder = as_uri(docs.sparkSession, fresh_path(docs.sparkSession, "lexicon"))
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/words.fsa") as f:
        f.write(data)
    return f"{folder}/words.fsa"


def encoded(docs: DataFrame, tokenizer_path: str, lexicon: bytes | None = None) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, n_tokens, ids_sha256 (over little-endian unsigned 32-bit integers), decoded_sha256.

    Null and empty texts have no ids; very long ones are encoded whole. Ties do not arise: equal words have equal ids. Repeated rows
    repeat, ids may be null. An empty table gives an empty result. Other columns are not read. Nothing but the digests leaves a worker."""
    uri = lexicon_file(docs, tokenizer_path, lexicon)

    def rows(batches):
        codec = Codec(Transducer.opened(uri), tokenizer_path)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for ids in codec.encode(text_column(batch, "text")):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(docs).select("doc_id", "text").mapInArrow(trimmed(rows), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, tokenizer_path: str, lexicon: bytes | None = None) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, ids as an array. The same treatment of nulls and repeats as `encoded`."""
    uri = lexicon_file(docs, tokenizer_path, lexicon)

    def rows(batches):
        codec = Codec(Transducer.opened(uri), tokenizer_path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(text_column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return bounded(docs).select("doc_id", "text").mapInArrow(trimmed(rows), "doc_id bigint, ids array<int>")
