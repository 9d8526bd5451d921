import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skeinmatch.llm import binpack, bpe_transducer, components, lang_ecoc, license_tfidf, prefix_join, qgram_decon, scaled_sketch, shingles, warc_zip, wavelet, weak_toxicity
from skeinmatch.llm.queries import BYTE_BPE, QUERIES, WORD_BPE

WORDS = "alpha beta gamma delta omega river stone cloud ember frost maple cedar quiet amber".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n bigint, component_id string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ly"]) for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    base = prose(rng, 80)
    return [None, "", " \n\t", "x", "...", "\x00\x01", "日本語 テキスト　です", "a" * 3000, base, base, base.upper(), base + " more", prose(rng, 6000), "<|endoftext|> é <|startoftext|>", "é" * 50 + " " * 9 + " z", "one two three", "ONE two\x0bthree"]


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", 0, 0.5, 1, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    ids = list(range(3, 3 + len(odd_texts())))
    df = docs_of(spark, odd_texts(), ids)
    return df.union(df.where("doc_id = 11"))  # a repeated row


def near(a, b, tol=1e-9):
    return abs(a - b) <= tol


def test_whole_vocabularies(spark, odd):
    rows = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    byte, word = Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE)
    got = bpe_transducer.encoded(odd, BYTE_BPE).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = byte.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    at = 0
    files = sorted(wavelet.read_shards(wavelet.write_shards(odd, WORD_BPE)).collect(), key=lambda r: (r["doc_id"], r["start"]))
    for r in files:
        ids = [*word.encode(rows[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(files) == odd.count()


def test_encoders_on_mixed_alphabets():
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "b's", "'ll", "'S", "é", "　", "\xa0", "\x1c", "\x01", "1", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "Σας", "İ", "W̊", "̸", " the", "🙂", "\r\n", "ẞ", "中文", "–", "THE", "×", "ŉ", "ſ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    byte, word = Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE)
    frequent = sorted({p for t in texts[:500] for p in bpe_transducer.pieces(t.encode()) if len(p) <= bpe_transducer.LONGEST})
    lexicon = bpe_transducer.compile_lexicon(frequent, [byte.encode(p.decode(), add_special_tokens=False).ids for p in frequent])
    codec, encoder = bpe_transducer.Codec(bpe_transducer.Transducer(lexicon), BYTE_BPE), wavelet.WordEncoder(WORD_BPE)
    for t, x, y in zip(texts, codec.encode([t.encode() for t in texts]), encoder.encode([t.encode() for t in texts])):
        ids = np.frombuffer(x, "<u4").tolist()
        assert ids == byte.encode(t, add_special_tokens=False).ids and codec.decode(x).decode() == byte.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(y, "<u4").tolist() == word.encode(t, add_special_tokens=False).ids


def test_words_of_plain_texts():
    rng = random.Random(5)
    letters = [chr(c) for c in range(0xC0, 0x250)]  # two of them, the signs for times and divided by, are no letters
    parts = [*letters, *(chr(c) for c in range(128)), *" \n'" * 40, "'s", "'LL", "  ", " \n ", "été", " The", "42", "..."]
    texts = ["".join(letters), *("".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000))]
    byte = Tokenizer.from_file(BYTE_BPE)
    codec = bpe_transducer.Codec(bpe_transducer.Transducer(bpe_transducer.compile_lexicon([], [])), BYTE_BPE)
    assert sum(bpe_transducer.plain(t.encode()) for t in texts) > 1500
    for t, x in zip(texts, codec.encode([t.encode() for t in texts])):
        assert b"".join(bpe_transducer.words_of(t.encode())) == t.encode()
        assert np.frombuffer(x, "<u4").tolist() == byte.encode(t, add_special_tokens=False).ids and codec.decode(x) == t.encode()


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(bpe_transducer, "REMEMBERED", 5)
    monkeypatch.setattr(bpe_transducer, "_BATCH", 30)
    texts = [f"one word{i % 7} two{i} été—{i % 3}" for i in range(60)]
    byte = Tokenizer.from_file(BYTE_BPE)
    codec = bpe_transducer.Codec(bpe_transducer.Transducer(bpe_transducer.compile_lexicon([], [])), BYTE_BPE)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode([t.encode() for t in texts])] == [byte.encode(t, add_special_tokens=False).ids for t in texts]


def test_transducer_is_minimal_and_exact():
    words = sorted({b"walk", b"walks", b"walked", b"talk", b"talks", b"talked", b""})
    t = bpe_transducer.Transducer(bpe_transducer.compile_lexicon(words, [[i, i] for i in range(len(words))]))
    assert t.ranks(words).tolist() == list(range(len(words))) and t.ranks([b"wal", b"walkss", b"z", b"a" * 99]).tolist() == [-1] * 4
    assert t.root + 1 == 7  # walk and talk share all that follows the first letter
    empty = bpe_transducer.Transducer(bpe_transducer.compile_lexicon([], []))
    assert empty.ranks([b"a", b""]).tolist() == [-1, -1]


def test_wavelet_access_count_locate():
    rng = np.random.default_rng(1)
    ids = (rng.integers(0, 90, 5000) * 11).astype("<u4")
    s = wavelet.Shard(wavelet.shard_bytes(ids, [1, None], [2000, 3000]))
    assert (s.tokens() == ids).all() and s.doc_ids == [1, None]
    assert [s.token(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    for v in (0, 11, 979, 5):
        at = np.flatnonzero(ids == v)
        assert s.count(v) == len(at) and s.count(v, 10, 4000) == ((at >= 10) & (at < 4000)).sum()
        assert [s.occurrence(v, k) for k in range(len(at))] == at.tolist()
    with pytest.raises(IndexError):
        s.occurrence(0, 10**6)
    assert wavelet.Shard(wavelet.shard_bytes(np.empty(0, "<u4"), [], [])).tokens().tolist() == []


def test_wavelet_reads_frames(monkeypatch):
    """Frames of 64 bytes: access, ranges, occurrences, many places at once; few frames are read and few are held."""
    monkeypatch.setattr(wavelet, "FRAME_BYTES", 64)
    monkeypatch.setattr(wavelet, "HELD_FRAMES", 5)
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 40, 7000), np.full(3000, 7), np.arange(30)]).astype("<u4")
    data = wavelet.shard_bytes(ids, [5], [len(ids)])
    assert (wavelet.Shard(data).tokens() == ids).all()
    s = wavelet.Shard(data)
    places = rng.integers(0, len(ids), 500)
    assert s.tokens_at(places).tolist() == ids[places].tolist() and len(s.matrix.held) <= 5
    for i in (0, 511, 512, 513, 5120, len(ids) - 1):
        s = wavelet.Shard(data)
        assert s.token(i) == ids[i] and s.matrix.loaded <= len(s.matrix.zeros)
    for v in (0, 7, 39):
        at = np.flatnonzero(ids == v)
        for lo, hi in ((0, 512), (511, 5121), (0, len(ids))):
            assert s.count(v, lo, hi) == ((at >= lo) & (at < hi)).sum()
        assert [s.occurrence(v, k) for k in range(0, len(at), 37)] == at[::37].tolist()


def test_pages_of_shards_are_checked(spark):
    folder = wavelet.write_shards(docs_of(spark, ["some words", None, ""]), WORD_BPE)
    assert wavelet.read_shards(folder.limit(0)).count() == 0
    with pytest.raises(ValueError):
        wavelet.Shard(b"no shard file, but long enough")


def brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {(i, len(sets[i]), label[i]) for i in sets}


def test_jaccard_join(spark, odd):
    rng = random.Random(3)
    texts = odd_texts()
    shared = prose(rng, 60)
    for _ in range(12):  # chains of near copies, a common passage, copies of one another
        words = prose(rng, 60).split()
        for _ in range(5):
            words[rng.randrange(60)] = rng.choice(WORDS) + "x"
            texts.append(" ".join(words))
        texts.append(shared + " " + prose(rng, rng.randint(5, 60)))
    texts += [shared] * 30
    df = docs_of(spark, texts)
    got = prefix_join.jaccard_components(df).collect()
    assert {tuple(r) for r in got} == brute_components(list(enumerate(texts))) and len(got) == len(texts)
    kept = prefix_join.first_of_each_group(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in (tuple(r) for r in got)}
    repeated = prefix_join.jaccard_components(odd).where("doc_id = 11").collect()
    assert len(repeated) == 2 and repeated[0] == repeated[1]


@pytest.mark.parametrize("settings", [{}, {"CHUNK": 7, "PIECE": 5, "BROADCAST_IDS": 0, "ONE_TASK": -1}])
def test_jaccard_join_long_lists(spark, monkeypatch, settings):
    """Near copies whose lists are long, in one piece and in many, with ids to verify broadcast or shuffled."""
    for name, value in settings.items():
        monkeypatch.setattr(components if name == "ONE_TASK" else prefix_join, name, value)
    rng = random.Random(8)
    base = prose(rng, 50).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(50)] = f"{rng.choice(WORDS)}{rng.randrange(5)}"
        texts.append(" ".join(w))
    got = prefix_join.jaccard_components(docs_of(spark, texts)).collect()
    assert {tuple(r) for r in got} == brute_components(list(enumerate(texts)))


def test_jaccard_join_shared_core(spark):
    """300 texts that share 70 % of their shingles are not linked, but for a chain through a few of them."""
    rng = random.Random(9)
    core = [f"c{i}" for i in range(74)]
    texts = [" ".join(core + [f"u{k}x{i}" for i in range(30)]) for k in range(300)]
    for k in range(5):
        words = texts[-1].split()
        words[73 - k] = f"chain{k}"
        words[-1 - 2 * k] = f"end{k}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    got = prefix_join.jaccard_components(docs_of(spark, texts)).collect()
    assert {tuple(r) for r in got} == brute_components(list(enumerate(texts)))
    assert len({r["component_id"] for r in got}) < 305


def test_jaccard_join_ids(spark):
    """Near copies whose ids are all null, one id on two texts, rows that repeat."""
    rng = random.Random(10)
    a, b = prose(rng, 60), prose(rng, 60)
    near = a + " more"
    docs = spark.createDataFrame([(4, a), (None, near), (None, b)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in prefix_join.jaccard_components(docs).collect()}
    assert {(i, c) for i, _, c in got} == {(4, 4), (None, 4), (None, None)}
    rows = [(3, a, "x"), (5, near, "y"), (5, b, "z"), (5, b, "z"), (None, near, "n"), (None, None, "e"), (6, "", "f")]
    kept = prefix_join.first_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string, cid string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, a, "x"), (5, b, "z"), (None, None, "e"), (6, "", "f")], key=str)


def test_word_hashes():
    """Words of any length, also such as a polynomial modulo a power of two confuses."""
    thue = [0]
    while len(thue) < 2048:
        thue += [1 - x for x in thue]
    words = ["a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 64, "a" * 65, "a" * 70000, "b" * 65, "\u00e9" * 40]
    words += ["".join("ab"[x] for x in thue), "".join("ba"[x] for x in thue)]
    hashes, starts = shingles.word_hashes(" ".join(words).encode())
    assert len(set(hashes.tolist())) == len(words)
    upper, _ = shingles.word_hashes("\n".join(words).upper().replace("\u00c9", "\u00e9").encode())
    assert (upper == hashes).all() and starts[1] == 2


def test_fingerprints(spark, odd):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()))
    got = scaled_sketch.fingerprints(odd).collect()
    assert len(got) == len(rows)
    want = set()
    for (i, t), (_, x) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        want.add((i, len(t), hashlib.sha256((t[: len(t) - k] + x[:k]).encode()).hexdigest()))
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got} == want
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())
    alone = scaled_sketch.fingerprints(odd.where("doc_id = 15")).first()
    assert alone["near_next"] == 1.0


def test_sketch_containment_and_merge():
    rng = random.Random(4)
    small, rest = prose(rng, 900).encode(), prose(rng, 9000).encode()
    a, b, whole = scaled_sketch.sketches([small, rest, small + b" " + rest])
    h = lambda t, s: scaled_sketch.unpack(scaled_sketch.pack(t, s))
    assert scaled_sketch.likeness(h(small, a), h(b"w", whole)) > 0.95 > 0.2 > scaled_sketch.likeness(h(small, a), h(rest, b))
    assert len(np.setdiff1d(scaled_sketch.merge(a, b), whole)) <= 4


def test_sketch_error():
    """Measured error of the estimated containment on edited texts, by length; a mean error of what the fraction of kept hashes allows."""
    rng = random.Random(12)
    errors = {}
    for n in (30, 300, 3000):
        texts = [prose(rng, n).encode() for _ in range(60)]
        edited = [t[: len(t) * 3 // 4] + x[: len(x) // 4] for t, x in zip(texts, texts[1:] + texts[:1])]
        grams = lambda t: {t[i : i + scaled_sketch.WIDTH] for i in range(len(t) - scaled_sketch.WIDTH + 1)}
        wrong = []
        for t, e, x, y in zip(texts, edited, scaled_sketch.sketches(texts), scaled_sketch.sketches(edited)):
            a, b = sorted((grams(t), grams(e)), key=len)
            said = scaled_sketch.likeness(scaled_sketch.unpack(scaled_sketch.pack(t, x)), scaled_sketch.unpack(scaled_sketch.pack(e, y)))
            wrong.append(abs(said - len(a & b) / len(a)))
        errors[n] = float(np.mean(wrong))
    assert errors[30] < 0.1 and errors[300] < 0.04 and errors[3000] < 0.015, errors


def test_vector_packing():
    """Against a plain loop; bytes, tokens and rows come out near even together."""
    rng = np.random.default_rng(5)
    v = np.column_stack([rng.lognormal(6, 1, 900), rng.lognormal(4, 1, 900), rng.integers(1, 9, 900)])
    order = np.argsort(-(v / v.sum(0)).max(1), kind="stable")
    got = binpack.place(v, order, 6)
    left = [[1.0] * 3 for _ in range(6)]
    share = [v[:, k].sum() / 6 for k in range(3)]
    for i in order:
        u = [v[i, k] / share[k] for k in range(3)]
        open_ = [s for s in range(6) if all(a >= b for a, b in zip(left[s], u))] or [s for s in range(6) if left[s][0] >= u[0]]
        best = max(open_, key=lambda s: (sum(a * b for a, b in zip(left[s], u)), -s)) if open_ else max(range(6), key=lambda s: (left[s][0], -s))
        assert got[i] == best
        left[best] = [a - b for a, b in zip(left[best], u)]
    sums = np.array([v[got == s].sum(0) for s in range(6)]) / share
    assert abs(sums - 1).max() < 0.01


def test_shards(spark, odd):
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(400)] + ["hot copy of a text"] * 300 + [None, "", None]
    df = docs_of(spark, texts)
    got = binpack.packed(df, shards=7).collect()
    assert len(got) == len(texts)
    sums, slots, homes = {}, {}, {}
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert max(sums.values()) <= 1.02 * min(sums.values()) and len(sums) == 7
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for t, x in homes.items() if t and not t.startswith("hot"))
    assert binpack.packed(odd).count() == odd.count()


def test_warc(spark):
    big, small = "<p>" + "x" * 200, "tiny"
    rows = [(5, "u", big), (2, "u\r\nv", big), (9, None, big), (1, "u", small), (3, "u", small), (4, "u", None), (6, "u", "é" * 60), (7, "u", "é" * 60), (2, "u\r\nv", big), (None, "u", big), (8, "u", "long " * 200000)]
    got = warc_zip.archived(spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, digest string")).collect()
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = min((q for q, _, x in rows if x == h and q is not None), default=None) if len(b) >= 100 else None
        revisit = first is not None and p != first
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_zip_reader_understands_other_writers():
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc", b"abc")
        z.writestr("x/y", b"defg")
        z.writestr("index", b"abc" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06" + bytes(18) + b" an end record's signature"
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"hij")
    d = warc_zip.ZipDirectory(held, len(held.getvalue()))
    for name, data in (("x/y", b"defg"), ("wide", b"hij")):
        at, n = d.open(name)
        assert d.read(at, n) == data == d.whole(name)
    assert d.whole("index") == b"abc" * 99
    with pytest.raises(ValueError):
        d.open("index")
    broken = held.getvalue().replace(b"defg", b"dexg")
    with pytest.raises(ValueError):
        warc_zip.ZipDirectory(io.BytesIO(broken), len(broken)).whole("x/y")
    line = warc_zip.record(1, "u", b"payload", "0", None, False)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:  # plain records
        z.writestr("archive/data.warc", line * 2)
        z.writestr(warc_zip.INDEX_MEMBER, "".join(f'1 {{"offset": {k * len(line)}, "length": {len(line)}}}\n' for k in range(2)), zipfile.ZIP_DEFLATED)
    assert [body for _, body in warc_zip.records(held, len(held.getvalue()))] == [b"payload"] * 2
    own = warc_zip.zip_bytes([("a", b"12"), ("b", b"")])
    with zipfile.ZipFile(io.BytesIO(own)) as z:
        assert z.read("a") == b"12" and z.testzip() is None


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [(1, "a/LICENSE", mit, True), (2, "a/b/c/x.py", "code. " + apache, False), (3, "a/b/c/y.py", "no word", False), (4, "a/b/LICENSE", apache, True), (5, "z/q.py", None, False), (6, "top.py", "", False), (7, None, "x", False), (8, "a/other.py", "The MIT of this is a very long sentence about quite another thing", False), (9, "a/b/LICENSE2", mit, True)]
    df = spark.createDataFrame(files, "id bigint, path string, text string, is_license_file boolean")
    got = {r["id"]: (r["license"], r["source"], r["inherited_from"]) for r in license_tfidf.licenses(df).collect()}
    assert got[1] == ("MIT", "header", None) and got[2] == ("Apache-2.0", "header", None)
    assert got[3] == ("Apache-2.0", "inherited", "a/b") and got[8] == ("MIT", "inherited", "a")
    assert got[5] == got[6] == got[7] == (None, "none", None) and len(got) == len(files)
    plan = license_tfidf.licenses(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def edit_distance_in(p, s):
    row = [0] * (len(s) + 1)
    for i, c in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(s, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def brute_items(items, text):
    """Least edits of each item of which a window occurs in the text, by whole edit-distance tables."""
    s = qgram_decon.normal((text or "").encode())
    want = {}
    for i, p in items:
        p = qgram_decon.normal((p or "").encode())
        if 0 < len(p) < qgram_decon.Q and b" " + p + b" " in b" " + s + b" ":
            want[i] = 0
        elif len(p) >= qgram_decon.Q:
            edits = [e for w in qgram_decon.windows(p) if (e := edit_distance_in(w, s)) <= qgram_decon.budget(len(w))]
            if edits:
                want[i] = min(edits)
    return want


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(qgram_decon, "BLOCK_BYTES", block)
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(15, 40))) for k in range(6)] + [(6, "short"), (7, None), (8, ""), (9, prose(rng, 130)), (10, "a" * 300)]
    texts = [prose(rng, 50) for _ in range(4)]
    for k in range(6):
        s = list(items[k][1])
        for _ in range(k * 2):
            at = rng.randrange(len(s))
            s[at : at + 1] = rng.choice([[], ["q"], [s[at], "z"]])
        texts.append(prose(rng, 9) + " " + "".join(s) + " " + prose(rng, 9))
    texts += [None, "", items[2][1].upper() + "!", "it is short indeed", "shorter", prose(rng, 5) + items[9][1][200:650] + prose(rng, 5), items[9][1][:100], "a" * 250, "a" * 700, "a" * 150 + "b" + "a" * 150]
    docs = docs_of(spark, texts).union(docs_of(spark, [texts[4], "another text"], [0, 0]))  # one id on several texts
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    want = [(i, sorted(found), min(found.values(), default=None)) for i, t in [*enumerate(texts), (0, texts[4]), (0, "another text")] for found in [brute_items(items, t)]]
    got = [(r["doc_id"], r["items"], r["least_edits"]) for r in qgram_decon.contaminations(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = qgram_decon.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, x, _ in want if not x)


def test_decontamination_of_repetitive_texts():
    """Long runs, against whole tables on small cases, and in bounded time and memory on large ones."""
    import time
    import tracemalloc

    rng = random.Random(4)
    for _ in range(60):
        items = [(k, "".join(rng.choices(rng.choice(["a", "ab", "abc"]), k=rng.randint(12, 60)))) for k in range(4)]
        text = "".join(rng.choices("ab", [9, 1], k=rng.randint(20, 200)))
        assert qgram_decon.Index([(i, t.encode()) for i, t in items]).matches(text.encode()) == brute_items(items, text)
    tracemalloc.start()
    for item, found in ((b"a" * 2000, {1: 0}), (b"a" * 120 + b"b" + b"a" * 135, {1: 1}), (b"a" * 100 + b"bc" * 50, {})):
        began = time.time()
        assert qgram_decon.Index([(1, item)]).matches(b"a" * 1_000_000) == found
        assert time.time() - began < 30
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def labelled(spark):
    rng = random.Random(10)
    rows, marks = [], []
    tongues = {"aa": "ba bo bi lo la".split(), "bb": "sch tz ung ich".split(), "cc": "eau oux ien que".split()}
    for i in range(600):
        lang = rng.choice(list(tongues))
        words = ["".join(rng.choices(tongues[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 40))]
        toxic = rng.random() < 0.2
        if toxic:
            words += rng.choices(["vilest", "wretch", "scoundrel"], k=3)
        rows.append((i, " ".join(words), lang, "s", 0, 0.5, 1, "c"))
        marks.append((i, 0, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_language_and_toxicity(spark, odd):
    docs, labels = labelled(spark)
    model = lang_ecoc.fit(docs, lang_ecoc.F.col("doc_id") < 400)
    got = {r["doc_id"]: r for r in lang_ecoc.predict(docs, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in range(400, 600)]) > 0.97
    none = {r["doc_id"]: r for r in lang_ecoc.predict(odd, model).collect()}
    assert [none[i]["lang_pred"] for i in (3, 4, 5, 7, 8)] == ["und"] * 5 and all(0 <= r["score"] <= 1 for r in none.values())
    assert lang_ecoc.identified(odd, model).columns == odd.columns

    tox = weak_toxicity.fit(docs, labels, weak_toxicity.F.col("doc_id") < 400)
    said = {r["doc_id"]: r for r in weak_toxicity.score(docs, tox).collect()}
    mark = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert np.mean([said[i]["predicted"] == mark[i] for i in range(400, 600)]) > 0.97
    assert weak_toxicity.score(odd, tox).where("score is null or score < 0 or score > 1").count() == 0
    blank = weak_toxicity.fit(docs, labels.where("toxic = 9"))
    assert weak_toxicity.score(docs, blank).where("predicted = 1").count() == 0


def test_codewords():
    for n in (*range(1, 20), 60):
        code = lang_ecoc.codewords(n)
        assert len({tuple(x) for x in code.tolist()}) == n
        if n > 6:
            apart = [(x != y).sum() for i, x in enumerate(code) for y in code[:i]]
            assert min(apart) >= code.shape[1] // 4


def test_codes_against_plain_loops():
    """Margins and loss-weighted decoding, n-gram by n-gram and bit by bit; long texts in segments, several in a chunk."""
    rng = random.Random(13)
    tongues = {"aa": "ba bo bi lo la".split(), "bb": "sch tz ung ich".split(), "cc": "eau oux ien que".split()}
    say = lambda k, n: " ".join("".join(rng.choices(tongues[k], k=3)) for _ in range(n)).encode()
    model = lang_ecoc.Model(sorted(tongues), [lang_ecoc.gram_counts([say(k, 200) for _ in range(20)]) for k in sorted(tongues)])
    texts = [say("aa", 3), say("bb", 30), b"", "Éa ü".encode(), say("aa", 20) + say("cc", 20), b"x", None, say("cc", 90_000)]
    assert len(texts[-1]) > 2 * lang_ecoc._SEGMENT
    margins, (lang, score, close, loss) = model.margins(texts), model.predict(texts)
    for i, t in enumerate(texts):
        s = b"  " + (t or b"").translate(lang_ecoc._FOLD) + b"  "
        total, n = np.zeros(model.code.shape[1]), 0
        for j in range(len(s) - 2):
            if s[j : j + 2] != b"  ":
                two = s[j] | s[j + 1] << 8
                three = (two * 0x9E3779B1 + s[j + 2] * 0x85EBCA6B) % 2**32 >> 16
                total += model.weights[0][two].astype(float) + model.weights[1][three]
                n += 1
        want = total / max(n, 1) / 2
        assert np.allclose(margins[i], want, atol=2e-3)
        losses = [sum(w * np.log1p(np.exp(-c * m * model.scale)) for w, c, m in zip(model.bit_weights, code, margins[i])) for code in model.code]
        best = int(np.argmin(losses))
        shares = np.exp(-4 * (np.array(losses) - losses[best]))
        assert near(loss[i], losses[best], 1e-6)
        if lang_ecoc.has_letter(t):
            assert lang[i] == model.langs[best] and near(score[i], 1 / shares.sum(), 1e-5)
        else:
            assert (lang[i], score[i], close[i]) == ("und", 0, True)


def test_identified(spark):
    """Learned languages stay, noise, foreign scripts and texts without letters go."""
    docs, _ = labelled(spark)
    model = lang_ecoc.fit(docs)
    rng = random.Random(14)
    noise = ["".join(rng.choices("wxyvjk qz", k=400)), "日本語の文章です。" * 9, "12 + 3", None, ""]
    kept = lang_ecoc.identified(docs.union(docs_of(spark, noise, range(1000, 1005))), model)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & set(range(1000, 1005)) and len(ids) > 0.99 * 600


def test_label_model():
    """Planted accuracies and copies: rates and correlations are found, and posteriors beat the annotator and the voters taken as independent."""
    rng = np.random.default_rng(6)
    n = 6000
    y = rng.random(n) < 0.2
    rates = [(0.7, 0.05), (0.6, 0.03), (0.65, 0.08), (0.5, 0.02), (0.55, 0.06)]
    fires = [np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in rates]
    noisy = np.where(y, rng.random(n) < 0.5, rng.random(n) < 0.25)  # a poor voter and its near copies
    copies = [np.where(rng.random(n) < 0.05, rng.random(n) < 0.3, noisy) for _ in range(5)]
    annotator = np.where(y, rng.random(n) < 0.85, rng.random(n) < 0.06)
    v = np.where(np.stack([*fires, *copies, annotator], 1), 1, -1)
    v[rng.random(v.shape) < 0.1] = 0  # abstentions
    q, one, zero, correlations, prior = weak_toxicity.label_model(v)
    assert near(prior, 0.2, 0.04)
    for k, (a, b) in [*enumerate(rates), (10, (0.85, 0.06))]:
        assert near(one[k], a, 0.08) and near(zero[k], b, 0.03)
    assert correlations[5:10, 5:10].min() > 0.75 and max(correlations[i, j] for i in range(5) for j in range(11) if i != j) < 0.15
    right = ((q > 0.5) == y).mean()
    odds = np.log(0.25) + np.where(v > 0, np.log(one / zero), np.where(v < 0, np.log((1 - one) / (1 - zero)), 0)).sum(1)
    assert right > (annotator == y).mean() + 0.02 and right > ((odds > 0) == y).mean() and right > 0.95
    assert ((q > 0.5) != annotator).mean() > 0.05  # not the raw labels


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for made in (
        prefix_join.jaccard_components(docs), binpack.packed(docs), scaled_sketch.fingerprints(docs), wavelet.read_shards(wavelet.write_shards(docs, WORD_BPE)), warc_zip.archived(pages),
        bpe_transducer.encoded(docs, BYTE_BPE), qgram_decon.contaminations(docs, bench), lang_ecoc.predict(docs, lang_ecoc.fit(docs)), weak_toxicity.score(docs, weak_toxicity.fit(docs, labels)),
        license_tfidf.licenses(docs.selectExpr("doc_id as id", "source as path", "text", "true as is_license_file")),
    ):
        assert made.count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "some words in this text here"), (None, None), (4, "some words in this text here"), (2, "")], "doc_id bigint, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in prefix_join.jaccard_components(docs).collect()), key=str) == sorted([(None, 4), (None, None), (4, 4), (2, 2)], key=str)
    assert scaled_sketch.fingerprints(docs).count() == binpack.packed(docs).count() == 4
    assert wavelet.read_shards(wavelet.write_shards(docs, WORD_BPE)).where("doc_id is null").count() == 2


def test_stages_on_odd_rows(spark, tmp_path):
    """Every stage on nulls, empty and long texts, ties, repeated rows and clashing extra columns, and on no rows."""
    docs, labels = labelled(spark)
    rows = docs.limit(200).union(docs_of(spark, odd_texts(), range(700, 700 + len(odd_texts())))).union(docs_of(spark, [None, "", "few words"], [None, None, None]))
    rows = rows.union(rows.where("doc_id in (3, 708)"))
    for c in ("cid", "key", "shingles", "part", "gid", "i", "k", "items", "least_edits", "toxic", "_id"):
        rows = rows.withColumn(c, F.lit("mine"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench = spark.createDataFrame([(1, docs.where("doc_id = 9").first()["text"], "mine"), (None, None, None), (2, "", "")], "item_id bigint, text string, doc_id string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns, name
        assert out.exceptAll(rows).count() == 0 and out.where("key = 'mine'").count() == out.count() > 50, name
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
    assert last.count() == rows.count() and corpus_pipeline.STAGES[-1][1](spark, rows.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        out = stage(spark, out, d)
        assert out.columns == docs.columns and out.join(before, "doc_id", "left_anti").count() == 0
    final = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in final.collect()} == {r["doc_id"] for r in out.collect()}
    assert set(QUERIES) and all(n.startswith("op") for n in QUERIES)
