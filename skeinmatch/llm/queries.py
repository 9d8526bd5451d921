"""The queries that apply each operator to its whole table, with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpack, bpe_transducer, lang_ecoc, license_tfidf, prefix_join, qgram_decon, scaled_sketch, warc_zip, wavelet, weak_toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, k: int):
    """Rows whose crc32 of the id as text leaves remainder k; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(0)) == k


def op1_language_ecoc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = lang_ecoc.fit(docs, ~fold(3, 1))
    return lang_ecoc.predict(docs, model).select("doc_id", fold(3, 1).alias("held_out"), "lang_pred", "score", "ambiguous", "loss")


def op2_vector_shards(spark, sf_dir):
    return binpack.packed(table(spark, sf_dir, "documents"))


def op3_scaled_fingerprints(spark, sf_dir):
    return scaled_sketch.fingerprints(table(spark, sf_dir, "documents"))


def op4_wavelet_tokens(spark, sf_dir):
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents"), WORD_BPE))


def op5_zip_warc(spark, sf_dir):
    return warc_zip.archived(table(spark, sf_dir, "pages"))


def op6_license_scan(spark, sf_dir):
    """Documents as files of a tree: source/thousand/hundred/id.txt, but by a hash of the id a tenth are named LICENSE-id.txt in each
    of the two directories above. These are licence files and speak for their directory, the smallest id first; what others state is their own header."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    level = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    thousand, hundred = (F.floor(F.col("doc_id") / k).cast("string") for k in (1000, 100))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.when(level > 0, thousand), F.when(level > 1, hundred), F.concat(F.when(level > 1, "").otherwise("LICENSE-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text", (level <= 1).alias("is_license_file"))
    return license_tfidf.licenses(files).withColumnRenamed("id", "doc_id")


def op7_bpe_codec(spark, sf_dir):
    return bpe_transducer.encoded(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_jaccard_join(spark, sf_dir):
    return prefix_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark, sf_dir):
    return qgram_decon.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = weak_toxicity.fit(docs, table(spark, sf_dir, "labels"), ~fold(4, 2))
    return weak_toxicity.score(docs, model).select("doc_id", fold(4, 2).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_language_ecoc, op2_vector_shards, op3_scaled_fingerprints, op4_wavelet_tokens, op5_zip_warc, op6_license_scan, op7_bpe_codec, op8_jaccard_join, op9_decontaminate, op10_toxicity)}

def license_sql() -> str:
    """The licence scan over all sentences, without the test for candidates; crc32 is folded from its polynomial."""
    rows, idf, other, _ = license_tfidf.template_weights()
    weights = ", ".join(f"('{k}', '{w}', {x:.17e})" for k, w, x in rows)
    idfs = ", ".join(f"('{w}', {x:.17e})" for w, x in idf.items())
    return rf"""
        WITH weights(license, term, weight) AS (VALUES {weights}), idf(term, idf) AS (VALUES {idfs}),
        crc AS (
            SELECT *, xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT), 4294967295::BIGINT) % 10 AS level
            FROM documents),
        files AS (
            SELECT doc_id, text, concat_ws('/', coalesce(source, 'unknown'), CASE WHEN level > 0 THEN doc_id // 1000 END, CASE WHEN level > 1 THEN doc_id // 100 END, CASE WHEN level > 1 THEN '' ELSE 'LICENSE-' END || doc_id || '.txt') AS path, level <= 1 AS is_license_file FROM crc),
        sentences AS (
            SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '([.!?])[ 	

]+', '' || chr(10), 'g'), chr(10))) AS sentence FROM files),
        numbered AS (SELECT doc_id, sentence, row_number() OVER () AS place FROM sentences),
        words AS (SELECT doc_id, place, unnest(regexp_extract_all(sentence, '{license_tfidf._TERM}')) AS term FROM numbered),
        tf AS (SELECT doc_id, place, term, n * coalesce(idf, {other:.17e}) AS w FROM (SELECT doc_id, place, term, count(*) AS n FROM words GROUP BY ALL) LEFT JOIN idf USING (term)),
        norms AS (SELECT doc_id, place, sqrt(sum(w * w)) AS norm FROM tf GROUP BY ALL),
        dots AS (SELECT doc_id, place, license, sum(w * weight) AS dot FROM tf JOIN weights USING (term) GROUP BY ALL),
        scored AS (SELECT doc_id, license, max(round(dot / norm, 6)) AS cosine FROM dots JOIN norms USING (doc_id, place) GROUP BY ALL HAVING max(round(dot / norm, 6)) >= {license_tfidf.THRESHOLD}),
        own AS (SELECT doc_id, license, cosine FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
        named AS (SELECT f.doc_id, path, is_license_file, license, cosine, regexp_replace(path, '(^|/)[^/]*$', '') AS dir FROM files f LEFT JOIN own USING (doc_id)),
        stated AS (SELECT dir AS above, min_by(license, doc_id) AS given FROM named WHERE license IS NOT NULL AND is_license_file GROUP BY 1),
        dirs AS (SELECT DISTINCT dir, string_split(dir, '/') AS parts FROM named),
        over AS (SELECT dir, depth, array_to_string(parts[1:depth], '/') AS above FROM (SELECT dir, parts, unnest(range(0, len(parts) + 1)) AS depth FROM dirs)),
        near AS (SELECT dir, above, given FROM over JOIN stated USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
        SELECT doc_id, path, coalesce(license, given) AS license, cosine, CASE WHEN license IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS source,
               CASE WHEN license IS NULL THEN above END AS inherited_from
        FROM named LEFT JOIN near USING (dir)"""


ORACLE_SQL = {
    "op6_license_scan": license_sql(),
    "op5_zip_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
             f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
        FROM d LEFT JOIN f ON d.payload_bytes >= 100 AND d.payload_digest = f.payload_digest""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, sh FROM (
                SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        links AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2)
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id""",
}
