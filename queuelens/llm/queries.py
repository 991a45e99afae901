"""Registered queries of this subpackage and their SQL counterparts."""

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import collocations, exact_dedup, hashing_search, html_text, licenses, lm_scoring, ngram_join, packing, pii, prefix_trie, quality, sentencepieces, toxicity
from queuelens.llm.common import documents, table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; ``TOKENIZER_DIR`` overrides the installed ones."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.with_spans(docs, pii.train(docs)).drop("text")

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(joined("pii.base"), 256).alias("base_sha256"), joined("pii.spans").alias("spans")
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.with_quality(docs, quality.train(docs)).select("doc_id", "quality.weak_label", "quality.score")
    return scored.withColumn("good", (F.col("score") >= 0.5).cast("int"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.scan(docs, licenses.train(docs))


def op4_hashing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hashing_search.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages.select("page_id", "url", "html"), html_text.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold() == 0, F.lit(False)).alias("held_out")
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    coded = sentencepieces.encode(documents(spark, sf_dir).select("doc_id", "text"), model).drop("text")
    coded = sentencepieces.decode(coded, model)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    scored = lm_scoring.score(documents(spark, sf_dir), F.coalesce(fold != 2, F.lit(True)))
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    taken = F.crc32(conv.cast("string")) % 4
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), conv - conv % 20, taken, 3)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


OP8_SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM keyed WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM ranked
"""

#: The checksum is spelt out bit by bit: its polynomial, reflected, is 3988292384.
OP12_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))
    ), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM own)
), parts AS (
  SELECT v.c, 0 AS part, o.rn, o.role, o.text FROM convs v JOIN own o ON o.c = v.c - v.c % 20 AND o.rn <= v.h
  UNION ALL
  SELECT o.c, 1, o.rn, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.rn > v.h
), turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, rn) AS d, md5(md5(role) || md5(text)) AS t,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM parts
), members AS (
  SELECT c, 0 AS d, '' AS p, 0 AS words FROM convs
  UNION ALL
  SELECT c, d, string_agg(t, '') OVER (PARTITION BY c ORDER BY d), words FROM turns
), nodes AS (
  SELECT p, m.d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (m.d = l.d), '') AS ends
  FROM members m JOIN (SELECT c, max(d) AS d FROM members GROUP BY c) l USING (c)
  GROUP BY p, m.d
), kids AS (
  SELECT left(p, 32 * (d - 1)) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), below AS (
  SELECT left(b.p, 32 * k) AS p, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM nodes) b LEFT JOIN kids ON kids.p = b.p
  GROUP BY 1
)
SELECT a.conv_id, a.d::BIGINT AS depth, u.conv_id AS parent_conv_id, a.n_convs, coalesce(kids.n, 0) AS n_children,
       below.n_leaves, below.saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a JOIN below ON below.p = a.p LEFT JOIN kids ON kids.p = a.p
LEFT JOIN nodes u ON a.d > 0 AND u.p = left(a.p, 32 * (a.d - 1))
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), runs AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spoken AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM runs CROSS JOIN (VALUES (1), (2), (3)) AS sizes(size)
  WHERE len(w) >= size
), counts AS (
  SELECT lang, size, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT lang, size, phrase, a, k,
         array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS rest
  FROM counts CROSS JOIN (VALUES (1), (2)) AS ks(k)
  WHERE size > k
), scored AS (
  SELECT c.*, h.a AS l, t.a AS r, ((1000000::HUGEINT * c.a * c.a) // (h.a::HUGEINT * t.a))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.rest
), chosen AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), alone AS (
  SELECT * FROM chosen c
  WHERE NOT EXISTS (
    SELECT 1 FROM counts b
    WHERE b.size = 3 AND c.size = 2 AND b.lang = c.lang AND 100 * b.a >= 50 * c.a
      AND c.phrase IN (array_to_string(string_split(b.phrase, ' ')[1:2], ' '), array_to_string(string_split(b.phrase, ' ')[2:3], ' ')))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM alone JOIN spoken USING (lang)
QUALIFY rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_hashing_search": op4_hashing_search,
    "op5_html_text": op5_html_text,
    "op6_ngram_join": op6_ngram_join,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_sentencepieces": op10_sentencepieces,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {"op8_exact_dedup": OP8_SQL, "op12_prefix_trie": OP12_SQL, "op13_collocations": OP13_SQL}
