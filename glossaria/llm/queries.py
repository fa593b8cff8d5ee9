"""One query per operator, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm import bpe, chat, counts, fim, knn, langid, linededup, media, mixing, neardup, repair, substrings, suffixes


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th vector by id against all others: the 20 largest inner products."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return knn.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    return bpe.digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents that aren't held out."""
    return langid.identify(_docs(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer after six commits: words, tokens of a byte-level BPE, words sent again, toxic documents taken away,
    those of low quality counted anew by their letters' words (sent twice)."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", "lang", "text")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"), F.max(F.coalesce(F.col("quality") == 0, F.lit(False))).alias("low"))
    bpe_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = counts.Counted(spark)
    kept.add("words", counts.counted(docs, counts.WORDS))
    kept.add("bpe", counts.counted(docs, "byte-bpe-50k", bpe_path))
    kept.rollup.compact()
    kept.add("words", counts.counted(docs, counts.WORDS))
    kept.remove("toxic", marks.where("toxic").select("doc_id"))
    low = docs.join(marks.where("low AND NOT toxic").select(F.col("doc_id").alias("its_id")), F.col("doc_id") == F.col("its_id"), "left_semi")
    anew = counts.counted(low.withColumn("text", F.regexp_replace("text", "[^A-Za-z]+", " ")), counts.WORDS)
    kept.revise("low", anew)
    kept.revise("low", anew)
    return kept.totals()


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops the lines of every text that five documents or more hold."""
    out = linededup.drop_repeated(_docs(spark, sf_dir), least=40, copies=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their four-word shingles."""
    return neardup.near_duplicates(_docs(spark, sf_dir), size=4, threshold=0.8)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a picture in tar shards and reads it back."""
    return media.read_back(media.headers(media.store(_docs(spark, sf_dir))))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.taken(_docs(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes words of 13-word windows that a smaller document has."""
    return substrings.digests(_docs(spark, sf_dir), window=13)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes bytes of 400-byte strings that occur elsewhere."""
    return suffixes.digests(_docs(spark, sf_dir), length=400)


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut for filling in its middle, and put together again."""
    return fim.digests(_docs(spark, sf_dir), seed=42)


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that speaks in marks, as a stream of turns and one example a reply."""
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(_conversations(spark, sf_dir).unionByName(more))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and then repaired by the cheapest edits."""
    return repair.digests(_conversations(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_knn, op2_bpe, op3_language_id, op4_token_counts, op5_line_dedup, op6_near_dedup, op7_media, op8_mixing, op9_substring_dedup, op10_suffix_dedup, op11_fim, op12_chat, op13_repair)}

ORACLE_SQL = {
    "op11_fim": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     r AS (SELECT *, len(u) AS n, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS x FROM d),
     c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
     p AS (SELECT *, array_to_string(u[1 : a], '') AS pre, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 : n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok')) t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), chr(10), '%0A')) + length(regexp_replace(text, '(</?)(\\*turn)', '\1\\\2', 'g')) + 17) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op1_knn": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
           FROM v q, v d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20""",
    "op6_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[p : p + 3], ' ') END AS sh
           FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS p FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
     l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
     r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
     c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
     f AS (SELECT doc_id, p, doc_id > min(doc_id) OVER (PARTITION BY key) AS goes FROM s),
     g AS (SELECT DISTINCT doc_id, p + i AS n FROM (SELECT doc_id, p, unnest(range(13)) AS i FROM f WHERE goes)),
     k AS (SELECT d.doc_id, len(d.w) AS n_words, d.w, coalesce(x.gone, []) AS gone FROM d LEFT JOIN (SELECT doc_id, list(n) AS gone FROM g GROUP BY doc_id) x USING (doc_id)),
     u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS n FROM d)
SELECT k.doc_id, CAST(k.n_words AS BIGINT) AS n_words, CAST(len(k.gone) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM k LEFT JOIN (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.n) AS kept FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.n = g.n GROUP BY u.doc_id) t USING (doc_id)""",
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
     k AS (SELECT doc_id, n, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     d AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS goes FROM k LEFT JOIN r USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (goes) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT goes), '')) AS kept_sha256
FROM d GROUP BY doc_id""",
}
