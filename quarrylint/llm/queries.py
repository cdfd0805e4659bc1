"""One query per operator, over the whole of its table, and its SQL answer where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylint.llm import (
    chat_collapse, exact_dedup, katz, line_dedup, mixing, near_dedup, packing, phrases, robust_outliers, spelling,
    suffix_dedup, toxicity, vector_tree,
)
from quarrylint.llm.base import ORACLE, QUERIES, documents, query

__all__ = ["ORACLE", "QUERIES"]


@query("op1_robust_outliers")
def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.quality(documents(spark, sf_dir))


@query(
    "op2_line_dedup",
    r"""
    WITH rows AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents
    ), keyed AS (
        SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM rows
    ), shared AS (
        SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10
        GROUP BY key HAVING count(DISTINCT doc_id) >= 2
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE holder <> doc_id) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                           FILTER (WHERE holder IS NULL OR holder = doc_id), '')) AS kept_sha256
    FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id
    """,
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_toxic_segments")
def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.scored(docs)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("segments").alias("n_segments"),
    )


@query(
    "op5_suffix_dedup",
    r"""
    WITH texts AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes, strlen(coalesce(text, '')) AS n_bytes FROM documents
    ), strings AS (
        SELECT doc_id, start, md5(substr(bytes, 2 * start + 1, 200)) AS string
        FROM (SELECT doc_id, bytes, unnest(range(n_bytes - 99)) AS start FROM texts)
    ), later AS (
        SELECT doc_id, start FROM strings
        QUALIFY row_number() OVER (PARTITION BY string ORDER BY doc_id, start) > 1
    ), opened AS (
        SELECT doc_id, start, start > coalesce(lag(start) OVER places + 100, -1) AS opens
        FROM later WINDOW places AS (PARTITION BY doc_id ORDER BY start)
    ), spans AS (
        SELECT doc_id, min(start) AS start, max(start) + 100 AS stop
        FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM opened) GROUP BY doc_id, span
    ), gaps AS (
        SELECT doc_id, stop AS low, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS high FROM spans
        UNION ALL SELECT doc_id, 0, min(start) FROM spans GROUP BY doc_id
    ), kept AS (
        SELECT doc_id, string_agg(substr(bytes, 2 * low + 1, 2 * (coalesce(high, n_bytes) - low)), '' ORDER BY low) AS bytes
        FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
    ), counts AS (
        SELECT doc_id, count(*) AS n_spans, sum(stop - start)::BIGINT AS n_removed FROM spans GROUP BY doc_id
    )
    SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept.bytes, texts.bytes))) AS kept_sha256
    FROM texts LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op6_exact_dedup",
    r"""
    WITH texts AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, text_sha256
    FROM texts WINDOW same AS (PARTITION BY text_sha256)
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.deduplicate(documents(spark, sf_dir)).rows
    return rows.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


@query(
    "op7_chat_collapse",
    r"""
    WITH told AS (
        SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT conv_id, count(*) AS n_turns,
               list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS turns,
               string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS chat
        FROM told GROUP BY conv_id
    ), proper AS (
        SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM convs)
    ), whole AS (
        SELECT turns, min(conv_id) AS conv_id, count(*) AS copies, any_value(n_turns) AS n_turns,
               any_value(chat) AS chat
        FROM convs GROUP BY turns
    )
    SELECT conv_id, n_turns, copies, chat FROM whole ANTI JOIN proper USING (turns)
    """,
)
def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op8_katz_scores")
def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    scored = katz.katz_scores(documents(spark, sf_dir), ~held_out)
    return scored.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op9_temperature_mixing")
def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select(
        "doc.doc_id", "doc.source", "tokens", "block", "epoch", F.round("weight", 6).alias("weight"),
        F.round("at", 6).alias("at"),
    )


@query(
    "op10_near_dedup",
    r"""
    WITH RECURSIVE worded AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                    'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS words
        FROM documents
    ), shingled AS (
        SELECT DISTINCT doc_id, array_to_string(words[place : place + 4], ' ') AS shingle
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS place FROM worded WHERE len(words) > 0)
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
    ), met AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
        FROM shingled a JOIN shingled b USING (shingle) GROUP BY ALL
    ), links AS (
        SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * shared >= 75 * (x.n + y.n - shared)
    ), reached AS (
        SELECT a, b FROM links
        UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
    )
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_, d.doc_id) AS component_id,
           coalesce(least_, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id)
    LEFT JOIN (SELECT a AS doc_id, min(b) AS least_ FROM reached GROUP BY a) USING (doc_id)
    """,
)
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query(
    "op11_spelling_variants",
    r"""
    WITH RECURSIVE crc_table AS (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, step:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256))::BIGINT AS i)
    ), runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[a-zÀ-ÿ]+')) AS run
        FROM documents
    ), counted AS (
        SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM runs GROUP BY id, run
    ), behind AS (  -- what a byte adds to the crc with so many bytes after it
        SELECT 0 AS after, i AS byte, v FROM crc_table
        UNION ALL SELECT after + 1, byte, xor(b.v >> 8, c.v) FROM behind b JOIN crc_table c ON c.i = b.v & 255
        WHERE after < (SELECT max(strlen(bytes)) // 2 FROM counted)
    ), starts AS (
        SELECT 0 AS size, 4294967295::BIGINT AS v
        UNION ALL SELECT size + 1, xor(s.v >> 8, c.v) FROM starts s JOIN crc_table c ON c.i = s.v & 255
        WHERE size < (SELECT max(strlen(bytes)) // 2 FROM counted)
    ), bytes AS (
        SELECT id, run, strlen(bytes) // 2 - 1 - k AS after, ('0x' || substr(bytes, 2 * k + 1, 2))::BIGINT AS byte
        FROM (SELECT id, run, bytes, unnest(range(strlen(bytes) // 2)) AS k FROM counted)
    ), mixed AS (
        SELECT id, run, bit_xor(v) AS v FROM bytes JOIN behind USING (after, byte) GROUP BY id, run
    ), hashed AS (
        SELECT run, n, xor(xor(mixed.v, starts.v), 4294967295) AS h
        FROM counted JOIN mixed USING (id, run) JOIN starts ON starts.size = strlen(bytes) // 2
    ), words AS (
        SELECT word, sum(m)::BIGINT AS n
        FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                     ELSE run END AS word, n AS m FROM hashed)
        WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3
    ), shorter AS (
        SELECT word, n, length(word) AS size, k, substr(word, 1, k) || substr(word, k + 2) AS rest
        FROM (SELECT *, unnest(range(length(word))) AS k FROM words)
    ), met AS (
        SELECT a.word, a.n, b.word AS near, b.n AS near_n
        FROM shorter a JOIN shorter b ON a.size = b.size AND a.k = b.k AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
    ), best AS (
        SELECT word, n, count(*) AS n_near, max(near_n) AS most,
               arg_min(near, struct_pack(less := -near_n, near := near)) AS near
        FROM met GROUP BY word, n
    ), formed AS (
        SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * words.n THEN near END AS form,
               CASE WHEN most >= 2 * words.n THEN most END AS form_n
        FROM words LEFT JOIN best USING (word)
    ), steps AS (
        SELECT word, form AS ending FROM formed WHERE form IS NOT NULL
        UNION SELECT steps.word, formed.form FROM steps JOIN formed ON steps.ending = formed.word WHERE formed.form IS NOT NULL
    ), ends AS (
        SELECT steps.word, steps.ending FROM steps JOIN formed ON steps.ending = formed.word WHERE formed.form IS NULL
    )
    SELECT formed.word, form, coalesce(ends.ending, formed.word) AS root, n, n_near, form_n
    FROM formed LEFT JOIN ends USING (word)
    """,
)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir), mutate_every=97))


@query(
    "op12_phrase_mining",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?
-
]')) AS piece
        FROM documents
    ), worded AS (
        SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM pieces
    ), found AS (
        SELECT lang, size, words[place : place + size - 1] AS words
        FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS place
              FROM (SELECT lang, words, unnest(range(1, 6)) AS size FROM worded))
    ), counts AS (
        SELECT lang, size, words, count(*)::HUGEINT AS f FROM found GROUP BY ALL HAVING count(*) >= 100
    ), totals AS (
        SELECT lang, sum(len(words))::HUGEINT AS n FROM worded GROUP BY lang
    ), cuts AS (
        SELECT c.lang, c.words, c.f AS a, k, l.f AS l, r.f AS r, n, 1000 * c.f * n // (l.f * r.f) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c
        JOIN counts l ON l.lang = c.lang AND l.words = c.words[1 : k]
        JOIN counts r ON r.lang = c.lang AND r.words = c.words[k + 1 : c.size]
        JOIN totals t ON t.lang = c.lang
    ), lowest AS (
        SELECT lang, words, a, n, unnest(arg_min(struct_pack(l, r, score), struct_pack(score, k))) FROM cuts
        GROUP BY lang, words, a, n
    ), held AS (
        SELECT lang, words[from_ : from_ + len_ - 1] AS words, max(f) AS longer
        FROM (SELECT lang, size, words, f, len_, unnest(range(1, size - len_ + 2)) AS from_
              FROM (SELECT *, unnest(range(2, size)) AS len_ FROM counts WHERE size > 2))
        GROUP BY ALL
    ), ranked AS (
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank,
               array_to_string(words, ' ') AS phrase, a, l, r, n, score
        FROM lowest LEFT JOIN held USING (lang, words) WHERE longer IS NULL OR 100 * longer < 100 * a
    )
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM ranked WHERE rank <= 2000
    """,
)
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(documents(spark, sf_dir))


@query("op13_vector_tree")
def op13_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
