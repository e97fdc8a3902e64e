"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

import os

from pyspark.sql import functions as F

from . import (chat, exact_dedup, fair_mix, ngram_join, packing, pii, reshard, rp_forest, search, sentencepiece_viterbi,
               toxicity, warc, whitening)
from .common import table


def op1_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(table(spark, d, "documents"))


def op2_sentencepiece(spark, d, model_file=None):
    model_file = model_file or os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
    return sentencepiece_viterbi.encode_digest(table(spark, d, "documents"), model_file)


def op3_chat_format(spark, d):
    return chat.chat_format(table(spark, d, "conversations"))


def op4_warc(spark, d):
    back = warc.round_trip(spark, table(spark, d, "pages"))
    # the record of a page without id names none
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       number("refers_to").alias("refers_to"))


def op5_toxicity(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op6_reshard(spark, d):
    # today's shards follow the source, so the hot source fills one of them
    docs = table(spark, d, "documents")
    placed = reshard.reshard(docs, F.pmod(F.xxhash64("source"), F.lit(12)), 12, [1.0] * 16)
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
                         F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_embedding_forest(spark, d):
    return rp_forest.near_vectors(table(spark, d, "embeddings"))


def op8_best_fit(spark, d):
    return packing.best_fit_pack(packing.items_of(table(spark, d, "documents"))).withColumnRenamed("id", "doc_id")


def op9_pii(spark, d):
    return pii.find_pii(table(spark, d, "documents"))


def op10_ngram_join(spark, d):
    return ngram_join.ngram_classes(table(spark, d, "documents"))


def op11_whitening(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))


def op12_ranked_search(spark, d):
    return search.ranked_search(search.build_index(table(spark, d, "documents")), table(spark, d, "benchmark"))


def op13_fair_mix(spark, d):
    return fair_mix.fair_mix(table(spark, d, "documents")).documents.withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_sentencepiece, op3_chat_format, op4_warc, op5_toxicity, op6_reshard, op7_embedding_forest,
        op8_best_fit, op9_pii, op10_ngram_join, op11_whitening, op12_ranked_search, op13_fair_mix)}


ORACLE = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op3_chat_format": """
        WITH c AS (
            SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn, role, text) AS said
            FROM conversations GROUP BY conv_id),
        u AS (SELECT min(conv_id) AS conv_id, n, said, count(*) AS copies FROM c GROUP BY n, said),
        m AS (SELECT * FROM u WHERE NOT EXISTS (
            SELECT 1 FROM c WHERE c.n > u.n AND c.said[1:u.n] = u.said))
        SELECT conv_id, n AS n_turns, copies, CAST(0 AS BIGINT) AS segment, array_to_string(list_transform(said, lambda x:
            '<|im_start|>' || coalesce(x.r, 'user') || chr(10) || coalesce(x.t, '') || '<|im_end|>' || chr(10)), '') AS text
        FROM m""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        b AS (SELECT page_id, strlen(h) AS payload_bytes, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits,
                     min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT)
                     + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
                     + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT)
                     + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT)
                     + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b""",
    "op7_embedding_forest": """
        WITH RECURSIVE e AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
        r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)""",
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
        FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n""",
    "op12_ranked_search": r"""
        WITH t AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        c AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS words FROM t WHERE len(ws) > 0),
        m AS (SELECT doc_id, ws, 50 + (50 * len(ws) * docs) // words AS m FROM t, c WHERE len(ws) > 0),
        p AS (SELECT doc_id, w, any_value(m) AS m, count(*) AS tf FROM (SELECT doc_id, m, unnest(ws) AS w FROM m) GROUP BY doc_id, w),
        f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
        g AS (SELECT w, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM f, c),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
              FROM q JOIN p USING (w) JOIN g USING (w) GROUP BY item_id, doc_id),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
              FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_fair_mix": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, source, md5(concat_ws(':', doc_id, text)) AS h,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
              FROM d GROUP BY source),
        w AS (SELECT *, 2 * source_size AS most, [3, 1, 2][1 + rank % 3] AS weight FROM s),
        f AS (SELECT *, CAST(most AS DOUBLE) / weight AS fills FROM w),
        v AS (SELECT a.fills, (1.5 * (SELECT sum(source_size) FROM w)
                     - coalesce((SELECT sum(b.most) FROM f b WHERE b.fills < a.fills), 0))::DOUBLE
                     / (SELECT sum(b.weight) FROM f b WHERE b.fills >= a.fills) AS level FROM f a),
        t AS (SELECT f.*, least(CAST(most AS DOUBLE), weight * (SELECT arg_min(level, fills) FROM v WHERE level <= fills)) AS target FROM f),
        o AS (SELECT d.r, d.doc_id, d.size, t.rank, t.source_size, t.target,
                     sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.h, d.r ROWS UNBOUNDED PRECEDING) - d.size AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT *, unnest(range(0, size, 256)) AS start FROM (SELECT *, unnest([0, 1]) AS turn FROM o)),
        q AS (SELECT r, rank, least(256, size - start) AS words, turn * source_size + before + least(size, start + 256) AS upto, target FROM p),
        z AS (SELECT r, words, sum(words) OVER (ORDER BY CAST(upto AS DOUBLE) / target, rank, upto ROWS UNBOUNDED PRECEDING) AS total FROM q),
        k AS (SELECT r, sum(words) AS taken FROM z WHERE total <= 1.5 * (SELECT sum(source_size) FROM w) GROUP BY r)
        SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM o LEFT JOIN k USING (r)""",
}


def oracle_sql() -> dict:
    return dict(ORACLE)
