"""The registered queries of the corpus operators and their SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.llm import (
    decontam, langid, lexical, lm, mixing, overlap, prefixes, quality, quotes, shards, simhash,
    topk, warc,
)
from tuneloom.llm.common import table


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "part")


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                       "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"),
                                 table(spark, sf_dir, "labels"))


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"))


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark")).drop("key")


def op10_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op11_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op12_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.near_duplicates(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_pivot_topk, op2_cube_mix, op3_warc_transactions, op4_zstd_language, op5_anchor_simhash,
    op6_differencing_shards, op7_pairwise_quality, op8_maxent_lm, op9_template_leaks,
    op10_quote_links, op11_shared_search, op12_shingle_join, op13_prefix_trie)}

ORACLES = {
    "op1_pivot_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op3_warc_transactions": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        first AS (SELECT hex, min(page_id) AS page_id FROM p GROUP BY hex)
        SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((CAST('0x' || substr(p.hex, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)
                   FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN p.page_id = first.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN p.page_id <> first.page_id THEN first.page_id END AS refers_to
        FROM p JOIN first USING (hex)""",
    "op10_quote_links": r"""
        WITH m AS (
            SELECT row_number() OVER () AS id, conv_id, turn, role,
                   string_split(translate(coalesce(text, ''), chr(13), ''), chr(10)) AS lines
            FROM conversations),
        l AS (
            SELECT id, conv_id, turn, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM m),
        d AS (
            SELECT *, len(regexp_replace(regexp_extract(line, '^([ \t]*>)+'), '[^>]', '', 'g')) AS depth,
                   regexp_replace(line, '^([ \t]*>)+[ \t]?', '') AS body FROM l),
        e AS (
            SELECT * FROM (SELECT *, lead(depth) OVER (PARTITION BY id ORDER BY i) AS next FROM d)
            WHERE NOT (depth = 0 AND regexp_matches(body, 'wrote:\s*$') AND coalesce(next, 0) > 0)),
        f AS (
            SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM (
                SELECT *, CASE WHEN depth IS DISTINCT FROM lag(depth) OVER (PARTITION BY id ORDER BY i)
                               THEN 1 ELSE 0 END AS new FROM e)),
        parts AS (
            SELECT id, conv_id, turn, depth, run, string_agg(body, chr(10) ORDER BY i) AS text
            FROM f GROUP BY ALL),
        own AS (
            SELECT id, conv_id, turn, trim(string_agg(text, chr(10) ORDER BY run), chr(32) || chr(9) || chr(10)) AS text
            FROM parts WHERE depth = 0 GROUP BY ALL),
        texts AS (
            SELECT id, conv_id, turn, depth, run, unnest(list_append(string_split(text, chr(10)), text)) AS piece,
                   trim(regexp_replace(lower(text), '[ \t\r\n\x0B\f]+', ' ', 'g')) AS passage FROM parts
            UNION ALL
            SELECT id, conv_id, turn, 0, -1, unnest(list_append(string_split(text, chr(10)), text)), '' FROM own),
        pieces AS (
            SELECT DISTINCT id, conv_id, turn, depth, passage,
                   trim(regexp_replace(lower(piece), '[ \t\r\n\x0B\f]+', ' ', 'g')) AS piece FROM texts),
        q AS (SELECT DISTINCT conv_id, turn, depth, passage, piece FROM pieces WHERE depth > 0 AND piece <> ''),
        o AS (SELECT DISTINCT conv_id, turn, piece FROM pieces WHERE depth = 0 AND piece <> ''),
        votes AS (
            SELECT conv_id, turn, depth, passage, source, count(*) AS votes FROM (
                SELECT q.conv_id, q.turn, q.depth, q.passage, q.piece, max(o.turn) AS source
                FROM q JOIN o ON q.conv_id = o.conv_id AND q.piece = o.piece AND o.turn < q.turn GROUP BY ALL)
            GROUP BY ALL),
        linked AS (
            SELECT * FROM (SELECT *, row_number() OVER (
                PARTITION BY conv_id, turn, depth, passage ORDER BY votes DESC, source DESC) AS k FROM votes)
            WHERE k = 1),
        replies AS (
            SELECT conv_id, turn, count(*) AS linked,
                   first(source ORDER BY depth, votes DESC, source DESC) AS quoted FROM linked GROUP BY ALL),
        turns AS (
            SELECT conv_id, turn, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS position, max(turn) OVER w AS previous
            FROM (SELECT conv_id, turn, count(*) AS n FROM conversations
                  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        quoted AS (
            SELECT id, count(DISTINCT (depth, passage)) AS n FROM pieces
            WHERE depth > 0 AND passage <> '' GROUP BY id)
        SELECT m.conv_id, m.turn, m.role, coalesce(own.text, '') AS own_text, turns.position,
               coalesce(replies.quoted, turns.previous) AS reply_to,
               CAST(coalesce(quoted.n, 0) AS BIGINT) AS quotes, CAST(coalesce(replies.linked, 0) AS BIGINT) AS linked
        FROM m LEFT JOIN own ON m.id = own.id LEFT JOIN quoted ON m.id = quoted.id
        LEFT JOIN turns ON m.conv_id = turns.conv_id AND m.turn = turns.turn
        LEFT JOIN replies ON m.conv_id = replies.conv_id AND m.turn = replies.turn""",
    "op11_shared_search": r"""
        WITH t AS (
            SELECT rid, doc_id, unnest(regexp_extract_all(translate(
                text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
        d AS (SELECT rid, doc_id, count(*) AS n FROM t GROUP BY ALL),
        c AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
        m AS (SELECT rid, doc_id, 100 - 25 + ((25 * n * nd) // l) AS m FROM d, c),
        tf AS (SELECT rid, term, count(*) AS tf FROM t GROUP BY ALL),
        w AS (
            SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2.0::DOUBLE)
                / (2.0::DOUBLE * count(*) + 1.0::DOUBLE))) AS BIGINT) AS w
            FROM tf, c GROUP BY term, nd),
        q AS (
            SELECT item, item_id, term, count(*) AS k FROM (
                SELECT item, item_id, unnest(regexp_extract_all(translate(
                    text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT row_number() OVER () AS item, item_id, text
                      FROM (SELECT DISTINCT item_id, text FROM benchmark)))
            GROUP BY ALL),
        s AS (
            SELECT item, item_id, rid, doc_id,
                   CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY ALL),
        r AS (
            SELECT *, CAST(row_number() OVER (
                PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
            FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op12_shingle_join": r"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(
                coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS MATERIALIZED (
            SELECT rid, doc_id, CASE
                WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)])
                END AS sh FROM d),
        g AS MATERIALIZED (
            SELECT min(rid) AS rid, sh FROM (SELECT rid, list_sort(sh) AS sh FROM s WHERE len(sh) > 0)
            GROUP BY sh),
        e AS MATERIALIZED (SELECT rid, len(sh) AS n, unnest(sh) AS x FROM g),
        l AS MATERIALIZED (
            SELECT a.rid AS a, b.rid AS b FROM e a JOIN e b ON a.x = b.x AND a.rid <> b.rid
            GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (
            SELECT rid AS a, rid AS b FROM g
            UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
        c AS (
            SELECT reach.a AS rid, min(s.doc_id) AS component_id
            FROM reach JOIN g ON g.rid = reach.b JOIN s ON list_sort(s.sh) = g.sh GROUP BY reach.a)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles,
               CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE c.component_id END AS component_id
        FROM s LEFT JOIN g ON g.sh = list_sort(s.sh) LEFT JOIN c ON c.rid = g.rid""",
    "op13_prefix_trie": """
        WITH o AS (
            SELECT conv_id, row_number() OVER (
                       PARTITION BY conv_id ORDER BY turn NULLS FIRST, hash) - 1 AS pos, hash, chars
            FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
                         md5(concat(length(coalesce(role, '')), ':', role, text)) AS hash
                  FROM conversations WHERE conv_id IS NOT NULL)),
        c AS (
            SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS base,
                   xor(list_reduce(
                       list_prepend(4294967295::BIGINT,
                           [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
                       lambda a, b: list_reduce(
                           list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                           lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))),
                       4294967295::BIGINT) % 6 AS h
            FROM o GROUP BY conv_id),
        p AS (
            SELECT c.*, least(c.h, coalesce(b.own, 0)) AS taken
            FROM c LEFT JOIN c b ON b.conv_id = c.base),
        r AS (
            SELECT p.conv_id, o.pos, hash, chars FROM p JOIN o ON o.conv_id = p.base AND o.pos < p.taken
            UNION ALL
            SELECT p.conv_id, o.pos - p.h + p.taken, hash, chars
            FROM p JOIN o ON o.conv_id = p.conv_id WHERE o.pos >= p.h),
        m AS (
            SELECT conv_id, 0 AS depth, '' AS path, 0 AS chars FROM p
            UNION ALL
            SELECT conv_id, pos + 1, string_agg(hash, '') OVER (PARTITION BY conv_id ORDER BY pos), chars
            FROM r),
        n AS (
            SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars
            FROM m GROUP BY path, depth),
        k AS (
            SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children
            FROM n WHERE depth > 0 GROUP BY ALL),
        v AS (
            SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
        t AS (
            SELECT substr(path, 1, 32 * up) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
                   sum((n_convs - 1) * chars) AS saved_tokens
            FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM v) GROUP BY ALL),
        e AS (
            SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
            FROM (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path)
        SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id,
               CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
               CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens,
               coalesce(e.ends, sha256('')) AS ends_sha256
        FROM v JOIN t ON t.path = v.path LEFT JOIN e ON e.path = v.path
        LEFT JOIN n u ON v.depth > 0 AND u.path = substr(v.path, 1, 32 * (v.depth - 1))""",
}
