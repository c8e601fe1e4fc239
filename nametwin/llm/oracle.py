"""SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER best = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM d
        WINDOW best AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
    """,
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM v AS a JOIN v AS b
              ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ),
        reach(a, b) AS (
            SELECT a, b FROM links
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ),
        found AS (
            SELECT vec_id,
                   (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links,
                   least(vec_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = vec_id), vec_id)) AS component_id
            FROM embeddings
        )
        SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
    """,
    "op6_mix_sources": rf"""
        WITH d AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
                   ('0x' || md5(concat(coalesce(doc_id::VARCHAR, '-'), ':', coalesce(text, '')))[1:15])::BIGINT AS place
            FROM documents
        ),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
            FROM d GROUP BY source
        ),
        levels AS (
            SELECT *, 2 * source_size / w AS ratio,
                   ((SELECT sum(source_size) FROM s) * 1.5 - coalesce(sum(2 * source_size) OVER before, 0))
                   / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0)) AS level
            FROM s
            WINDOW before AS (ORDER BY 2 * source_size / w, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ),
        t AS (
            SELECT source, source_size,
                   CASE WHEN ratio <= level THEN 2.0 * source_size
                        ELSE w * (SELECT max(level) FROM levels WHERE ratio > level) END::DOUBLE AS target
            FROM levels
        ),
        p AS (
            SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS owed,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               (greatest(0, least(begin_at + size, owed) - begin_at)
                + greatest(0, least(source_size + begin_at + size, owed) - source_size - begin_at))::BIGINT AS taken
        FROM p
    """,
    "op8_passage_dedup": rf"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
        ),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
        later AS (
            SELECT doc_id, i FROM (
                SELECT doc_id, i, row_number() OVER (
                    PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i
                ) AS r FROM starts
            ) WHERE r > 1
        ),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
        each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
            FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT w.doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0)::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op12_top_products": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER best AS rank, vec_id, score
        FROM scored
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY rank <= 5
    """,
    "op13_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        crc AS (  -- the table of CRC-32, by its rule
            SELECT list(list_reduce(list_prepend(i, range(8)),
                lambda x, s: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS steps
            FROM range(256) AS r(i)
        ),
        hashed AS (
            SELECT c, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
                lambda x, b: xor(x >> 8, steps[(xor(x, b) & 255) + 1]))) % 4 AS h
            FROM own, crc
        ),
        built AS (
            SELECT own.c, coalesce(base.turns[1:h], []) || own.turns[h + 1:] AS turns
            FROM own JOIN hashed USING (c) LEFT JOIN own AS base ON base.c = own.c - own.c % 20
        ),
        passed AS (
            SELECT c, d, turns[1:d] AS prefix, len(turns) = d AS ends,
                   CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].t, '[^\x20\x09-\x0D]+')) END AS words
            FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM built)
        ),
        nodes AS (
            SELECT d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256, prefix
            FROM passed GROUP BY d, prefix
        ),
        named AS (
            SELECT nodes.*, above.conv_id AS parent
            FROM nodes LEFT JOIN nodes AS above ON above.d = nodes.d - 1 AND above.prefix = nodes.prefix[1:nodes.d - 1]
        ),
        kids AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n FROM named WHERE d > 0 GROUP BY ALL),
        tree AS (SELECT named.*, coalesce(n, 0) AS n FROM named LEFT JOIN kids USING (d, conv_id)),
        above AS (  -- every node with each of its ancestors and itself
            SELECT top.d, top.conv_id, tree.n = 0 AS leaf, tree.saved
            FROM tree JOIN passed ON passed.c = tree.conv_id AND passed.d <= tree.d
            JOIN nodes AS top ON top.d = passed.d AND top.prefix = passed.prefix
        ),
        sums AS (SELECT d, conv_id, count_if(leaf) AS leaves, sum(saved) AS saved FROM above GROUP BY ALL)
        SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, n AS n_children, leaves::BIGINT AS n_leaves,
               sums.saved::BIGINT AS saved_tokens, ends_sha256
        FROM tree JOIN sums USING (d, conv_id)
    """,
}
