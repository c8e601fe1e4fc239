"""DuckDB SQL for the registered queries, written from the definitions alone."""

from __future__ import annotations

from nametwin.sources import synthetic as syn

# Whitespace spelled out, because `\\s` means less in DuckDB.
WHITESPACE = (
    r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
DROPPED = f"[^a-zA-Z0-9{WHITESPACE}]"
OUTER_WHITESPACE = f"^[{WHITESPACE}]+|[{WHITESPACE}]+$"


def _norm(text: str) -> str:
    return f"regexp_replace(lower(coalesce({text}, '')), '{DROPPED}', '', 'g')"


def _valid(text: str) -> str:
    return f"coalesce(length(regexp_replace({text}, '{OUTER_WHITESPACE}', '', 'g')) > 1, false)"


def _tokens(norm: str) -> str:
    return f"regexp_extract_all({norm}, '[a-z0-9]{{2,}}')"


def _unit(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


SHOWN = """shown AS (
  SELECT p_partkey, p_brand,
         p_name || ' ' || p_type || ' size ' || p_size AS A,
         p_type || ' ' || p_name || ', ' || p_size AS B
  FROM part)"""

ENTRIES = f"""{SHOWN}, entries AS (
  SELECT p_brand || '/' || (p_partkey // 1000) AS request_id, 'A' AS side, p_partkey AS pos, A AS name FROM shown
  UNION ALL SELECT p_brand || '/' || (p_partkey // 1000), 'B', p_partkey, B FROM shown)"""

USABLE = f"""{ENTRIES}, usable AS (
  SELECT request_id, side, pos, {_norm('name')} AS norm FROM entries WHERE {_valid('name')})"""

PART_PAIRS = f"""{SHOWN}, pairs AS (
  SELECT A, B, true AS match FROM shown
  UNION ALL
  SELECT x.A, y.B, false FROM shown x JOIN shown y ON y.p_partkey = x.p_partkey + 1)"""

TALK = """talk AS (
  SELECT conv_id || '-' || turn AS pair_id, text AS A,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS B
  FROM conversations)"""

TEXT_PAIRS = f"""{SHOWN}, {TALK}, raw_pairs AS (
  SELECT * FROM talk
  UNION ALL SELECT 'part-' || p_partkey, A, B FROM shown),
text_pairs AS (
  SELECT pair_id, {_norm('A')} AS A_norm, {_norm('B')} AS B_norm FROM raw_pairs)"""

IDF_OF_DOCS = f"""n_docs AS (SELECT count(*) AS n FROM docs),
idf AS (
  SELECT term, count(*) AS df,
         ln((1.0 + (SELECT n FROM n_docs)) / (1.0 + count(*))) + 1.0 AS idf
  FROM (SELECT unnest(list_distinct({_tokens('norm')})) AS term FROM docs)
  GROUP BY term)"""

PAIR_IDF = f"""{TEXT_PAIRS}, docs AS (
  SELECT A_norm AS norm FROM text_pairs UNION ALL SELECT B_norm FROM text_pairs), {IDF_OF_DOCS}"""

PAIR_COSINE = f"""{PAIR_IDF}, words AS (
  SELECT pair_id, 1 AS is_a, unnest({_tokens('A_norm')}) AS term FROM text_pairs
  UNION ALL
  SELECT pair_id, 0, unnest({_tokens('B_norm')}) FROM text_pairs),
weights AS (
  SELECT pair_id, is_a, term, count(*) * any_value(idf) AS w
  FROM words JOIN idf USING (term) GROUP BY pair_id, is_a, term),
sizes AS (SELECT pair_id, is_a, sqrt(sum(w * w)) AS size FROM weights GROUP BY pair_id, is_a),
cosine AS (
  SELECT a.pair_id, sum(a.w * b.w) / (any_value(sa.size) * any_value(sb.size)) AS cosine
  FROM weights a
  JOIN weights b ON b.pair_id = a.pair_id AND b.term = a.term AND b.is_a = 0
  JOIN sizes sa ON sa.pair_id = a.pair_id AND sa.is_a = 1
  JOIN sizes sb ON sb.pair_id = a.pair_id AND sb.is_a = 0
  WHERE a.is_a = 1
  GROUP BY a.pair_id)"""

# distinct pairs, split as the training does, with weights of the training part
_HELD = "ceil((SELECT count(*) FROM uniq) * (0.3::DOUBLE + (1.0::DOUBLE - 0.6 - 0.3)))"
MODEL_COSINE = f"""{PART_PAIRS}, uniq AS (
  SELECT *, sha256('{{"A":"' || A || '","B":"' || B || '","match":' || match || '}}') AS pair_id
  FROM (SELECT DISTINCT A, B, match FROM pairs)),
ranked AS (SELECT *, row_number() OVER (ORDER BY {_unit("pair_id || ':42'")}, pair_id) AS r FROM uniq),
text_pairs AS (SELECT *, {_norm('A')} AS A_norm, {_norm('B')} AS B_norm FROM ranked),
known AS (SELECT * FROM text_pairs WHERE r <= (SELECT count(*) FROM uniq) - {_HELD}),
docs AS (SELECT A_norm AS norm FROM known UNION ALL SELECT B_norm FROM known), {IDF_OF_DOCS}{PAIR_COSINE.removeprefix(PAIR_IDF)}"""

# every pair of distinct names of a request, then the rule: the brute-force answer
def _rule(entries: str, accepted: str, inner: bool = True) -> str:
    side = "JOIN" if inner else "LEFT JOIN"
    return f"""{entries}, usable AS (
  SELECT request_id, side, pos, {_norm('name')} AS norm FROM entries WHERE {_valid('name')}), names AS (SELECT DISTINCT request_id, side, norm FROM usable),
docs AS (SELECT {_norm('name')} AS norm FROM entries), {IDF_OF_DOCS},
all_words AS (
  SELECT norm, unnest({_tokens('norm')}) AS term FROM (SELECT DISTINCT norm FROM names)),
weights AS (
  SELECT norm, term, count(*) * any_value(idf) AS w
  FROM all_words JOIN idf USING (term) GROUP BY norm, term),
sizes AS (SELECT norm, sqrt(sum(w * w)) AS size FROM weights GROUP BY norm),
candidates AS (
  SELECT a.request_id, a.norm AS A_norm, b.norm AS B_norm
  FROM names a JOIN names b USING (request_id) WHERE a.side = 'A' AND b.side = 'B'),
dots AS (
  SELECT A_norm, B_norm, sum(x.w * y.w) AS dot
  FROM (SELECT DISTINCT A_norm, B_norm FROM candidates)
  JOIN weights x ON x.norm = A_norm JOIN weights y ON y.norm = B_norm AND y.term = x.term
  GROUP BY A_norm, B_norm),
accepted AS (
  SELECT c.request_id, c.A_norm, c.B_norm, d.dot / (sa.size * sb.size) AS cosine_similarity,
         levenshtein(c.A_norm, c.B_norm) AS levenshtein_distance,
         jaro_winkler_similarity(c.A_norm, c.B_norm) AS jaro_winkler_similarity
  FROM candidates c {side} dots d USING (A_norm, B_norm)
  {side} sizes sa ON sa.norm = c.A_norm {side} sizes sb ON sb.norm = c.B_norm
  WHERE {accepted}),
mapped AS (
  SELECT a.request_id, a.pos AS A_pos, b.pos // 4096 AS B_tile, b.pos AS B_pos
  FROM accepted m
  JOIN usable a ON a.request_id = m.request_id AND a.side = 'A' AND a.norm = m.A_norm
  JOIN usable b ON b.request_id = m.request_id AND b.side = 'B' AND b.norm = m.B_norm),
lists AS (
  SELECT request_id, A_pos, B_tile, string_agg(B_pos::VARCHAR, ',' ORDER BY B_pos) AS B_positions
  FROM mapped GROUP BY ALL)"""

_SIMILAR = "(d.dot / (sa.size * sb.size) >= 0.8 AND jaro_winkler_similarity(c.A_norm, c.B_norm) >= 0.6)"
RULE = _rule(ENTRIES, _SIMILAR)
NEAR_RULE = _rule(ENTRIES, f"({_SIMILAR} OR levenshtein(c.A_norm, c.B_norm) <= 3)", inner=False)
ALIKE_RULE = _rule(ENTRIES, f"({_SIMILAR} OR jaro_winkler_similarity(c.A_norm, c.B_norm) >= 0.78)", inner=False)

REQUEST_ROWS = f"""{TALK}, sent AS (
  SELECT pair_id AS request_id, 'A' AS side, regexp_split_to_array(A, '[.\\n]') AS names FROM talk
  UNION ALL
  SELECT pair_id, 'B', regexp_split_to_array(B, '[.\\n]') FROM talk),
items AS (
  SELECT request_id, side, generate_subscripts(names, 1) - 1 AS pos, unnest(names) AS name FROM sent)"""

TALK_RULE = _rule(REQUEST_ROWS + ", entries AS (SELECT * FROM items)", _SIMILAR)


def _replies(rule: str, requests: str) -> str:
    """JSON replies, one object per request and part."""
    return f"""WITH {rule}, objects AS (
          SELECT request_id, (A_pos // 1024) || '-' || B_tile AS part,
                 '{{' || string_agg('"' || A_pos || '":[' || B_positions || ']', ',' ORDER BY A_pos) || '}}'
                   AS positional_mapping
          FROM lists GROUP BY 1, 2)
        SELECT r.request_id, coalesce(part, '0-0') AS part,
               coalesce(positional_mapping, '{{}}') AS positional_mapping, NULL::VARCHAR AS error
        FROM ({requests}) r LEFT JOIN objects o USING (request_id)"""


SCORED = """scored AS (
  SELECT doc_id, lang AS A, source AS B, quality = 1 AS match,
         n_chars / (n_chars + 4000.0::DOUBLE) AS proba,
         n_chars / (n_chars + 4000.0::DOUBLE) >= 0.5 AS decision
  FROM documents JOIN labels USING (doc_id))"""

CURVE = f"""{SCORED}, curve AS (
  SELECT proba, n, tp, sum(n) OVER w AS cum_n, sum(tp) OVER w AS cum_tp
  FROM (SELECT proba, count(*) AS n, count(*) FILTER (match) AS tp FROM scored GROUP BY proba)
  WINDOW w AS (ORDER BY proba DESC))"""

AP = "sum(tp * cum_tp / cum_n) / sum(tp)"
AUC = "sum((n - tp) * (cum_tp - tp / 2.0)) / (sum(tp) * sum(n - tp))"
ACCURACY = "count(*) FILTER (decision = match)::DOUBLE / count(*)"
PRECISION = "coalesce(count(*) FILTER (decision AND match)::DOUBLE / nullif(count(*) FILTER (decision), 0), 0)"
RECALL = "coalesce(count(*) FILTER (decision AND match)::DOUBLE / nullif(count(*) FILTER (match), 0), 0)"

GRID = f"""{SCORED}, grid AS (
  SELECT i * 0.01::DOUBLE AS threshold,
         coalesce((SELECT count(*) FILTER (match)::DOUBLE / nullif(count(*), 0)
                   FROM scored WHERE proba >= i * 0.01::DOUBLE), 0) AS precision
  FROM range(101) AS r(i))"""


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _lists(groups) -> str:
    return "[" + ", ".join(_list(g) for g in groups) + "]"


def _draw(digest: str, i: int) -> str:
    return f"(('0x' || substr({digest}, {4 * i + 1}, 4))::BIGINT / 65536.0::DOUBLE)"


def _pick(u: str, n: str) -> str:
    return f"floor({u} * {n})::INT"


def _generator(accents: bool) -> str:
    """The labelled pairs of all orders, stage by stage."""
    uses = ("words", "groups", "capitals", "typos", "positions")
    digests = ", ".join(f"md5('7:' || o_orderkey || ':{s}:{u}') AS {s}_{u}" for s in "AB" for u in uses)

    def parts(s: str) -> str:
        def group(slot: int) -> str:
            return f"CASE WHEN match THEN {_draw('pair_draws', slot + 1)} ELSE {_draw(s + '_groups', slot)} END"

        def plain(words, i: int) -> str:
            n = str(len(words) + syn.BLANKS)
            return f"coalesce({_list(words)}[{_pick(_draw(s + '_words', i), n)} + 1], '')"

        def grouped(groups, slot: int, i: int) -> str:
            chosen = f"{_lists(groups)}[{_pick(group(slot), str(len(groups)))} + 1]"
            return f"{chosen}[{_pick(_draw(s + '_words', i), f'len({chosen})')} + 1]"

        def optional(word: str, i: int) -> str:
            return f"CASE WHEN {_draw(s + '_words', i)} < {syn.P_PROPERTY_BLANK!r}::DOUBLE THEN '' ELSE {word} END"

        items = [
            plain(syn.ARTICLES, 0), plain(syn.MODIFIERS, 1),
            grouped(syn.SIZES, 0, 2), grouped(syn.TYPES, 1, 3),
            optional(grouped(syn.PROPERTIES, 2, 4), 5), optional(grouped(syn.PROPERTIES, 3, 6), 7),
        ]
        return "[" + ", ".join(items) + "]"

    def capitals(s: str) -> str:
        p = s + "_parts"
        return "[" + ", ".join(
            f"CASE WHEN {_draw(s + '_capitals', i)} < {syn.P_CAPITALIZE}"
            f" THEN upper({p}[{i + 1}][1:1]) || lower({p}[{i + 1}][2:]) ELSE {p}[{i + 1}] END"
            for i in range(syn.SLOTS)
        ) + "]"

    def typos(s: str) -> str:
        p = s + "_parts"

        def one(i: int) -> str:
            at = _pick(_draw(s + "_positions", i), f"length({p}[{i + 1}])")
            return (
                f"CASE WHEN {_draw(s + '_typos', i)} < {syn.P_DROP_CHAR} AND length({p}[{i + 1}]) > 0"
                f" THEN substr({p}[{i + 1}], 1, {at}) || substr({p}[{i + 1}], {at} + 2) ELSE {p}[{i + 1}] END"
            )

        return "[" + ", ".join(one(i) for i in range(syn.SLOTS)) + "]"

    def text(s: str) -> str:
        joined = f"trim(array_to_string({s}_parts, ' '))"
        shown = f"CASE WHEN {_draw(s + '_groups', 4)} < {syn.P_UPPER} THEN upper({joined}) ELSE {joined} END"
        if accents:
            shown = (
                f"CASE WHEN {_draw(s + '_groups', 5)} < {syn.P_ACCENT}"
                f" THEN translate({shown}, '{syn.PLAIN}', '{syn.ACCENTED}') ELSE {shown} END"
            )
        return shown

    return f"""drawn AS (
  SELECT o_orderkey AS pair_id, md5('7:' || o_orderkey || ':pair') AS pair_draws, {digests} FROM orders),
labelled AS (SELECT *, {_draw('pair_draws', 0)} < 0.5 AS match FROM drawn),
worded AS (SELECT *, {parts('A')} AS A_parts, {parts('B')} AS B_parts FROM labelled),
cased AS (SELECT * REPLACE ({capitals('A')} AS A_parts, {capitals('B')} AS B_parts) FROM worded),
typed AS (SELECT * REPLACE ({typos('A')} AS A_parts, {typos('B')} AS B_parts) FROM cased),
generated AS (SELECT pair_id, {text('A')} AS A, {text('B')} AS B, match FROM typed)"""


SPLIT_KEY = _unit("o_orderkey || ':42'")

_BUCKET = "CASE WHEN n = 0 THEN 0 ELSE length(bin(n)) END"


def _drift(sized: str, by: str) -> str:
    """Population stability of the lengths of `sized`, by group, against those of `known`."""
    return f"""
        WITH {sized},
        histogram AS (SELECT {by}, {_BUCKET} AS bucket, count(*) AS n FROM sized GROUP BY ALL),
        base AS (SELECT {_BUCKET} AS bucket, count(*) / (SELECT count(*) FROM known) AS share FROM known GROUP BY ALL),
        groups AS (SELECT {by}, sum(n) AS n_names FROM histogram GROUP BY {by}),
        shares AS (
          SELECT g.{by}, g.n_names,
                 greatest(coalesce(h.n / g.n_names, 0), 0.0001::DOUBLE) AS p,
                 greatest(coalesce(b.share, 0), 0.0001::DOUBLE) AS q
          FROM groups g CROSS JOIN range(32) AS r(bucket)
          LEFT JOIN histogram h ON h.{by} = g.{by} AND h.bucket = r.bucket
          LEFT JOIN base b ON b.bucket = r.bucket)
        SELECT {by}, n_names::BIGINT AS n_names, round(sum((p - q) * ln(p / q)), 6) AS psi
        FROM shares GROUP BY ALL"""


ORACLES = {
    "normalize_names": f"""
        SELECT source, id, md5(norm) AS norm_md5, length(norm)::BIGINT AS norm_length FROM (
          SELECT 'documents' AS source, doc_id AS id, {_norm('text')} AS norm FROM documents
          UNION ALL SELECT 'customer', c_custkey, {_norm('c_name')} FROM customer)""",
    "valid_names": f"""
        SELECT {_valid('name')} AS valid, count(*)::BIGINT AS n, sum(id)::BIGINT AS id_sum FROM (
          SELECT p_partkey AS id, p_size::VARCHAR AS name FROM part
          UNION ALL SELECT p_partkey, p_name FROM part
          UNION ALL SELECT doc_id, text FROM documents)
        GROUP BY 1""",
    "tokenize_counts": f"""
        SELECT term, count(*)::BIGINT AS n
        FROM (SELECT unnest({_tokens(_norm('text'))}) AS term FROM documents) GROUP BY term""",
    "usable_entries": f"WITH {USABLE} SELECT request_id, side, pos, norm FROM usable",
    "distinct_catalog_names": f"""WITH {USABLE}
        SELECT request_id, side, norm, count(*)::BIGINT AS copies FROM usable GROUP BY ALL""",
    "pair_counts_by_request": f"""WITH {ENTRIES}
        SELECT a.request_id, count(*)::BIGINT AS n_pairs,
               count(*) FILTER ({_valid('a.name')} AND {_valid('b.name')})::BIGINT AS n_valid_pairs
        FROM entries a JOIN entries b USING (request_id)
        WHERE a.side = 'A' AND b.side = 'B' GROUP BY a.request_id""",
    "dedupe_pairs": f"WITH {PART_PAIRS} SELECT DISTINCT A, B, match FROM pairs",
    "tfidf_idf": f"WITH {PAIR_IDF} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idf",
    "tfidf_cosine_pairs": f"""WITH {PAIR_COSINE}
        SELECT pair_id, round(cosine, 6) AS cosine_similarity FROM cosine""",
    "levenshtein_pairs": f"""WITH {TEXT_PAIRS}
        SELECT pair_id, levenshtein(A_norm, B_norm)::BIGINT AS levenshtein_distance FROM text_pairs""",
    "jaro_winkler_pairs": f"""WITH {TEXT_PAIRS}
        SELECT pair_id, round(jaro_winkler_similarity(A_norm, B_norm), 6) AS jaro_winkler_similarity
        FROM text_pairs""",
    "embedding_cosine_pairs": """
        SELECT a.vec_id,
               round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "feature_rows": f"""WITH {PAIR_COSINE}
        SELECT pair_id, round(coalesce(cosine, 0.0), 6) AS cosine_similarity,
               levenshtein(A_norm, B_norm)::BIGINT AS levenshtein_distance,
               round(jaro_winkler_similarity(A_norm, B_norm), 6) AS jaro_winkler_similarity
        FROM text_pairs LEFT JOIN cosine USING (pair_id)""",
    "rule_name_pairs": f"""WITH {RULE}
        SELECT request_id, A_norm, B_norm, round(cosine_similarity, 6) AS cosine_similarity,
               levenshtein_distance::BIGINT AS levenshtein_distance,
               round(jaro_winkler_similarity, 6) AS jaro_winkler_similarity
        FROM accepted""",
    "rule_mapping": f"WITH {RULE} SELECT request_id, A_pos, B_tile, B_positions FROM lists",
    "rule_match_counts": f"""WITH {RULE}
        SELECT request_id, count(*)::BIGINT AS n_matches FROM mapped GROUP BY request_id""",
    "mapping_json": _replies(RULE, "SELECT DISTINCT request_id FROM entries"),
    "reply_by_rule": _replies(TALK_RULE, "SELECT pair_id AS request_id FROM talk"),
    "stream_by_rule": _replies(TALK_RULE, "SELECT pair_id AS request_id FROM talk"),
    "near_name_pairs": f"""WITH {NEAR_RULE}
        SELECT request_id, A_norm, B_norm, levenshtein_distance::BIGINT AS levenshtein_distance FROM accepted""",
    "similar_spellings": f"""WITH {ALIKE_RULE}
        SELECT request_id, A_norm, B_norm, round(jaro_winkler_similarity, 6) AS jaro_winkler_similarity FROM accepted""",
    "unseen_vocabulary": f"""
        WITH known AS (SELECT DISTINCT unnest({_tokens(_norm('text'))}) AS term FROM documents),
        words AS (SELECT DISTINCT unnest({_tokens(_norm('text'))}) AS term FROM conversations)
        SELECT count(*)::BIGINT AS n, count(*) FILTER (k.term IS NULL)::BIGINT AS n_new, true AS sketch_agrees
        FROM words w LEFT JOIN known k ON k.term = w.term""",
    "unseen_term_spellings": f"""
        WITH known AS (SELECT DISTINCT unnest({_tokens(_norm('text'))}) AS term FROM documents),
        words AS (SELECT DISTINCT unnest({_tokens(_norm('text'))}) AS term FROM conversations),
        unseen AS (SELECT term FROM words ANTI JOIN known USING (term))
        SELECT u.term, k.term AS known FROM unseen u JOIN known k
          ON abs(length(u.term) - length(k.term)) <= 1 AND levenshtein(u.term, k.term) <= 1""",
    "matching_equals_scoring": f"""WITH {USABLE}, names AS (SELECT DISTINCT request_id, side, norm FROM usable)
        SELECT count(*)::BIGINT AS n_pairs, 0::BIGINT AS n_different
        FROM names a JOIN names b USING (request_id) WHERE a.side = 'A' AND b.side = 'B'""",
    "scores_by_boxes": f"""WITH {MODEL_COSINE}
        SELECT A, B, match, round(coalesce(cosine, 0.0), 6) AS cosine_similarity,
               levenshtein(A_norm, B_norm)::BIGINT AS levenshtein_distance,
               round(jaro_winkler_similarity(A_norm, B_norm), 6) AS jaro_winkler_similarity, true AS agrees
        FROM text_pairs LEFT JOIN cosine USING (pair_id)""",
    "importance_by_gain": """
        SELECT unnest(['cosine_similarity', 'levenshtein_distance', 'jaro_winkler_similarity']) AS feature,
               true AS gain_agrees, true AS splits_agree""",
    "smoke_before_publishing": """
        SELECT match, 5::BIGINT AS n, 5::BIGINT AS n_fine, 1::BIGINT AS version FROM (VALUES (true), (false)) AS v(match)""",
    "stream_equals_batch": f"""WITH {TALK}
        SELECT count(*)::BIGINT AS n_requests, 0::BIGINT AS n_different FROM talk""",
    "model_roundtrip": f"""WITH {PART_PAIRS}
        SELECT count(*)::BIGINT AS n_pairs, 0::BIGINT AS n_different, 1::BIGINT AS version
        FROM (SELECT DISTINCT A, B, match FROM pairs)""",
    "request_entries": f"""WITH {REQUEST_ROWS}
        SELECT request_id, side, pos::BIGINT AS pos, {_norm('name')} AS norm FROM items WHERE {_valid('name')}""",
    "request_errors": f"""WITH {TALK}
        SELECT 'none' AS error, count(*)::BIGINT AS n FROM talk
        UNION ALL SELECT 'malformed JSON', count(*) FROM documents
        UNION ALL SELECT 'missing inputCatalog', count(*) FROM documents""",
    "split_assign": f"""
        SELECT o_orderkey, CASE WHEN u < 0.6::DOUBLE THEN 'train'
                                WHEN u < 0.6::DOUBLE + 0.3::DOUBLE THEN 'val' ELSE 'test' END AS part
        FROM (SELECT o_orderkey, {SPLIT_KEY} AS u FROM orders)""",
    "split_sizes": f"""
        WITH sized AS (
          SELECT count(*) AS n, ceil(count(*) * (0.3::DOUBLE + (1.0::DOUBLE - 0.6 - 0.3))) AS held FROM orders),
        cuts AS (
          SELECT n - held AS n_train,
                 n - ceil(held * ((1.0::DOUBLE - 0.6 - 0.3) / (0.3::DOUBLE + (1.0::DOUBLE - 0.6 - 0.3)))) AS n_known
          FROM sized),
        ranked AS (
          SELECT o_orderkey, row_number() OVER (ORDER BY {SPLIT_KEY}, o_orderkey::VARCHAR) AS r FROM orders)
        SELECT CASE WHEN r <= n_train THEN 'train' WHEN r <= n_known THEN 'val' ELSE 'test' END AS part,
               count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS key_sum
        FROM ranked, cuts GROUP BY 1""",
    "synthetic_pairs": f"WITH {_generator(False)} SELECT * FROM generated",
    "synthetic_accented": f"""WITH {_generator(True)}
        SELECT match, count(*)::BIGINT AS n,
               count(*) FILTER (A <> regexp_replace(A, '[áéíóúñçÁÉÍÓÚÑÇ]', '', 'g'))::BIGINT AS n_accented
        FROM generated GROUP BY match""",
    "synthetic_match_rate": f"""WITH {_generator(False)}
        SELECT round(avg(match::INT), 6) AS match_rate FROM generated""",
    "confusion_metrics": f"""WITH {SCORED}
        SELECT round({ACCURACY}, 6) AS accuracy_score, round({PRECISION}, 6) AS precision_score,
               round({RECALL}, 6) AS recall_score FROM scored""",
    "average_precision": f"WITH {CURVE} SELECT round({AP}, 6) AS average_precision_score FROM curve",
    "roc_auc": f"WITH {CURVE} SELECT round({AUC}, 6) AS roc_auc_score FROM curve",
    "score_quantiles": f"""WITH {SCORED}
        SELECT 'test_q' || q AS metric,
               round(CASE q WHEN '0.25' THEN quantile_cont(proba, 0.25)
                            WHEN '0.5' THEN quantile_cont(proba, 0.5)
                            ELSE quantile_cont(proba, 0.75) END, 6) AS value
        FROM scored, (VALUES ('0.25'), ('0.5'), ('0.75')) AS v(q) GROUP BY q""",
    "precision_by_threshold": f"""WITH {GRID}
        SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision FROM grid""",
    "min_precision_threshold": f"""WITH {GRID}
        SELECT round(min(threshold) FILTER (precision >= 0.7), 6) AS threshold FROM grid""",
    "evaluation_report": f"""WITH {CURVE}
        SELECT 'average_precision_score' AS metric, round({AP}, 6) AS value FROM curve
        UNION ALL SELECT 'roc_auc_score', round({AUC}, 6) FROM curve
        UNION ALL SELECT 'passed', ({AP} >= 0.98)::INT::DOUBLE FROM curve
        UNION ALL SELECT 'accuracy_score', round({ACCURACY}, 6) FROM scored
        UNION ALL SELECT 'precision_score', round({PRECISION}, 6) FROM scored
        UNION ALL SELECT 'recall_score', round({RECALL}, 6) FROM scored
        UNION ALL SELECT 'test_q0.25', round(quantile_cont(proba, 0.25), 6) FROM scored
        UNION ALL SELECT 'test_q0.5', round(quantile_cont(proba, 0.5), 6) FROM scored
        UNION ALL SELECT 'test_q0.75', round(quantile_cont(proba, 0.75), 6) FROM scored""",
    "tp_examples": f"""WITH {SCORED}
        SELECT A, B FROM scored WHERE decision AND match ORDER BY doc_id LIMIT 20""",
    "tn_examples": f"""WITH {SCORED}
        SELECT A, B FROM scored WHERE NOT decision AND NOT match ORDER BY doc_id LIMIT 20""",
    "sample_nonmatching": f"""WITH {SCORED}
        SELECT doc_id, A, B FROM scored WHERE NOT match ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20""",
    "sample_matching": f"""WITH {SCORED}
        SELECT doc_id, A, B FROM scored WHERE match ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20""",
    "name_drift": _drift(
        f"sized AS (SELECT source, length({_norm('text')}) AS n FROM documents), known AS (SELECT n FROM sized)", "source"
    ),
    "drift_from_training": _drift(
        f"""{ENTRIES}, sized AS (SELECT c_mktsegment AS segment, length({_norm('c_name')}) AS n FROM customer),
        known AS (SELECT length({_norm('name')}) AS n FROM entries)""",
        "segment",
    ),
    "unseen_terms": f"""
        WITH known AS (SELECT DISTINCT unnest({_tokens(_norm('text'))}) AS term FROM documents),
        words AS (SELECT unnest({_tokens(_norm('text'))}) AS term FROM conversations)
        SELECT round(count(*) FILTER (k.term IS NULL)::DOUBLE / count(*), 6) AS unseen_rate
        FROM words w LEFT JOIN known k ON k.term = w.term""",
    "accuracy_by_day": f"""
        WITH scored AS (
          SELECT o_orderdate::DATE AS day, o_totalprice >= 200000 AS decision, o_orderstatus = 'F' AS match
          FROM orders)
        SELECT day, round({ACCURACY}, 6) AS accuracy_score, round({PRECISION}, 6) AS precision_score,
               round({RECALL}, 6) AS recall_score FROM scored GROUP BY day""",
}

# the same answers on the ways that large tables take
ORACLES |= {
    "tfidf_cosine_shuffled": ORACLES["tfidf_cosine_pairs"],
    "rule_mapping_tiled": ORACLES["rule_mapping"],
    "average_precision_ranges": ORACLES["average_precision"],
    "late_label_accuracy": ORACLES["accuracy_by_day"],
}

_LETTERS = "string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z 0 1 2 3 4 5 6 7 8 9', ' ')"


def _letter_counts(norm: str) -> str:
    return f"list_transform({_LETTERS}, lambda c: (length({norm}) - length(replace({norm}, c, '')))::DOUBLE)"


ORACLES["dense_matching_equals_scoring"] = ORACLES["matching_equals_scoring"]
ORACLES["dense_feature_pairs"] = f"""WITH {TEXT_PAIRS}, letters AS (
  SELECT pair_id, {_letter_counts("A_norm")} AS a, {_letter_counts("B_norm")} AS b FROM text_pairs),
products AS (
  SELECT pair_id, list_dot_product(a, b) AS ab, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb FROM letters)
SELECT pair_id, CASE WHEN aa > 0 AND bb > 0 THEN round(ab / (sqrt(aa) * sqrt(bb)), 6) ELSE 0.0 END AS embedding_cosine_similarity
FROM products"""
