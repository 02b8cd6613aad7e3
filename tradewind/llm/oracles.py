"""DuckDB SQL for the queries of operators that SQL can express, over whole tables."""

from __future__ import annotations

_DEDUP = """
        WITH normal AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM normal WINDOW same AS (PARTITION BY norm)
    """

_JOIN = r"""
        WITH RECURSIVE lowered AS (
            SELECT row_number() OVER () AS row, doc_id,
                   list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents),
        sets AS MATERIALIZED (
            SELECT row, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda k: array_to_string(words[k:k + 3], ' '))) END AS shingles
            FROM lowered),
        tokens AS MATERIALIZED (SELECT row, len(shingles) AS size, unnest(shingles) AS token FROM sets),
        pairs AS (
            SELECT a.row AS one, b.row AS two, any_value(a.size) AS m, any_value(b.size) AS n, count(*) AS shared
            FROM tokens a JOIN tokens b ON a.token = b.token AND a.row <> b.row GROUP BY a.row, b.row),
        links AS MATERIALIZED (SELECT one, two FROM pairs WHERE 185 * shared >= 85 * (m + n)),
        reached AS (SELECT row, row AS other FROM sets UNION SELECT r.row, l.two FROM reached r JOIN links l ON l.one = r.other)
        SELECT s.doc_id, len(s.shingles) AS n_shingles, min(o.doc_id) AS component_id
        FROM sets s JOIN reached r USING (row) JOIN sets o ON o.row = r.other GROUP BY s.row, s.doc_id, s.shingles
"""

_TRIE = """
        WITH RECURSIVE turns AS MATERIALIZED (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                     sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS MATERIALIZED (
            SELECT conv_id, conv_id - conv_id % 100 AS family,
                   xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::UBIGINT),
                     lambda crc, byte: list_reduce(range(8), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, byte)),
                     4294967295::UBIGINT), 4294967295::UBIGINT) % 6 AS taken
            FROM (SELECT DISTINCT conv_id FROM turns)),
        given AS (SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.family AND t.pos <= c.taken),
        counts AS (SELECT c.conv_id, c.taken, count(g.pos) AS given FROM convs c LEFT JOIN given g USING (conv_id) GROUP BY ALL),
        rebuilt AS MATERIALIZED (
            SELECT * FROM given UNION ALL
            SELECT t.conv_id, t.pos - c.taken + c.given, role, text FROM turns t JOIN counts c USING (conv_id) WHERE t.pos > c.taken),
        prefixes AS MATERIALIZED (
            SELECT 0 AS depth, '' AS key, conv_id, NULL::VARCHAR AS up, 0 AS chars FROM convs
            UNION ALL SELECT depth, key, conv_id, sha256((path[:-2])::VARCHAR) || '' AS up, chars FROM (
              SELECT pos AS depth, sha256(path::VARCHAR) AS key, conv_id, path, chars FROM (
                SELECT pos, conv_id, length(text) AS chars, list([role, text]) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM rebuilt))),
        keyed AS MATERIALIZED (SELECT depth, key, conv_id, CASE WHEN depth = 1 THEN '' ELSE up END AS up, chars FROM prefixes),
        lengths AS (SELECT conv_id, max(depth) AS depth FROM keyed GROUP BY conv_id),
        nodes AS MATERIALIZED (
            SELECT key, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM keyed GROUP BY key),
        ends AS (SELECT k.key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
            FROM keyed k JOIN lengths USING (conv_id, depth) GROUP BY k.key),
        kids AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
        above AS (SELECT key, key AS top, up FROM nodes UNION ALL SELECT a.key, n.key, n.up FROM above a JOIN nodes n ON n.key = a.up),
        sums AS (SELECT top AS key, sum((k.key IS NULL)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
            FROM above a JOIN nodes n ON n.key = a.key LEFT JOIN kids k ON k.key = a.key GROUP BY top)
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
               s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
        FROM nodes n JOIN sums s USING (key) LEFT JOIN kids k USING (key) LEFT JOIN ends e USING (key)
        LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.up
"""



def _lloyd(rounds: int) -> str:
    """Parts with their nearest entry, then the means of each entry's parts, as often as there are rounds, and the last nearest ones."""
    steps = []
    for k in range(1, rounds + 2):
        steps.append(f"""
        near{k} AS MATERIALIZED (
            SELECT row, part, any_value(piece) AS piece, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance
            FROM (SELECT p.row, p.part, p.piece, b.entry,
                    list_sum(list_transform(list_zip(p.piece, b.piece), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
                  FROM parts p JOIN books{k - 1} b USING (part)) GROUP BY row, part),""")
        if k <= rounds:
            steps.append(f"""
        means{k} AS (
            SELECT part, entry, k, floor(sum(piece[k])::HUGEINT / count(*))::BIGINT AS mean FROM near{k}, width, range(1, size + 1) t(k) GROUP BY ALL),
        books{k} AS MATERIALIZED (
            SELECT b.part, b.entry, coalesce(m.piece, b.piece) AS piece FROM books{k - 1} b
            LEFT JOIN (SELECT part, entry, list(mean ORDER BY k) AS piece FROM means{k} GROUP BY part, entry) m USING (part, entry)),""")
    return "".join(steps)


_CODES = f"""
        WITH ints AS (
            SELECT *, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS ints FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, ints) AS row, vec_id, label, ints FROM ints),
        width AS (SELECT greatest(1, ceil(max(len(ints)) / 16))::BIGINT AS size FROM kept),
        parts AS MATERIALIZED (
            SELECT row, p AS part, list_transform(range(1, size + 1), lambda k: coalesce(ints[p * size + k], 0)) AS piece
            FROM kept, width, range(16) t(p)),
        books0 AS MATERIALIZED (SELECT part, row - 1 AS entry, piece FROM parts WHERE row <= 64),{_lloyd(2)}
        errors AS MATERIALIZED (
            SELECT row, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM near3 GROUP BY row),
        digest AS (SELECT sha256(string_agg(array_to_string(piece, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM kept JOIN errors USING (row), digest
"""

ORACLES = {"op2_exact_dedup": _DEDUP, "op11_ngram_join": _JOIN, "op12_prefix_trie": _TRIE, "op13_codebooks": _CODES}
