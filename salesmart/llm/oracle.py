"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from salesmart.llm.licenses import TEMPLATES, THRESHOLD


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NOTICES = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES)


def _tidy(text: str) -> str:
    return f"regexp_replace({text}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def _bigrams(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII signs, bit by bit."""
    bits = "list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))"
    signs = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::UBIGINT)"
    return f"xor(list_reduce([4294967295::UBIGINT] || {signs}, lambda c, b: {bits}), 4294967295::UBIGINT)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BEFORE, _AFTER = "array_to_string(k.kids[1:c.place % 16], '')", "array_to_string(k.kids[c.place % 16 + 2:], '')"


def _climb(name: str, start: str, kids: str) -> str:
    """Leaves that climb a tree of levels until one node is left."""
    return f"""{name}(doc_id, leaf, tree, l, place, n, folded, proof) AS (
            {start}
            UNION ALL
            SELECT c.doc_id, c.leaf, c.tree, c.l + 1, c.place // 16, (c.n + 15) // 16, sha256({_BEFORE} || c.folded || {_AFTER}), c.proof || {_BEFORE} || {_AFTER}
            FROM {name} c JOIN {kids} k ON c.tree = k.tree AND c.l = k.l AND c.place // 16 = k.block WHERE c.n > 1
        )"""


def _levels(name: str, start: str) -> str:
    return f"""{name}(tree, l, rank, n, digest) AS (
            {start}
            UNION ALL
            SELECT tree, l + 1, rank // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank)) FROM {name} WHERE n > 1 GROUP BY tree, l, rank // 16, n
        ), {name}_kids AS (
            SELECT tree, l, rank // 16 AS block, list(digest ORDER BY rank) AS kids FROM {name} WHERE n > 1 GROUP BY ALL
        )"""


ORACLE: dict[str, str] = {
    "op7_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
                THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
            FROM w
        ), n AS (
            SELECT d.doc_id, count(s.shingle) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
        ), common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM common JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)
        ), reach AS (
            SELECT doc_id AS node, doc_id AS seen FROM documents
            UNION
            SELECT r.node, l.y FROM reach r JOIN links l ON r.seen = l.x
        )
        SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept
        FROM n JOIN reach ON node = n.doc_id GROUP BY n.doc_id, n.n""",
    "op8_licenses": f"""
        WITH t AS (
            SELECT license, string_split(trim(regexp_replace(lower(notice), '[^a-z0-9]+', ' ', 'g')), ' ') AS words
            FROM (VALUES {_NOTICES}) v(license, notice)
        ), r AS (SELECT doc_id, text, row_number() OVER () AS id FROM documents), l AS (
            SELECT doc_id, id, unnest(string_split(text, chr(10))) AS found, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM r
        ), larger AS (
            SELECT DISTINCT id, doc_id, 2 AS size, {_tidy('found')} AS found FROM (SELECT id, doc_id, unnest(string_split_regex(
                regexp_replace(text, '([.!?:])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '\\x01|\\n[ \\t\\r]*\\n')) AS found FROM r)
            UNION SELECT id, doc_id, 3, {_tidy('found')} FROM (SELECT id, doc_id, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) AS found FROM r)
            UNION SELECT id, doc_id, 4, {_tidy('text')} FROM r
            UNION SELECT id, doc_id, 1, {_tidy('found')} FROM l
        ), passages AS (
            SELECT id, doc_id, 'line' AS unit, line, found FROM l
            UNION ALL SELECT id, any_value(doc_id), ['sentence', 'paragraph', 'text'][min(size) - 1], 0, found FROM larger
            GROUP BY id, found HAVING min(size) > 1
        ), p AS (
            SELECT *, string_split(trim(regexp_replace(lower(found), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM passages
        ), b AS (
            SELECT id, unit, line, doc_id, found, {_bigrams('words')} AS pairs FROM p
        ), d AS (
            SELECT b.*, license, 2.0::DOUBLE * len(list_intersect(b.pairs, u.pairs)) / (len(b.pairs) + len(u.pairs)) AS dice
            FROM b JOIN (SELECT license, {_bigrams('words')} AS pairs FROM t) u
            ON len(b.pairs) BETWEEN len(u.pairs) * 0.59 AND len(u.pairs) / 0.59 AND len(list_intersect(b.pairs, u.pairs)) > 0
        )
        SELECT doc_id, unit, line::INTEGER AS line, license, dice, found FROM d WHERE dice >= {THRESHOLD}
        QUALIFY row_number() OVER (PARTITION BY id, unit, line, found ORDER BY dice DESC, license) = 1""",
    "op9_projections": """
        WITH RECURSIVE e AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.95
        ), reach AS (
            SELECT vec_id AS node, vec_id AS seen FROM embeddings
            UNION
            SELECT r.node, l.y FROM reach r JOIN links l ON r.seen = l.x
        ), c AS (
            SELECT node AS vec_id, min(seen) AS component_id FROM reach GROUP BY node
        )
        SELECT c.vec_id, (SELECT count(*) FROM links WHERE x = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c""",
    "op10_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
            FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op11_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, {_leaf('text')} AS leaf, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
                CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(_LOWER.format('text'))} END AS claim
            FROM documents
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM d
        ), {_levels('low', 'SELECT tree, 0, rank, n, leaf FROM p')}, s AS (
            SELECT tree, digest AS subroot, count(*) OVER () AS n FROM low WHERE n = 1
        ), {_levels('high', 'SELECT 0::BIGINT, 0, tree, n, subroot FROM s')}, {_climb('c1', "SELECT doc_id, leaf, tree, 0, rank, n, coalesce(claim, leaf), '' FROM p", 'low_kids')}, {_climb(
            'c2', "SELECT doc_id, leaf, 0::BIGINT, 0, tree, s.n, folded, proof FROM c1 JOIN s USING (tree) WHERE c1.n = 1", 'high_kids')}
        SELECT c2.doc_id, c2.leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
        FROM c2 JOIN (SELECT digest FROM high WHERE n = 1) ON c2.n = 1 JOIN p ON p.doc_id = c2.doc_id AND p.leaf = c2.leaf JOIN s ON s.tree = p.tree""",
    "op12_trie": f"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, ({_crc32('conv_id::VARCHAR')} % 4)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM t)
        ), r AS (
            SELECT c.conv_id, 0 AS part, t.pos, turn FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos < h
            UNION ALL
            SELECT c.conv_id, 1, t.pos, turn FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= h
        ), q AS (
            SELECT conv_id, coalesce(list(turn ORDER BY part, pos) FILTER (WHERE turn IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id
        ), p AS (
            SELECT conv_id, d, len(turns) = d AS ends, CASE WHEN d > 0 THEN turns[d].text END AS said, min(conv_id) OVER (PARTITION BY d, turns[1:d]) AS name
            FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM q)
        ), own AS (
            SELECT d, name, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended,
                CASE WHEN d > 0 THEN (count(*) - 1) * max(len(regexp_extract_all(said, '[^\\x20\\x09-\\x0D]+'))) ELSE 0 END AS saved
            FROM p GROUP BY d, name
        ), node AS (
            SELECT own.*, up.name AS parent, (SELECT count(*) FROM p k JOIN p o ON o.conv_id = k.conv_id AND o.d = own.d WHERE k.conv_id = k.name AND k.d = own.d + 1 AND o.name = own.name) AS kids
            FROM own LEFT JOIN p up ON up.conv_id = own.name AND up.d = own.d - 1
        ), total AS (
            SELECT p.d, p.name, count(*) FILTER (WHERE kids = 0) AS leaves, sum(saved) AS saved FROM node JOIN p ON p.conv_id = node.name AND p.d <= node.d GROUP BY p.d, p.name
        )
        SELECT node.name AS conv_id, node.d AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves::BIGINT AS n_leaves,
            total.saved::BIGINT AS saved_tokens, sha256(ended) AS ends_sha256
        FROM node JOIN total ON node.d = total.d AND node.name = total.name""",
    "op13_lines": f"""
        WITH l AS (
            SELECT doc_id, id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS found
            FROM (SELECT doc_id, row_number() OVER () AS id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
        ), k AS (
            SELECT *, {_LOWER.format("trim(found, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
        ), f AS (
            SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
        ), m AS (
            SELECT k.*, first IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN f USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(found, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY id, doc_id""",
}
