"""SQL counterparts of the corpus queries that SQL can express, written from the rules."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH sized AS (
    SELECT doc_id, source, coalesce(text, '') AS t, len({_WORDS}) AS size FROM documents
), leveled AS (
    SELECT *, CASE WHEN length(t) / greatest(size, 1)::DOUBLE BETWEEN 4 AND 11 THEN 1.0 ELSE 0.5 END AS level,
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS draw
    FROM sized
), sources AS (
    SELECT source, sum(size)::DOUBLE AS total FROM leveled GROUP BY source
), weighted AS (
    SELECT source, total, 2 * total AS cap, 1.5 * sum(total) OVER () AS budget,
        [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3]::DOUBLE AS weight
    FROM sources
), levels AS (
    SELECT a.source, a.cap, a.weight, a.total, (any_value(a.budget)
            - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0))
            / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS lift
    FROM weighted a CROSS JOIN weighted b GROUP BY ALL
), targets AS (
    SELECT source, total, least(cap, weight * (SELECT max(lift) FROM levels WHERE cap >= lift * weight)) AS target
    FROM levels
), placed AS (
    SELECT l.doc_id, l.size, t.total, t.target,
        CASE WHEN t.total > 0 THEN floor(t.target / t.total) ELSE 0 END AS epochs,
        coalesce(sum(l.size) OVER (PARTITION BY l.source ORDER BY -ln(draw) / level, l.size, l.doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM leveled l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, total::BIGINT AS source_size, target,
    (size * (epochs + CASE WHEN target - epochs * total > 0 AND before + size / 2.0 <= target - epochs * total
        THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

OP6 = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), places AS (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM texts)
), repeated AS (
    SELECT r, count(DISTINCT p) AS n
    FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (
        SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM places) WHERE times > 1)
    GROUP BY r
), lines AS (
    SELECT r, count(*) - count(DISTINCT line) AS n
    FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), facts AS (
    SELECT doc_id, source, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
    FROM texts LEFT JOIN lines l USING (r) LEFT JOIN repeated p USING (r)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts
), hosts AS (
    SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f
    FROM judged WHERE source IS NOT NULL GROUP BY source
), means AS (
    SELECT count(*) AS hosts, sum(n) AS n, sum(f) AS f, sum(f * f / n) AS squares, (sum(f) + 0.5) / (sum(n) + 1) AS mean
    FROM hosts
), prior AS (
    SELECT mean, least(greatest(mean * (1 - mean) / greatest(
        (squares - 2 * mean * f + mean * mean * n - mean * (1 - mean) * hosts) / n, 1e-9) - 1, 2), 1e6) AS strength
    FROM means
), bad AS (
    SELECT source FROM hosts, prior WHERE (f + mean * strength) / (n + strength) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM judged
"""

OP8 = rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), grams AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
    FROM texts
), sets AS MATERIALIZED (
    SELECT *, list_sort(g) AS key FROM grams
), classes AS MATERIALIZED (
    SELECT key, min(doc_id) AS c, any_value(len(g)) AS n FROM sets WHERE len(g) > 0 GROUP BY key
), one AS MATERIALIZED (
    SELECT c, n, unnest(key) AS x FROM classes
), pairs AS (
    SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
    FROM one a JOIN one b ON a.x = b.x AND a.c < b.c GROUP BY 1, 2
), links AS MATERIALIZED (
    SELECT a, b FROM pairs WHERE 100 * common >= 85 * (na + nb - common)
), sides AS MATERIALIZED (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
    SELECT c AS node, c AS root FROM classes
    UNION SELECT s.b, r.root FROM reach r JOIN sides s ON s.a = r.node
), roots AS (
    SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes k ON k.key = s.key LEFT JOIN roots r ON r.node = k.c
"""



def _code(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_code(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, first: str) -> str:
    """Nodes of trees of degree three, level by level, from rows (tree, level, idx, width, digest)."""
    return f"""{name} AS (
    {first}
    UNION ALL
    SELECT tree, level + 1, idx // 3, any_value((width + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx))
    FROM {name} WHERE width > 1 GROUP BY tree, level, idx // 3
)"""


def _steps(rows: str, nodes: str, base: int) -> str:
    """Siblings left and right of each row's node at each level."""
    return f"""
    SELECT l.r, {base} + o.level AS step, string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < o.idx) AS before,
        string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > o.idx) AS after
    FROM {rows} l
    JOIN {nodes} o ON o.tree = l.tree AND o.width > 1 AND o.idx = l.idx // (3 ** o.level)::BIGINT
    JOIN {nodes} u ON u.tree = o.tree AND u.level = o.level AND u.idx // 3 = o.idx // 3
    GROUP BY l.r, o.level"""


_CLAIMED = "CASE WHEN even THEN replace(text, chr(10), '') ELSE text END"

OP13 = f"""
WITH RECURSIVE bits AS (
    SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256))::BIGINT AS i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), rows AS (
    SELECT row_number() OVER () AS r, d.*, doc_id IS NOT NULL AND (xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 2 = 0) AS even
    FROM documents d, crc
), digests AS (
    SELECT r, doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree,
        {_leaf("text")} AS leaf, {_leaf("(" + _CLAIMED + ")")} AS claimed
    FROM rows
), leaves AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        count(*) OVER (PARTITION BY tree) AS n FROM digests
), {_levels("up", "SELECT tree, 0 AS level, idx, n AS width, leaf AS digest FROM leaves")}, trees AS (
    SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS sources
    FROM up WHERE width = 1
), {_levels("top", "SELECT '' AS tree, 0 AS level, place AS idx, sources AS width, subroot AS digest FROM trees")}, docs AS (
    SELECT l.r, '' AS tree, t.place AS idx FROM leaves l JOIN trees t USING (tree)
), steps AS ({_steps("leaves", "up", 0)}
    UNION ALL {_steps("docs", "top", 1000)}
), paths AS (
    SELECT r, list(coalesce(before, '') || '|' || coalesce(after, '') ORDER BY step) AS path,
        string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY step) AS proof
    FROM steps GROUP BY r
), folded AS (
    SELECT l.doc_id, l.leaf, t.subroot, (SELECT digest FROM top WHERE width = 1) AS root,
        sha256(coalesce(p.proof, '')) AS proof_sha256, list_reduce(list_prepend(l.claimed, coalesce(p.path, [])),
            lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root
    FROM leaves l JOIN trees t USING (tree) LEFT JOIN paths p USING (r)
)
SELECT *, folded_root = root AS verified FROM folded
"""

ORACLE: dict[str, str] = {"op3_mixing": OP3, "op6_quality_rules": OP6, "op8_ngram_jaccard": OP8, "op13_merkle_manifest": OP13}
