"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from callgauge.llm import lines, lm, shards

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_LETTERS = " || ".join(
    f"substr('{_BASE32}', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31)"
    "::INT, 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)

_UNSEEN = "|".join([*(rf"<{e}\b.*?</{e}>" for e in lines.UNSEEN), "<!--.*?-->"])
_BLOCKS = "|".join(lines.BLOCKS)



def _crc_table() -> list[int]:
    found = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 * (value & 1))
        found.append(value)
    return found


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes."""
    data = f"regexp_extract_all(hex(encode({text})), '..')"
    numbers = f"list_transform({data}, lambda x: ('0x' || x)::BIGINT)"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}),
        lambda c, b: xor(c >> 8, {_crc_table()}[1 + (xor(c, b) & 255)]::BIGINT)), 4294967295)"""


def _feistel(rows: str) -> str:
    """One pass of the network over (start, v, n): (start, v, n)."""
    half = f"""SELECT start, n, bits // 2 AS a, bits - bits // 2 AS b,
        v >> (bits - bits // 2) AS l, v & ((1::BIGINT << (bits - bits // 2)) - 1) AS r
        FROM (SELECT *, greatest(2, length(bin(n - 1))) AS bits FROM ({rows}))"""
    mask = shards.MASK
    for key in shards.round_keys(shards.SEED):
        half = f"""SELECT start, n, b AS a, a AS b, r AS l,
            (l + xor(z, z >> 15)) & ((1::BIGINT << a) - 1) AS r FROM (
            SELECT *, (xor(y, y >> 12) * {shards.MIX_B}) & {mask} AS z FROM (
            SELECT *, (xor(x, x >> 15) * {shards.MIX_A}) & {mask} AS y FROM (
            SELECT *, (r + {key}) & {mask} AS x FROM ({half}))))"""
    return f"SELECT start, (l << b) | r AS v, n FROM ({half})"


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column} END"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _line_dedup(min_pages: int, min_seen: int) -> str:
    return rf"""
    WITH texts AS (
        SELECT page_id,
            coalesce(regexp_extract(lower(url),
                '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host,
            regexp_replace(regexp_replace(regexp_replace(
                regexp_replace(coalesce(html, ''), '(?is){_UNSEEN}', ' ', 'g'),
                '[\r\n]', ' ', 'g'),
                '(?i)</?(?:{_BLOCKS})\b[^>]*>', chr(10), 'g'),
                '<[^>]*>', '', 'g') AS text
        FROM pages
    ), split AS (
        SELECT page_id, host, list_filter(
            list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
        FROM texts
    ), totals AS (
        SELECT host, count(*) AS pages FROM split GROUP BY host
    ), common AS (
        SELECT l.host, list(l.line) AS common
        FROM (SELECT host, line, count(*) AS n FROM
                (SELECT host, unnest(list_distinct(lines)) AS line FROM split)
              GROUP BY host, line) l
        JOIN totals t ON t.host = l.host
        WHERE t.pages >= {min_pages} AND l.n >= {min_seen} AND l.n > t.pages * {lines.MAX_RATIO}::DOUBLE
        GROUP BY l.host
    ), kept AS (
        SELECT page_id, split.host, len(lines) AS n_lines, list_filter(lines,
            lambda x: NOT list_contains(coalesce(common, []), x)) AS kept
        FROM split LEFT JOIN common ON common.host = split.host
    )
    SELECT page_id, host, n_lines, n_lines - len(kept) AS n_dropped,
        coalesce(array_to_string(kept, chr(10)), '') AS text
    FROM kept"""


ORACLES = {
    "op1_warc_chain": f"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
            SELECT page_id, strlen(body) AS payload_bytes, {_LETTERS} AS payload_digest,
                max(page_id) OVER (PARTITION BY body) AS last
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to
        FROM d""",
    "op2_line_dedup": _line_dedup(lines.MIN_PAGES, 1),
    "op2_line_dedup_small_hosts": _line_dedup(2, 2),
    "op6_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'))
                AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_lm_score": rf"""
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), t AS (
            SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w
        ), g AS (
            SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t
        ), c AS (
            SELECT g.*, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n,
                count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY w, doc_id) AS c1,
                count(*) OVER (PARTITION BY v, w)
                    - count(*) OVER (PARTITION BY v, w, doc_id) AS c2
            FROM g
        ), s AS (
            SELECT doc_id, i, v, c1, c2,
                lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS cv,
                ln(greatest(c1, 1) / greatest(n, 1)) AS uni
            FROM c
        ), d AS (
            SELECT doc_id, count(*) AS n_words,
                count(*) FILTER (WHERE v IS NOT NULL AND c2 = 0) AS n_backoff,
                sum(CASE WHEN v IS NULL THEN uni WHEN c2 > 0 THEN ln(c2 / cv)
                    ELSE uni + ln({lm.BACKOFF}) END) AS log_score
            FROM s GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff,
            round(coalesce(log_score, 0), 4) AS log_score,
            round(log_score / n_words, 6) AS mean_log_score
        FROM w LEFT JOIN d USING (doc_id)""",
    "op10_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding,
                lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20""",
    "op11_feistel_shards": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
                {_crc32("coalesce(text, '')")} AS text_crc32
            FROM documents
        ), numbers AS (
            SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS start,
                count(*) OVER () AS n
            FROM d
        ), walk AS (
            {_feistel("SELECT start, start AS v, n FROM numbers")}
            UNION ALL
            {_feistel("SELECT * FROM walk WHERE v >= n")}
        )
        SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {shards.SHARDS})::INT AS shard,
            v // {shards.SHARDS} AS slot, NULL::INT AS grown_shard
        FROM numbers JOIN (SELECT start, v FROM walk WHERE v < n) USING (start)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
                CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")}
                    ELSE {_leaf("n_chars")} END AS now
            FROM documents
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                count(*) OVER (PARTITION BY lang) AS n
            FROM d
        ), lower_nodes AS (
            SELECT 0 AS lvl, lang, pos, n, leaf AS h FROM leaves
            UNION ALL
            SELECT lvl + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
            FROM lower_nodes WHERE n > 1 GROUP BY lvl, lang, pos // 2, n
        ), subroots AS (
            SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
                count(*) OVER () AS n
            FROM lower_nodes WHERE n = 1
        ), upper_nodes AS (
            SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
            FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 2, n
        ), sides AS (
            SELECT l.lang, l.pos, x.lvl, (l.pos >> x.lvl) % 2 AS slot, coalesce(x2.h, '') AS sibling
            FROM leaves l
            JOIN lower_nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.n > 1
                AND x.pos = l.pos >> x.lvl
            LEFT JOIN lower_nodes x2 ON x2.lang IS NOT DISTINCT FROM x.lang AND x2.lvl = x.lvl
                AND x2.pos = xor(x.pos, 1)
            UNION ALL
            SELECT l.lang, l.pos, 100 + x.lvl, x.pos % 2, coalesce(x2.h, '')
            FROM leaves l
            JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
            JOIN upper_nodes x ON x.n > 1 AND x.pos = s.pos >> x.lvl
            LEFT JOIN upper_nodes x2 ON x2.lvl = x.lvl AND x2.pos = xor(x.pos, 1)
        ), path AS (
            SELECT lang, pos, list(slot ORDER BY lvl) AS slots, list(sibling ORDER BY lvl) AS siblings
            FROM sides GROUP BY lang, pos
        ), fold AS (
            SELECT 0 AS i, l.lang, l.pos, coalesce(p.slots, []) AS slots,
                coalesce(p.siblings, []) AS siblings, l.now AS h
            FROM leaves l LEFT JOIN path p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
            UNION ALL
            SELECT i + 1, lang, pos, slots, siblings,
                sha256(CASE WHEN slots[i + 1] = 1 THEN siblings[i + 1] || h ELSE h || siblings[i + 1] END)
            FROM fold WHERE i < len(slots)
        ), top AS (
            SELECT h AS root FROM upper_nodes WHERE n = 1
        )
        SELECT l.doc_id, l.leaf, s.subroot, root,
            sha256(coalesce(array_to_string(f.siblings, ''), '')) AS proof_sha256,
            f.h AS folded_root, f.h = root AS verified
        FROM leaves l
        JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
        JOIN fold f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos AND f.i = len(f.slots)
        CROSS JOIN top""",
}
