"""What the queries return, in SQL for DuckDB, where SQL has a form for it."""

from __future__ import annotations

OP1 = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)
, win AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w))
, rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS lo FROM win) WHERE lo < doc_id)
, gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM rep)
, words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w)
, kept AS (SELECT words.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS kept
           FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

OP9 = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages)
, h AS (SELECT page_id, strlen(payload) AS payload_bytes, min(page_id) OVER (PARTITION BY payload) AS first,
        array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101',
                        '1110','1111'][strpos('0123456789abcdef', sha1(payload)[i])]), '') AS bits FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(list_sum(list_transform(range(1, 6),
                       lambda j: CASE WHEN bits[5 * i + j] = '1' THEN 1 << (5 - j) ELSE 0 END)) AS INTEGER)]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: crc32 of the ASCII text ``s``, bit by bit.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),"
       " lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)")
OP12 = f"""WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s, {_leaf('n_chars')} AS leaf, {_leaf('n_chars + 1')} AS other FROM documents)
, l AS (SELECT doc_id, coalesce('=' || lang, '') AS g, leaf, CASE WHEN s IS NOT NULL AND n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN other ELSE leaf END AS shown,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d)
, t AS (SELECT g, 0 AS lvl, pos, leaf AS node, n FROM l
        UNION ALL SELECT g, lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, lvl, pos // 2, n)
, sub AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1)
, u AS (SELECT 0 AS lvl, pos, node, n FROM sub
        UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n)
, steps AS (SELECT l.g, l.pos AS leaf_pos, x.lvl AS step, (l.pos >> x.lvl) % 2 AS odd, y.node AS sib
            FROM l JOIN (SELECT DISTINCT g, lvl FROM t WHERE n > 1) x ON x.g = l.g
            LEFT JOIN t y ON y.g = l.g AND y.lvl = x.lvl AND y.pos = xor(l.pos >> x.lvl, 1)
            UNION ALL SELECT l.g, l.pos, 1000 + x.lvl, (sub.pos >> x.lvl) % 2, y.node
            FROM l JOIN sub ON sub.g = l.g CROSS JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) x LEFT JOIN u y ON y.lvl = x.lvl AND y.pos = xor(sub.pos >> x.lvl, 1))
, path AS (SELECT *, row_number() OVER (PARTITION BY g, leaf_pos ORDER BY step) AS k FROM steps)
, fold AS (SELECT g, pos, 0 AS k, shown AS node FROM l
           UNION ALL SELECT fold.g, fold.pos, path.k, sha256(CASE WHEN sib IS NULL THEN node WHEN odd = 1 THEN sib || node ELSE node || sib END)
           FROM fold JOIN path ON path.g = fold.g AND path.leaf_pos = fold.pos AND path.k = fold.k + 1)
, proof AS (SELECT g, leaf_pos, string_agg(sib, '' ORDER BY k) AS sibs FROM path GROUP BY g, leaf_pos)
, top AS (SELECT g, pos, arg_max(node, k) AS node FROM fold GROUP BY g, pos)
SELECT l.doc_id, l.leaf, sub.node AS subroot, r.node AS root, sha256(coalesce(p.sibs, '')) AS proof_sha256, top.node AS folded_root, top.node = r.node AS verified, l.pos AS position
FROM l JOIN sub ON sub.g = l.g JOIN (SELECT node FROM u WHERE n = 1) r ON true LEFT JOIN proof p ON p.g = l.g AND p.leaf_pos = l.pos
JOIN top ON top.g = l.g AND top.pos = l.pos"""

#: One row of a conversation at a time: the cheapest (cost, audit, turns) to each state (0 start, 1 after system, 2 after user,
#: 3 after assistant), with the insertions before a row, and those behind the last.
OP11 = rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations)
, k AS (SELECT *, {_CRC} % 20 AS kind FROM c)
, rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k)
, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS later,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM rows_)
, f AS (SELECT *, CASE WHEN final = '' THEN 'b' WHEN later THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM o)
, ins(p, q, cost, audit, said) AS (VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', 'user:' || chr(10)), (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
        (1, 1, 0, '', ''), (1, 2, 2, 'I', 'user:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
        (2, 2, 0, '', ''), (2, 3, 2, 'I', 'assistant:' || chr(10)), (3, 2, 2, 'I', 'user:' || chr(10)), (3, 3, 0, '', ''))
, go(initial, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3))
, edits AS (SELECT conv_id, i, z.p AS p, z.p AS q, 3 AS cost, 'D' AS audit, '' AS said FROM f CROSS JOIN (VALUES (0), (1), (2), (3)) z(p)
        UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = 't' THEN 1 ELSE 0 END, 'K', role || ':' || text || chr(10)
        FROM f JOIN go ON initial = role[1] WHERE fault IN ('', 't')
        UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = 't' THEN 3 ELSE 2 END, 'R', CASE initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10)
        FROM f JOIN go ON initial IN ('u', 'a') WHERE fault IN ('', 't'))
, best AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': 0, 'audit': '', 'said': ''}} AS b FROM f
        UNION ALL SELECT x.conv_id, x.i + 1, e.q,
        min({{'cost': x.b.cost + ins.cost + e.cost, 'audit': x.b.audit || ins.audit || e.audit, 'said': x.b.said || ins.said || e.said}})
        FROM best x JOIN ins ON ins.p = x.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM x.conv_id AND e.i = x.i + 1 AND e.p = ins.q
        GROUP BY x.conv_id, x.i, e.q)
, done AS (SELECT x.conv_id, min({{'cost': x.b.cost + ins.cost, 'audit': x.b.audit || ins.audit, 'said': x.b.said || ins.said}}) AS b
        FROM best x JOIN ins ON ins.p = x.q AND ins.q IN (0, 3) JOIN (SELECT DISTINCT conv_id, n FROM f) m ON m.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = m.n
        GROUP BY x.conv_id)
, facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CASE WHEN fault = 'b' THEN 1 ELSE 0 END) AS blank,
        sum(CASE WHEN fault = 'd' THEN 1 ELSE 0 END) AS duplicate, sum(CASE WHEN fault = 't' THEN 1 ELSE 0 END) AS truncated,
        sum(CASE WHEN i > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(done.b.cost, 0) AS BIGINT) AS cost,
       coalesce(done.b.audit, '') AS audit, sha256(coalesce(CASE WHEN done.b.said = '' THEN '' ELSE left(done.b.said, length(done.b.said) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id"""
