"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from . import ann, divergence, langid, mixing, packing, repair, sharding, simhash, sketch, substring, toxicity, warc, wrapper

QUERIES = {
    "op1_permutation_index": ann.op1,
    "op2_wrapper_induction": wrapper.op2,
    "op3_simhash": simhash.op3,
    "op4_threshold_sketch": sketch.op4,
    "op5_hash_tree": sharding.op5,
    "op6_soft_mixing": mixing.op6,
    "op7_cross_parsing": langid.op7,
    "op8_seekable_warc": warc.op8,
    "op9_suffix_trees": substring.op9,
    "op10_best_fit": packing.op10,
    "op11_dial_repair": repair.op11,
    "op12_term_blocks": divergence.op12,
    "op13_noisy_channel": toxicity.op13,
}

ORACLES = {
    "op8_seekable_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
        f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
        SELECT page_id, n AS payload_bytes, d.h AS payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM d LEFT JOIN f ON d.h = f.h""",
    "op9_suffix_trees": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
        s AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM i),
        f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM s JOIN f USING (s) WHERE first < doc_id),
        x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
        k AS (SELECT x.doc_id, count(g.j) AS gone, coalesce(string_agg(word, ' ' ORDER BY x.j) FILTER (WHERE g.j IS NULL), '') AS kept
              FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.j = g.j GROUP BY x.doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op11_dial_repair": r"""
        WITH RECURSIVE r AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        c AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, 8 * length(k)), lambda j: ((ascii(k[j // 8 + 1]) >> (j % 8)::INTEGER) & 1)::BIGINT),
                                        lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 20 AS h FROM r),
        d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
                     CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE h <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, rtrim(text, E' \t\n\x0b\x0c\r') AS t,
                     lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM o),
        f AS (SELECT *, left(role, 1) AS ini, CASE WHEN t = '' THEN 'b' WHEN again THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM w),
        ins(q, p, n, lines) AS (VALUES ('0', '0', 0, ''), ('0', 'U', 1, E'user:\n'), ('0', 'A', 2, E'user:\nassistant:\n'), ('S', 'S', 0, ''), ('S', 'U', 1, E'user:\n'),
          ('S', 'A', 2, E'user:\nassistant:\n'), ('U', 'U', 0, ''), ('U', 'A', 1, E'assistant:\n'), ('A', 'A', 0, ''), ('A', 'U', 1, E'user:\n')),
        act(q, ini, p, letter, cost) AS (VALUES ('0', '', '0', 'D', 2), ('S', '', 'S', 'D', 2), ('U', '', 'U', 'D', 2), ('A', '', 'A', 'D', 2),
          ('0', 's', 'S', 'K', 0), ('0', 'u', 'U', 'K', 0), ('S', 'u', 'U', 'K', 0), ('A', 'u', 'U', 'K', 0), ('U', 'a', 'A', 'K', 0),
          ('0', '', 'U', 'R', 1), ('S', '', 'U', 'R', 1), ('A', '', 'U', 'R', 1), ('U', '', 'A', 'R', 1)),
        path AS (
          SELECT DISTINCT conv_id, 0::BIGINT AS i, '0' AS q, 0::BIGINT AS cost, '' AS audit, '' AS body FROM f
          UNION ALL
          SELECT conv_id, i, q, cost, audit, body FROM (
            SELECT f.conv_id, f.i, act.p AS q, path.cost + 5 * n + act.cost + CASE WHEN letter <> 'D' AND fault = 't' THEN 5 ELSE 0 END AS cost,
                   audit || repeat('I', n) || letter AS audit,
                   body || lines || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || E'\n'
                                                ELSE CASE act.p WHEN 'U' THEN 'user:' ELSE 'assistant:' END || text || E'\n' END AS body
            FROM path JOIN f ON f.conv_id IS NOT DISTINCT FROM path.conv_id AND f.i = path.i + 1 JOIN ins ON ins.q = path.q
            JOIN act ON act.q = ins.p AND (letter = 'D' OR fault NOT IN ('b', 'd') AND (letter = 'R' OR act.ini = f.ini)))
          QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
        s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                     count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        best AS (SELECT s.conv_id, cost + 5 * ins.n AS cost, audit || repeat('I', ins.n) AS audit, body || lines AS body
                 FROM s JOIN path ON path.conv_id IS NOT DISTINCT FROM s.conv_id AND path.i = s.n JOIN ins ON ins.q = path.q AND ins.p IN ('0', 'A')
                 QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY path.cost + 5 * ins.n, audit || repeat('I', ins.n)) = 1),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(body, length(body) - 1), '')) AS repaired_sha256
        FROM ids LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id""",
    "op12_term_blocks": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
        k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 10),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang)
              LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM x JOIN v USING (lang)),
        l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM x GROUP BY ALL),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM l JOIN v USING (lang)),
        pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        s AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN f USING (lang, source, item)
              UNION ALL
              SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM s
        QUALIFY part = 'pair' OR rank <= 10""",
}
