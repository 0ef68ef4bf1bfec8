"""DuckDB SQL of the numbered operators that SQL can express."""

from __future__ import annotations

from trendspark.llm.quality import RULES, STOP_WORDS


def _op3() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    fails = []
    for _, ratio, low, high in RULES:
        top, _, bottom = ratio.partition(" / ")
        r = f"({top}::DOUBLE / nullif({bottom}, 0))"
        fails += [f"coalesce({r} < {low}, false)"] if low is not None else []
        fails += [f"coalesce({r} > {high}, false)"] if high is not None else []
    word = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
gaps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM twice),
rep AS (SELECT doc_id, sum(n)::BIGINT AS n FROM gaps GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words,
             length(t) - length(replace(t, '!', '')) AS n_bangs,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_neighbour_repeats, len(l) AS n_lines,
             len(list_filter(l, lambda x: ltrim(x)[1] IN ('-', '*', '•'))) AS n_bullet_lines,
             len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis_lines
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {' OR '.join(fails)} AS failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept FROM b
"""


_OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_dot_product(a.v, b.v) >= 0.95 * a.n * b.n AND a.n > 0 AND b.n > 0),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, c.c = c.id AS kept FROM c LEFT JOIN n ON n.a = c.id
"""

# the CRC-32 of the decimal id, bit by bit; its last bit alone decides
_OP13 = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, *, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
         coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                     lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
e AS (SELECT row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t, head FROM d),
f AS (SELECT row, doc_id, source, leaf, sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS bent,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM e),
lv AS (SELECT source, 0 AS l, i, leaf AS h, n FROM f
       UNION ALL
       SELECT source, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY source, l, i // 3, n),
sub AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
top AS (SELECT 0 AS l, i, h, n FROM sub
        UNION ALL
        SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY l, i // 3, n),
height AS (SELECT source, max(l) AS t FROM lv GROUP BY source),
path AS (SELECT f.row, k.l, k.i, k.h, k.i < f.i // pow(3, k.l)::BIGINT AS before FROM f JOIN lv k
           ON k.source IS NOT DISTINCT FROM f.source AND k.n > 1 AND k.i // 3 = f.i // pow(3, k.l + 1)::BIGINT AND k.i <> f.i // pow(3, k.l)::BIGINT
         UNION ALL
         SELECT f.row, x.t + k.l, k.i, k.h, k.i < s.i // pow(3, k.l)::BIGINT FROM f JOIN sub s ON s.source IS NOT DISTINCT FROM f.source
           JOIN height x ON x.source IS NOT DISTINCT FROM f.source
           JOIN top k ON k.n > 1 AND k.i // 3 = s.i // pow(3, k.l + 1)::BIGINT AND k.i <> s.i // pow(3, k.l)::BIGINT),
sides AS (SELECT row, l, coalesce(string_agg(h, '' ORDER BY i) FILTER (before), '') AS a, coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT before), '') AS b
         FROM path GROUP BY row, l),
proof AS (SELECT row, string_agg(a || b, '' ORDER BY l) AS p FROM sides GROUP BY row),
fold AS (SELECT f.row, 0 AS l, bent AS h, x.t + (SELECT max(l) FROM top) AS high FROM f JOIN height x ON x.source IS NOT DISTINCT FROM f.source
         UNION ALL
         SELECT fold.row, fold.l + 1, sha256(concat(b.a, fold.h, b.b)), high FROM fold LEFT JOIN sides b ON b.row = fold.row AND b.l = fold.l WHERE fold.l < high),
root AS (SELECT h FROM top WHERE n = 1)
SELECT f.doc_id, f.leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(proof.p, '')) AS proof_sha256, fold.h AS folded_root, fold.h = root.h AS verified
FROM f JOIN sub ON sub.source IS NOT DISTINCT FROM f.source JOIN fold ON fold.row = f.row AND fold.l = fold.high CROSS JOIN root
LEFT JOIN proof ON proof.row = f.row
"""

ORACLE = {"op2_embedding_near_dedup": _OP2, "op3_quality_rules": _op3(), "op13_merkle_manifest": _OP13}
