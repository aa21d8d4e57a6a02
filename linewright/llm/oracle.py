"""DuckDB SQL for the operators that SQL can express: brute force over all rows."""

from __future__ import annotations

VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"

#: Reachability over links e(a, b): the least id that each id reaches.
ROOTS = "r(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS root FROM r GROUP BY a)"

TOP_K = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE {VALID}),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
 SELECT query_id, CAST(k AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 20"""

NEAR_VECTORS = f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
 v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE {VALID} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
 e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.9),
 n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a), {ROOTS}
 SELECT c.id AS vec_id, coalesce(n_links, 0) AS n_links, root AS component_id, c.id = root AS kept FROM c LEFT JOIN n ON n.a = c.id"""

NEAR_DOCUMENTS = rf"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
 w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}]+') AS w FROM documents WHERE text IS NOT NULL),
 t AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM w WHERE len(w) > 0),
 u AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM t),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared FROM u x JOIN u y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
 e AS (SELECT a, b, (shared = na AND shared = nb) AS same FROM p WHERE shared >= 0.8 * (na + nb - shared)),
 n AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE same) AS first FROM e GROUP BY a), {ROOTS}
 SELECT c.id AS doc_id, least(c.id, coalesce(first, c.id)) AS class_id, coalesce(n_links, 0) AS n_links, root AS component_id, c.id = root AS kept FROM c LEFT JOIN n ON n.a = c.id"""

MIX = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('9:' || doc_id) AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
 o AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * words / weight, source) AS k, sum(words) OVER () AS every FROM s),
 x AS (SELECT *, (every - 3 * coalesce(sum(words) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_over, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM o),
 -- the first source, by how soon it is full, whose share at the level of all that follow isn't above three times its size
 f AS (SELECT min(k) AS k FROM x WHERE left_over * weight / open_weight <= 3 * words),
 t AS (SELECT x.*, CASE WHEN x.k < coalesce(f.k, 1 << 40) THEN 3.0::DOUBLE * words ELSE (SELECT left_over FROM x y WHERE y.k = f.k) * weight / (SELECT open_weight FROM x y WHERE y.k = f.k) END AS target FROM x, f),
 q AS (SELECT *, least(CAST(round_even(target, 0) AS BIGINT), 3 * words) AS want FROM t),
 p AS (SELECT doc_id, size, h, words AS source_size, target, CASE WHEN words > 0 THEN want // words ELSE 1 END AS whole, CASE WHEN words > 0 THEN want % words ELSE 0 END AS rest, d.source,
   sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size) AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
 g AS (SELECT *, rest - coalesce(max(upto) FILTER (WHERE upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM p),
 c AS (SELECT source, arg_min(doc_id, (abs(size - gap), h, doc_id)) AS one FROM g WHERE upto > rest AND rest > 0 AND size > 0 AND abs(size - gap) < gap GROUP BY source)
 SELECT g.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * least(3, whole + CASE WHEN rest = 0 THEN 0 WHEN upto <= rest OR g.doc_id IS NOT DISTINCT FROM one THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM g LEFT JOIN c ON g.source IS NOT DISTINCT FROM c.source"""


def url_verdicts(rules: list[tuple[str, str, str]], depth: int = 4, differs: float = 2.0, prior_weight: float = 2.0, reject_at: float = 0.7) -> str:
    """The template tree level by level, as common table expressions."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in longest)
    blocked = " ".join(f"WHEN rule = '{h}{p}' THEN {int(a == 'block')}" for a, h, p in rules)
    sql = f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 g AS (SELECT *, CASE {fits} END AS rule FROM h),
 t0 AS (SELECT *, CASE {blocked} END AS blocked, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts, '' AS template FROM g)"""
    for k in range(depth):
        sql += f""",
 b{k} AS (SELECT host, template, parts[{k + 1}] AS part, count(*) AS n, count(blocked) AS l, coalesce(sum(blocked), 0) AS b FROM t{k} WHERE len(parts) > {k} GROUP BY ALL),
 n{k} AS (SELECT host, template, sum(n) AS nn, sum(l) AS nl, sum(b) AS nb FROM b{k} GROUP BY ALL),
 k{k} AS (SELECT host, template, part, l, (n < nn AND abs(l / n - (nl - l) / (nn - n)) > {differs} * sqrt(nl / nn * (1 - nl / nn) * (1.0::DOUBLE / n + 1.0::DOUBLE / (nn - n))))
   OR (l > 0 AND l < nl AND abs(b / l - (nb - b) / (nl - l)) > {differs} * sqrt(nb / nl * (1 - nb / nl) * (1.0::DOUBLE / l + 1.0::DOUBLE / (nl - l)))) AS stays FROM b{k} JOIN n{k} USING (host, template)),
 t{k + 1} AS (SELECT t.* EXCLUDE (template), t.template || CASE WHEN len(parts) <= {k} THEN '' WHEN k.stays THEN '/' || k.part WHEN k.l > 0 THEN '/+' ELSE '/*' END AS template FROM t{k} t LEFT JOIN k{k} k ON k.host = t.host AND k.template = t.template AND k.part = t.parts[{k + 1}])"""
    return f"""{sql},
 f AS (SELECT * EXCLUDE (template), template || CASE WHEN len(parts) > {depth} THEN '/**' ELSE '' END AS template FROM t{depth}),
 q AS (SELECT host, template, round((sum(blocked) + {prior_weight}::DOUBLE * (SELECT coalesce(avg(blocked), 0) FROM f)) / (count(*) + {prior_weight}::DOUBLE), 6) AS purity FROM f WHERE blocked IS NOT NULL GROUP BY ALL)
 SELECT page_id, f.host, path, rule, f.template, coalesce(purity, 0.0::DOUBLE) AS purity, CASE WHEN blocked = 1 THEN 'block' WHEN blocked = 0 THEN 'allow' WHEN coalesce(purity, 0) >= {reject_at} THEN 'block' ELSE 'allow' END AS verdict
 FROM f LEFT JOIN q ON q.host = f.host AND q.template = f.template"""


FILL_IN_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 k AS (SELECT *, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || substring(h, 8 * i + 1, 8) AS BIGINT)) AS g FROM d),
 c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 100 THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
 p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

# crc32 by its polynomial, bit by bit; runs are islands of words that agree at a distance
PERIODIC_RUNS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: ascii(c)::BIGINT)), lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM documents),
 g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM d),
 p AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) AS w FROM g),
 u AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM p),
 e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
 k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
 s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)),
 r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND s.q % t.q = 0 AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
 x AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
 c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM u ANTI JOIN x USING (doc_id, i) GROUP BY doc_id),
 b AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'q': q}, (-length, start, q)) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS shown FROM r GROUP BY doc_id)
 SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli, sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
 FROM p LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""
