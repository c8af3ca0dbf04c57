"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_WORDS = f"""w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
 spot AS (SELECT r, doc_id, unnest(range(1, len(ws) + 1)) AS i FROM w)"""


def _covered(name: str, size: int) -> str:
    """Words in windows of ``size`` words that occur again in the same text."""
    return f"""g{name} AS (SELECT spot.r, i, array_to_string(list_slice(ws, i, i + {size - 1}), ' ') AS g FROM spot JOIN w USING (r) WHERE i + {size - 1} <= len(ws)),
 a{name} AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g{name}) WHERE n > 1),
 {name} AS (SELECT r, count(DISTINCT i + k) AS n FROM a{name}, range({size}) d(k) GROUP BY r)"""


def repetition(min_words: int, max_covered: float, max_repeat: int) -> str:
    longest = max_repeat + 1
    return f"""WITH {_WORDS}, {_covered('three', 3)}, {_covered('cover', min_words)},
 glong AS (SELECT spot.r, md5(array_to_string(list_slice(ws, i, i + {longest - 1}), ' ')) AS g FROM spot JOIN w USING (r) WHERE i + {longest - 1} <= len(ws)),
 long AS (SELECT DISTINCT r FROM (SELECT r, g FROM glong GROUP BY r, g HAVING count(*) > 1)),
 lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
 m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(three.n, 0)::BIGINT AS n_repeat_words, coalesce(cover.n, 0) AS covered, long.r IS NOT NULL AS is_long
 FROM w JOIN lines USING (r) LEFT JOIN three USING (r) LEFT JOIN cover USING (r) LEFT JOIN long USING (r)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered <= {max_covered} * n_words AND NOT is_long AS kept FROM b"""


def passages(window: int) -> str:
    return f"""WITH {_WORDS}, g AS (SELECT spot.r, i, array_to_string(list_slice(ws, i, i + {window - 1}), ' ') AS g FROM spot JOIN w USING (r) WHERE i + {window - 1} <= len(ws)),
 a AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
 gone AS (SELECT DISTINCT r, i + k AS i FROM a, range({window}) d(k)),
 kept AS (SELECT spot.r, string_agg(ws[spot.i], ' ' ORDER BY spot.i) AS kept, count(*) AS n FROM spot JOIN w USING (r) ANTI JOIN gone ON gone.r = spot.r AND gone.i = spot.i GROUP BY spot.r)
 SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""


def mix(weights: tuple[int, ...], most: int) -> str:
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS digest FROM documents),
 per AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} {weight} END::DOUBLE AS weight FROM d GROUP BY source),
 share AS (SELECT *, ({most} * source_size)::DOUBLE AS cap, (sum(source_size) OVER () - coalesce(sum({most} * source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS share
 FROM per WINDOW o AS (ORDER BY {most} * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 goal AS (SELECT source, source_size, least(cap, max(CASE WHEN share <= cap / weight THEN share END) OVER () * weight) AS target FROM share),
 full_ AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM goal),
 groups AS (SELECT source, digest, sum(size) AS size FROM d GROUP BY source, digest),
 run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY digest) AS after FROM groups),
 drawn AS (SELECT run.source, digest, passes + (target - passes * source_size > 0 AND 2 * after - size < 2 * (target - passes * source_size))::BIGINT AS times FROM run JOIN full_ ON run.source IS NOT DISTINCT FROM full_.source)
 SELECT doc_id, d.size, source_size, target, d.size * times AS taken FROM d JOIN full_ ON d.source IS NOT DISTINCT FROM full_.source JOIN drawn ON d.source IS NOT DISTINCT FROM drawn.source AND d.digest = drawn.digest"""


def near_vectors(cosine: float) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 sound AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {cosine}),
 reach(a, b) AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b),
 far AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
 SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(far.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(far.b, vec_id)) AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN far ON far.a = vec_id"""


def clusters(dim: int, scale: int, centres: int, rounds: int, seed: int) -> str:
    """Rounds of plain assignment, one after another, in whole numbers."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT r, num, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM v, c{k}),
 a{k} AS MATERIALIZED (SELECT r, min_by(num, struct_pack(d := d, num := num)) AS cluster, min(d) AS d FROM d{k} GROUP BY r)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT cluster, i, sum(x[i]::BIGINT)::BIGINT AS s, count(*) AS n FROM v JOIN a{k} USING (r), range(1, {dim + 1}) t(i) GROUP BY cluster, i),
 m{k} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s{k} GROUP BY cluster),
 c{k + 1} AS MATERIALIZED (SELECT num, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON cluster = num)""")
    return f"""WITH sound AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)) AS x FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), v AS MATERIALIZED (SELECT * FROM sound),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS num, x AS c FROM v WHERE vec_id IS NOT NULL ORDER BY num LIMIT {centres}),
 {", ".join(steps)}
 SELECT vec_id, cluster::INT AS cluster, d::BIGINT AS distance, sum(d::BIGINT) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d::BIGINT) OVER ()::BIGINT AS inertia,
 sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (r) JOIN c{rounds} ON cluster = num"""
