"""The same answers as SQL over the given tables, where SQL can express them. Joins there are brute force."""

_REACH = """
, both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links)
, reach AS (SELECT x, y FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
, least AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
, degree AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
"""

OP6 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents)
, s AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                               WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM w))
, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
, common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL)
, links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * k >= 8 * (a.n + b.n - k))
{_REACH}
SELECT d.doc_id, least(d.doc_id, coalesce(low, d.doc_id)) AS class_id, coalesce(degree.n, 0) AS n_links
FROM documents d LEFT JOIN least ON least.x = d.doc_id LEFT JOIN degree ON degree.x = d.doc_id
"""

OP7 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)
, links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93)
{_REACH}
SELECT e.vec_id, coalesce(degree.n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least ON least.x = e.vec_id LEFT JOIN degree ON degree.x = e.vec_id
"""

OP8 = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
, t AS (SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS core FROM l)
, f AS (SELECT core FROM t WHERE core <> '' GROUP BY core HAVING count(DISTINCT coalesce(source, '')) >= 10)
, h AS (SELECT t.*, f.core IS NOT NULL AS hit FROM t LEFT JOIN f ON t.core = f.core)
, d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS hits, count(*) FILTER (core <> '') > count(*) FILTER (hit) AS own,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS rest
  FROM h GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN own AND hits > 0 THEN rest ELSE text END AS text, coalesce(n_lines, 0) AS n_lines,
       CASE WHEN own THEN hits ELSE 0 END AS n_removed
FROM documents LEFT JOIN d USING (doc_id)
"""


OP11 = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)
, g AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: sha256(array_to_string(w[i:i + 49], ' ')))) AS g
        FROM t WHERE len(w) >= 50)
, low AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g)
, hit AS (SELECT doc_id, i FROM g JOIN low USING (g) WHERE doc_id > low)
, gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY doc_id)
, left_over AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, array_to_string(list_filter(w, lambda x, p: gone IS NULL OR NOT list_contains(gone, p)), ' ') AS kept
  FROM t LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM left_over
"""


def _op12(rounds: int = 5) -> str:
    """Lloyd's rounds written out, all vectors against all centroids."""
    steps = ["""
  v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
, c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS k, v AS c FROM v
         QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) <= 40)"""]
    for n in range(rounds + 1):
        steps.append(f"""
, d{n} AS (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n})
, a{n} AS (SELECT vec_id, any_value(v) AS v, min((d, k)) AS best FROM d{n} GROUP BY vec_id)""")
        if n < rounds:
            steps.append(f"""
, m{n} AS (SELECT k, list(m ORDER BY i) AS c FROM (
    SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM (SELECT best[2] AS k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY k, i) GROUP BY k)
, c{n + 1} AS (SELECT c{n}.k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))""")
    return f"""
WITH {"".join(steps)}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
       (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best[2] = k
"""


OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents)
, w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p)
, n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang)
, g AS (
  SELECT lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: w[i:i + s - 1])) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE len(w) >= s)
, f AS (SELECT lang, s, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM g GROUP BY lang, s, phrase HAVING count(*) >= 30)
, cut AS (
  SELECT lang, phrase, s, g, f AS a, k, array_to_string(g[1:k], ' ') AS x, array_to_string(g[k + 1:], ' ') AS y
  FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE s >= 2 AND k < s)
, best AS (
  SELECT cut.lang, cut.phrase, any_value(cut.g) AS g, any_value(a) AS a,
         min({'score': (2000000::HUGEINT * a // (l.f + r.f))::BIGINT, 'k': k, 'l': l.f, 'r': r.f}) AS b
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y GROUP BY cut.lang, cut.phrase)
, inner_phrase AS (
  SELECT lang, array_to_string(g[i:i + m - 1], ' ') AS phrase, f AS longer
  FROM f, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < s AND i + m - 1 <= s)
, held AS (SELECT lang, phrase, max(longer) AS longer FROM inner_phrase GROUP BY lang, phrase)
, ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY b.score DESC, a DESC, encode(best.phrase)) AS rank
  FROM best LEFT JOIN held ON held.lang = best.lang AND held.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT ranked.lang, rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

REFERENCE_SQL = {
    "op6_ngram_join": OP6, "op7_embedding_dedup": OP7, "op8_line_spread": OP8, "op11_relative_parse": OP11,
    "op12_scalar_tables": _op12(), "op13_collocations": OP13,
}
