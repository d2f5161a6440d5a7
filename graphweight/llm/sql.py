"""SQL for DuckDB that gives the rows of the queries it can express."""

from . import mixing as M
from . import quality as Q

OP1 = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 19] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id
), kept AS (
  SELECT words.doc_id, len(w) AS n, coalesce(len(g), 0) AS r,
    list_filter(list_transform(w, lambda x, p: CASE WHEN list_contains(coalesce(g, []), p) THEN '' ELSE x END), lambda x: x <> '') AS k
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), places AS (
  SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM words) WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list(DISTINCT g)) AS s FROM places WHERE i <= greatest(n - 4, 1) GROUP BY doc_id
), classes AS (
  SELECT s, len(s) AS n, min(doc_id) AS class_id, count(*) AS class_size FROM sets GROUP BY s
), grams AS MATERIALIZED (
  SELECT class_id, n, class_size, dense_rank() OVER (ORDER BY g) AS g FROM (SELECT class_id, n, class_size, g, count(*) OVER (PARTITION BY g) AS m FROM (SELECT class_id, n, class_size, unnest(s) AS g FROM classes)) WHERE m > 1
), links AS MATERIALIZED (
  SELECT a.class_id AS u, b.class_id AS v, any_value(b.class_size) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
), reach(u, v) AS (
  SELECT class_id, class_id FROM classes UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
), components AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY u
), others AS (
  SELECT u, sum(m) AS n FROM links GROUP BY u
)
SELECT words.doc_id, coalesce(class_id, words.doc_id) AS class_id, coalesce(class_size, 1)::BIGINT AS class_size, (coalesce(class_size, 1) - 1 + coalesce(others.n, 0))::BIGINT AS n_links,
  coalesce(component_id, words.doc_id) AS component_id, words.doc_id = coalesce(component_id, words.doc_id) AS kept
FROM words LEFT JOIN sets ON sets.doc_id = words.doc_id LEFT JOIN classes ON sets.s = classes.s LEFT JOIN others ON others.u = class_id LEFT JOIN components ON components.u = class_id
"""

OP7 = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS u, b.r AS v FROM vectors a JOIN vectors b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.95
), reach(u, v) AS (
  SELECT r, r FROM vectors UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
), components AS (
  SELECT u, min(vec_id) AS component_id FROM reach JOIN vectors ON r = v GROUP BY u
), found AS (
  SELECT vec_id, component_id, (SELECT count(*) FROM links WHERE links.u = r) AS n FROM vectors JOIN components ON u = r
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id, e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN found ON found.vec_id = e.vec_id
"""

OP9 = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), starts AS (
  SELECT r, i, md5_number(b[i + 1:i + 200]) AS k FROM (SELECT r, b, unnest(range(0, n - 199)) AS i FROM docs WHERE n >= 200)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS m FROM starts) WHERE m > 1
), runs AS (
  SELECT r, min(i) AS x, max(i) + 200 AS y FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run
    FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM twice)) GROUP BY r, run
), spans AS (
  SELECT r, sum(y - x) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
), rest AS (
  SELECT r, lag(y, 1, 0) OVER (PARTITION BY r ORDER BY x) AS lo, x AS hi FROM (SELECT r, x, y FROM runs UNION ALL SELECT r, n, n FROM docs)
), kept AS (
  SELECT r, string_agg(hex(b[lo + 1:hi]), '' ORDER BY lo) AS h FROM rest JOIN docs USING (r) WHERE lo < hi GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM docs LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)
"""

ORACLES = {"op1_substring_dedup": OP1, "op6_ngram_join": OP6, "op7_vector_dedup": OP7, "op9_suffix_dedup": OP9}


def _mix() -> str:
    """The targets by levels, the rows in the order of their keys, and the cut."""
    weights = ", ".join(str(float(w)) for w in M.WEIGHTS)
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
    substr(md5(concat_ws('|', '{M.SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, {M.KEY_BITS // 4}) AS k FROM documents
), sources AS (
  SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sizes GROUP BY source
), weighed AS (
  SELECT *, ([{weights}])[(r - 1) % {len(M.WEIGHTS)} + 1]::DOUBLE AS w FROM sources
), levels AS (
  SELECT *, ({M.SHARE}::DOUBLE * sum(s) OVER () - {M.MOST_EPOCHS}::DOUBLE * coalesce(sum(s) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY s / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, s::BIGINT AS source_size, CASE WHEN s > 0 THEN least({M.MOST_EPOCHS} * s, w * coalesce((SELECT level FROM levels WHERE w * level <= {M.MOST_EPOCHS} * s ORDER BY s / w, r LIMIT 1), 'infinity'::DOUBLE)) ELSE 0 END AS target FROM levels
), placed AS (
  SELECT sizes.*, source_size, target, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY sizes.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM placed
"""


def _quality() -> str:
    """The counts, the references as mean shares of each language's documents, and the distances bin by bin."""
    words = ", ".join("'" + w + "'" for w in Q.WORDS)
    langs = ", ".join("'" + x + "'" for x in sorted(Q.COMMON))
    count = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    n = len(Q.CLASSES)
    return rf"""
WITH a AS (
  SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)
), windows AS (
  SELECT doc_id, i, w[i:i + {Q.WINDOW - 1}] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {Q.WINDOW - 2})) AS i FROM a WHERE len(w) >= {Q.WINDOW})
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {Q.WINDOW})) AS p FROM twice) GROUP BY doc_id
), b AS (
  SELECT a.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS n, {count(Q.SYMBOLS)} AS n_symbols,
    len(lines) - list_unique(lines) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
    {count('[A-Z]')} AS up, {count('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} AS wide, {count('[0-9]')} AS digit, {count("[.,;:!?''" + '"()' + chr(92) + '-]')} AS mark,
    {count('[@_/' + chr(92) * 2 + '+=~^`{}' + chr(92) + '[' + chr(92) + ']' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0E-' + chr(92) + 'x1F' + chr(92) + 'x7F]')} AS rest,
    list_transform(w, lambda x: lower(x)) AS lw
  FROM a LEFT JOIN again ON a.doc_id = again.doc_id
), c AS (
  SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MOST_REPEATED} * n_words AS base_failed,
    [up, n - (up + wide + digit + mark + n_symbols + rest + n - word_chars), wide, digit, mark, n_symbols, rest, n - word_chars] AS chars,
    list_transform([{words}], lambda k: len(list_filter(lw, lambda x: x = k))) AS known
  FROM b
), bins AS (
  SELECT doc_id, lang, base_failed, n_words, i, CASE WHEN i <= {n} THEN chars[i] / greatest(n, 1)::DOUBLE WHEN i <= {n + len(Q.WORDS)} THEN known[i - {n}] / greatest(n_words, 1)::DOUBLE
    ELSE (n_words - list_sum(known)) / greatest(n_words, 1)::DOUBLE END AS p
  FROM (SELECT *, unnest(range(1, {n + len(Q.WORDS) + 2})) AS i FROM c)
), refs AS (
  SELECT lang AS ref, i, avg(p) AS q FROM bins WHERE lang IN ({langs}) AND NOT base_failed AND n_words >= {Q.MIN_COMMON_OF_WORDS} GROUP BY lang, i
), far AS (
  SELECT doc_id, ref, i <= {n} AS is_chars, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d
  FROM bins JOIN refs USING (i) WHERE lang = ref OR lang IS NULL OR lang NOT IN (SELECT ref FROM refs) GROUP BY doc_id, ref, is_chars
), least AS (
  SELECT doc_id, min(d) FILTER (is_chars) AS cd, min(d) FILTER (NOT is_chars) AS wd FROM far GROUP BY doc_id
)
SELECT c.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars >= {Q.MIN_CHARS} AND coalesce(cd, 0) > {Q.MOST_CHAR_DISTANCE}) AND NOT (n_words >= {Q.MIN_COMMON_OF_WORDS} AND coalesce(wd, 0) > {Q.MOST_WORD_DISTANCE}) AS kept
FROM c LEFT JOIN least ON c.doc_id = least.doc_id
"""


ORACLES["op3_mix_sources"] = _mix()
ORACLES["op5_quality"] = _quality()
