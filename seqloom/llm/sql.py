"""SQL forms of the queries that SQL can state, in DuckDB's dialect."""

from __future__ import annotations

from seqloom.llm import licenses, rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

PASSAGES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, {_WORDS} AS w FROM documents),
win AS (SELECT r, o, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT r, o, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT k, min(o) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM win JOIN least USING (k) WHERE m < o),
pos AS (SELECT r, j, w[j] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d WHERE len(w) > 0)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS body FROM pos ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

MIX = f"""
WITH d AS (
    SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
        ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
    FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS weight, source_size * 3 AS cap FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS place FROM w),
l AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM f
),
o AS (SELECT *, NOT (weight * level > cap) AS open FROM l),
t AS (
    SELECT source, source_size, CASE WHEN open THEN weight * (SELECT arg_min(level, place) FROM o WHERE open) ELSE cap::DOUBLE END AS target FROM o
),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM t),
hs AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM hs),
th AS (
    SELECT c.source, max(h) AS threshold FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
    WHERE upto - words / 2.0 <= target - rounds * source_size AND target - rounds * source_size > 0 GROUP BY c.source
)
SELECT doc_id, size, source_size, target, CAST(size * (rounds + CASE WHEN h <= threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN th ON d.source IS NOT DISTINCT FROM th.source
"""

NEAR = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
g AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, near) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.near = e.a),
c AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_LADDER = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(rules.LADDER))
_RISK, _DELTA, _COST = 0.01, 0.05, 100.0

RULES = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS body, {_WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
),
win AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM win SEMI JOIN (SELECT r, k FROM win GROUP BY r, k HAVING count(*) > 1) USING (r, k)),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY r),
m AS (
    SELECT r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(body) - length(replace(body, '!', '')) AS n_shouts
    FROM d LEFT JOIN rep USING (r)
),
v AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        greatest(CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END / {rules.LIMITS["symbols"]}::DOUBLE,
            CASE WHEN n_words > 0 THEN n_shouts / n_words ELSE 0 END / {rules.LIMITS["shouts"]}::DOUBLE,
            CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END / {rules.LIMITS["dup_lines"]}::DOUBLE,
            CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END / {rules.LIMITS["repeats"]}::DOUBLE,
            CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END / {rules.LIMITS["long_words"]}::DOUBLE) AS score
    FROM m
),
given AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
scored AS (SELECT lang, score, good FROM v JOIN given USING (doc_id) WHERE NOT base_failed),
totals AS (SELECT lang, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad FROM scored GROUP BY lang),
ladder(step, cutoff) AS (VALUES {_LADDER}),
walk AS (
    SELECT t.lang, step, cutoff, n_good, n_bad, (SELECT count(*) FROM totals WHERE n_good > 0) AS strata,
        count(s.score) FILTER (s.good AND s.score > cutoff) AS fr, count(s.score) FILTER (NOT s.good AND s.score > cutoff) AS tr
    FROM (SELECT * FROM totals WHERE n_good > 0) t CROSS JOIN ladder LEFT JOIN scored s ON s.lang IS NOT DISTINCT FROM t.lang GROUP BY ALL
),
tested AS (
    SELECT *, (fr < n_good AND list_sum(list_transform(range(0, fr + 1), lambda k: exp(lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1) + k * ln({_RISK}) + (n_good - k) * ln(1 - {_RISK}))))
        <= {_DELTA} / strata) AS holds FROM walk
),
sure AS (SELECT *, bool_and(holds) OVER (PARTITION BY lang ORDER BY step) AS all_hold FROM tested),
best AS (
    SELECT lang, cutoff FROM (
        SELECT lang, cutoff, row_number() OVER (PARTITION BY lang ORDER BY tr / greatest(n_bad, 1) - {_COST} * fr / n_good DESC, cutoff DESC) AS p FROM sure WHERE all_hold
    ) WHERE p = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score <= cutoff, true) AS kept, score, cutoff
FROM v LEFT JOIN best ON v.lang IS NOT DISTINCT FROM best.lang
"""

SUFFIXES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400)),
again AS (SELECT r, i FROM win SEMI JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
edge AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM again),
span AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS s FROM edge) GROUP BY r, s),
gap AS (
    SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS prev, b, lead(a) OVER (PARTITION BY r ORDER BY a) IS NULL AS last FROM span
),
piece AS (
    SELECT r, prev AS f, substr(x, 2 * prev + 1, 2 * (a - prev)) AS y FROM gap JOIN d USING (r)
    UNION ALL SELECT r, b, substr(x, 2 * b + 1) FROM gap JOIN d USING (r) WHERE last
),
kept AS (SELECT r, string_agg(y, '' ORDER BY f) AS y FROM piece GROUP BY r),
spans AS (SELECT r, count(*) AS n, sum(b - a) AS m FROM span GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())

LICENSES = rf"""
WITH t(license_id, body) AS (VALUES {_TEMPLATES}),
texts AS (
    SELECT 'd' AS kind, CAST(r AS VARCHAR) AS k, doc_id, text AS body FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL)
    UNION ALL SELECT 't', license_id, NULL, body FROM t
),
words AS (SELECT kind, k, doc_id, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10ffff}}]+') AS w FROM texts),
grams AS (SELECT DISTINCT kind, k, doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT kind, k, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
sizes AS (SELECT k, count(*) AS n_template FROM grams WHERE kind = 't' GROUP BY k),
hits AS (
    SELECT d.k AS dk, any_value(d.doc_id) AS doc_id, x.k AS license_id, count(*) AS n_shared
    FROM grams d JOIN grams x ON d.kind = 'd' AND x.kind = 't' AND d.g = x.g GROUP BY d.k, x.k
)
SELECT doc_id, license_id, n_shared, n_template, n_shared::DOUBLE / n_template AS containment
FROM hits JOIN sizes ON license_id = sizes.k WHERE 100 * n_shared >= 80 * n_template
"""

PHRASES = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT r, lang, row_number() OVER () AS i, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT r, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[j : j + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM p CROSS JOIN (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT * , string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, a, k, unnest(range(1, k)) AS j, w, phrase FROM c),
s AS (
    SELECT x.lang, x.phrase, x.a, j, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * x.a) // (l.a + r.a) AS BIGINT) AS score
    FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1 : j], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[j + 1 :], ' ')
),
b AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS z FROM s) WHERE z = 1),
sub AS (
    SELECT lang, phrase, max(a) AS longest FROM (
        SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (
            SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM c)
        )
    ) GROUP BY lang, phrase
),
kept AS (SELECT b.* FROM b LEFT JOIN sub ON b.lang = sub.lang AND b.phrase = sub.phrase WHERE longest IS NULL OR 100 * longest < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
) JOIN n USING (lang) WHERE rank <= 2000
"""

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

RANKED = r"""
WITH t AS (
    SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)
),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM len),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) CROSS JOIN tot),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT r, 50 + (50 * n * nn) // ll AS m FROM len CROSS JOIN tot),
s AS (SELECT item_id, tf.r, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.r = tf.r GROUP BY item_id, tf.r, tf.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
