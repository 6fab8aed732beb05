"""DuckDB SQL of the numbered queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

NGRAM_JOIN = f"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
copies AS (SELECT doc_id, text, w, min(doc_id) OVER (PARTITION BY text) AS rep FROM d),
g AS (
  SELECT DISTINCT rep, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS gram
  FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM copies WHERE doc_id = rep AND len(w) > 0)
),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
root AS (SELECT a AS rep, least(a, min(b)) AS root FROM reach GROUP BY a),
links AS (SELECT a AS rep, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(root, c.rep) AS class_id, c.rep AS copy_of, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n, 0)::BIGINT AS n_grams
FROM copies c LEFT JOIN root USING (rep) LEFT JOIN links USING (rep) LEFT JOIN n USING (rep)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN first USING (h) WHERE m < doc_id),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(0, 13) t(j)),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS c
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN cov USING (doc_id, p)
  GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_RECORD = (
    "'WARC/1.1' || crlf || 'WARC-Type: resource' || crlf || 'WARC-Record-ID: <urn:page:' || page_id || '>' || crlf || 'WARC-Target-URI: ' || coalesce(url, '') || crlf"
    " || 'Content-Type: text/html; charset=utf-8' || crlf || 'Content-Length: ' || strlen(coalesce(html, '')) || crlf || crlf || coalesce(html, '') || crlf || crlf"
)


def _leaves(source: str) -> str:
    return f"""SELECT file_id, page_id, coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at, n, digest
  FROM (SELECT page_id, floor(page_id / 512.0)::BIGINT AS file_id, strlen(r)::BIGINT AS n, sha256(r) AS digest FROM (SELECT page_id, {_RECORD} AS r FROM {source}, (SELECT chr(13) || chr(10) AS crlf)))"""


WARC_AUDIT = f"""
WITH p AS (SELECT page_id, url, html FROM pages WHERE page_id IS NOT NULL),
damaged AS (
  SELECT page_id, url, CASE WHEN page_id % 113 = 11 THEN substr(html, 1, length(html) - 1) ELSE html END AS html FROM p WHERE page_id % 113 <> 7
  UNION ALL SELECT -page_id - 1, url, html FROM p WHERE page_id % 113 = 29
),
a AS ({_leaves("p")}),
b AS ({_leaves("damaged")})
SELECT file_id, page_id, a.begin_at AS begin_a, a.n AS n_bytes_a, a.digest AS digest_a, b.begin_at AS begin_b, b.n AS n_bytes_b, b.digest AS digest_b,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (file_id, page_id) WHERE a.digest IS DISTINCT FROM b.digest
"""


def _license_scan() -> str:
    from driftledger.llm import license_scan as scan

    values = ", ".join(f"({t}, '{label}', '{w}', {q}, {str(key).lower()})" for t, label, w, q, key in scan.postings())
    base = " UNION ALL ".join(
        "SELECT doc_id, p - {a} AS first, p + {rest} AS last, '{label}' AS label FROM words WHERE x = '{anchor}' AND ".format(a=a, rest=len(phrase.split()) - 1 - a, label=label, anchor=phrase.split()[a])
        + " AND ".join(f"p + {k - a} >= 0 AND coalesce(w[p + {k - a + 1}] = '{word}', false)" for k, word in enumerate(phrase.split()))
        for phrase, label, a in scan.BASE
    )
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
),
posting(t, label, x, q, key) AS (VALUES {values}),
words AS (SELECT doc_id, w, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
places AS ({base}),
based AS (SELECT doc_id, count(*) AS n_base, min(first) AS first_word, max(last) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY doc_id),
hit AS (SELECT doc_id, x, p FROM words WHERE x IN (SELECT x FROM posting)),
size AS (SELECT t, count(*) AS words, count_if(key) AS keys FROM posting GROUP BY t),
aligned AS (SELECT doc_id, t, p - q AS d FROM hit JOIN posting USING (x) JOIN size USING (t) GROUP BY doc_id, t, p - q, words HAVING count(*) >= least(2, words)),
whole AS (SELECT doc_id, t, label, p - q AS d, count(*) AS c, count_if(key) AS k FROM hit JOIN posting USING (x) GROUP BY ALL),
labelled AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(c::DOUBLE / words) AS share FROM whole JOIN aligned USING (doc_id, t, d) JOIN size USING (t)
  WHERE k = keys AND c >= {scan.COVERAGE}::DOUBLE * words GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN based USING (doc_id) LEFT JOIN labelled USING (doc_id)
"""


LICENSE_SCAN = _license_scan()

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASE_MINING = f"""
WITH piece AS (
  SELECT lang, regexp_extract_all(x, '[^ \t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\n\x0B\f\r]')) AS x FROM documents)
),
gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, range(1, 4) t(k)) GROUP BY ALL
),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM gram WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM gram WHERE k >= 2 AND f >= 10),
cut AS (
  SELECT lang, c.k, c.phrase, a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN gram x USING (lang) JOIN gram y USING (lang) WHERE x.phrase = array_to_string(w[:j], ' ') AND y.phrase = array_to_string(w[j + 1:], ' ')
),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3),
gone AS (SELECT DISTINCT lang, phrase FROM inside JOIN c USING (lang, phrase) WHERE 100 * longer >= 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM worst ANTI JOIN gone USING (lang, phrase) JOIN n USING (lang)
QUALIFY rank <= 2000
"""

LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS document FROM documents),
line AS (SELECT row, doc_id, document, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM d),
keyed AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM line),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT document) >= 10),
marked AS (SELECT k.*, common.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""
