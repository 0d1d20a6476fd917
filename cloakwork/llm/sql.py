"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# what a word is, for regular expressions in SQL
_WORD = r"[^\x20\x09-\x0D]+"

ORACLES["op6_quality_rules"] = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ws AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM texts),
places AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM ws WHERE len(w) >= 8),
windows AS (SELECT doc_id, i, list_aggregate(list_slice(w, i, i + 7), 'string_agg', ' ') AS g FROM places),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM found WHERE n > 1) GROUP BY doc_id),
tops AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, w1, count(*) AS n
    FROM (SELECT doc_id, unnest(w) AS w1 FROM ws) GROUP BY doc_id, w1) GROUP BY doc_id),
figures AS (SELECT doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, coalesce(top, 0) AS top, len(list_filter(w, lambda x: x LIKE '%!')) AS loud,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutter
    FROM ws LEFT JOIN covered USING (doc_id) LEFT JOIN tops USING (doc_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
        OR 2 * n_dup_lines > n_lines OR 3 * top > n_words OR 3 * stutter > n_words
        OR 2 * loud > n_words) AS kept
FROM based
"""

# windows as their words; a word goes if a window over it starts in a smaller document, too
ORACLES["op4_repeated_passages"] = rf"""
WITH ws AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM ws WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM places),
found AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM found WHERE first < doc_id),
parts AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM ws),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
    FROM parts ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM ws LEFT JOIN kept USING (doc_id)
"""

# bytes as pairs of hexadecimal digits; places are ordered by document, then start
ORACLES["op5_repeated_strings"] = """
WITH hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM hx),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g
    FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM sized WHERE n >= 100)),
found AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows),
ends AS (SELECT doc_id, i AS low, i + 100 AS high, max(i + 100) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found WHERE k > 1),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR low > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY low) AS span FROM ends),
spans AS (SELECT doc_id, span, min(low) AS low, max(high) AS high FROM numbered GROUP BY doc_id, span),
pieces AS (SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM spans
    UNION ALL SELECT s.doc_id, s.n, coalesce(max(high), 0) FROM sized s LEFT JOIN spans USING (doc_id) GROUP BY s.doc_id, s.n),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (low - since)), '' ORDER BY since, low) AS k
    FROM pieces JOIN sized USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, (n - length(k) // 2)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(unhex(k)) AS kept_sha256
FROM sized JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""


def _vector_codes(rounds: int = 4) -> str:
    """Parts as rows (vector, part, position, integer); each round assigns every part and replaces the entries."""
    ctes = [
        """ints AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) - 1 AS r,
    vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """pts AS MATERIALIZED (SELECT r, (i - 1) // (n // 4) AS part, (i - 1) % (n // 4) AS pos, v[i] AS x FROM (
    SELECT r, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS i FROM ints))""",
        "book0 AS MATERIALIZED (SELECT part, r AS entry, pos, x FROM pts WHERE r < 256)",
    ]
    for k in range(rounds + 1):
        ctes.append(f"""near{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT r, p.part, entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS d FROM pts p JOIN book{k} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            ctes.append(f"""mean{k} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM pts JOIN near{k} USING (r, part) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x
    FROM book{k} LEFT JOIN mean{k} USING (part, entry, pos))""")
    return f"""WITH {", ".join(ctes)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM ints JOIN coded USING (r)"""


ORACLES["op11_vector_codes"] = _vector_codes()

# every phrase of every piece; a product may pass 64 bits, so it is taken as a huge integer
ORACLES["op12_phrase_mining"] = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, len(w) AS m, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, i, unnest(range(1, least(5, m - i + 1) + 1)) AS k FROM starts)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
parts AS (SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN totals t ON t.lang = c.lang
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT DISTINCT c.lang, c.phrase FROM lowest c JOIN lowest o ON o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a
    AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest ANTI JOIN inside USING (lang, phrase)
QUALIFY rank <= 2000
"""
