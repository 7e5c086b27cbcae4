"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

from tidemark.llm import quality_ledger, secret_ledger

WORD = r"[^\x20\x09-\x0D]+"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LOWER = f"translate(coalesce(text, ''), {quoted(string.ascii_uppercase)}, {quoted(string.ascii_lowercase)})"

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {quoted(WORD)}) AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
 n AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS k FROM s),
 t AS (SELECT doc_id, unnest(g) AS x FROM s),
 e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT e.a, e.b FROM e JOIN n x ON x.doc_id = e.a JOIN n y ON y.doc_id = e.b WHERE 100 * e.o >= 80 * (x.n + y.n - e.o)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, CASE WHEN n.n > 0 THEN count(*) OVER (PARTITION BY n.k, n.n > 0) ELSE 1 END AS n_copies, coalesce(q.n_links, 0) AS n_links
FROM n JOIN c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1) q USING (doc_id)"""

_BITS = " + ".join(f"(CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END)" for i, r in enumerate(quality_ledger.RULES))
_STANDARD = quality_ledger.STANDARD
QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {quoted(WORD)}) AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {quoted(WORD)})) AS lines FROM documents),
 g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
 h AS (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, g HAVING count(*) > 1),
 q AS (SELECT doc_id, count(DISTINCT i + j) AS r FROM h, range(0, 5) x(j) GROUP BY doc_id),
 m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM d LEFT JOIN q USING (doc_id)),
 f AS (SELECT *, {_BITS} AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
 n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (failed & {_STANDARD.mask()}) = 0 AS kept, CAST(failed AS BIGINT) AS failed, '{_STANDARD.name}:{_STANDARD.version}' AS policy FROM f"""


def _secrets() -> str:
    kinds = []
    for i, r in enumerate(secret_ledger.RULES):
        p = quoted(r.pattern)
        kinds.append(f"SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, string_split_regex(text, {p}) AS p, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {r.group}) AS g, {r.least} AS least FROM d WHERE regexp_matches(text, {p})")
    base = ", ".join(quoted(r.kind) for r in secret_ledger.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_ledger.BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), k AS ({" UNION ALL ".join(kinds)}),
 x AS (SELECT doc_id, ord, kind, least, g[i] AS g, length(m[i]) AS n, list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
 s AS (SELECT doc_id, ord, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS t FROM x WHERE length(g) >= least),
 a AS (SELECT doc_id, {counts}, string_agg(t, ',' ORDER BY s, ord) FILTER (kind IN ({base})) AS b, string_agg(t, ',' ORDER BY s, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_ledger.BASE_RULES)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


SECRETS = _secrets()
