"""The contracts of the text operators in DuckDB's SQL, for comparison on small tables.

Missing are the operators that SQL cannot express (trained models, the tokenizer, floating-point
distances) or is too slow for (strings of 400 bytes at every byte): the tests hold those against plain
versions.
"""

from __future__ import annotations

from .lines import LINE_REPORT_SQL

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM doc, (SELECT DISTINCT n FROM win) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.n = win.n AND pos.win = win.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_SPACED}') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * x >= 75 * (sa.n + sb.n - x)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM doc UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT doc.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, doc.doc_id = min(other) AS kept
FROM doc JOIN reach ON reach.doc_id = doc.doc_id LEFT JOIN sizes ON sizes.doc_id = doc.doc_id GROUP BY doc.doc_id
"""

SUBSTRINGS = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM doc, unnest(range(1, len(w) - 11)) AS t(i)),
early AS (SELECT win, min(doc_id) AS least FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT DISTINCT win.doc_id, p FROM win JOIN early ON win.win = early.win AND win.doc_id > least, unnest(range(i, i + 13)) AS t(p)),
word AS (SELECT doc_id, i AS p, w[i] AS word FROM doc, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL = {
    "op2_benchmark_decontamination": DECONTAMINATION,
    "op4_minhash_near_dedup": NEAR_DUPLICATES,
    "op6_substring_dedup": SUBSTRINGS,
    "op7_line_dedup": LINE_REPORT_SQL,
}
