"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontamination, html_text, language_id, licenses, near_dups, quality, quality_classifier, sharding, token_counts

QUERIES = {
    "op1_license_scans": licenses.op1_license_scans,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_sharding": sharding.op4_sharding,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_language_id": language_id.op6_language_id,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_near_dups": near_dups.op8_near_dups,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_html_extraction": html_text.op10_html_extraction,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
RUNS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

#: Results that the contract fixes whole. Learned models, tokenizers, markup, rules by the hundred and
#: iterations under quotas are beyond SQL.
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM d CROSS JOIN lengths, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
found AS (SELECT DISTINCT rid, i, k, item_id FROM places JOIN windows USING (k, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT rid, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)""",
    "op8_near_dups": f"""WITH RECURSIVE d AS (SELECT doc_id, {RUNS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)""",
}
