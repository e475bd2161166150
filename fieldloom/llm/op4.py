"""Query op4: lines that repeat across documents go, except in the largest document."""

from fieldloom.llm.line_dedup import LOWER, UPPER, line_dedup_digests
from fieldloom.session import table


def op4_line_dedup(spark, sf_dir):
    return line_dedup_digests(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)


QUERIES = {"op4_line_dedup": op4_line_dedup}

ORACLES = {
    "op4_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  '{UPPER}', '{LOWER}') AS key FROM l),
b AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.r, k.doc_id, k.line, k.pos, coalesce(k.doc_id <> b.top, false) AS gone FROM k LEFT JOIN b USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""
}
