"""Query op1: components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""

from fieldloom.llm.line_dedup import LOWER, UPPER
from fieldloom.llm.ngram_join import ngram_components
from fieldloom.session import table


def op1_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"), size=4, percent=85)


QUERIES = {"op1_ngram_join": op1_ngram_join}

ORACLES = {
    "op1_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, t.b FROM reach r JOIN sym t ON r.b = t.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""
}
