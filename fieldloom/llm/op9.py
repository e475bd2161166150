"""Query op9: known licences of all documents, by canonical digests of whole texts and of whole lines."""

from fieldloom.llm.license_scan import SPELLINGS, SYMBOLS, known_digests, scan_licenses
from fieldloom.llm.license_texts import EQUIVALENT, KNOWN
from fieldloom.session import table

#: The oracle's own rule; it knows the texts in KNOWN only. The tables hold no copyright statements or whole licences.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}]*(copyright|\(c\)|©)[^\p{L}]"


def op9_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    same = "' ' || x || ' '"
    for spelling, equal in EQUIVALENT:
        for _ in range(2):
            same = f"replace({same}, ' {spelling} ', ' {equal} ')"
    lines = f"""list_transform(list_filter(list_transform(string_split(lower(coalesce(text, '')), chr(10)),
      lambda x: CASE WHEN regexp_matches(x, {_quoted(COPYRIGHT_LINE)}) THEN ''
        ELSE trim(regexp_replace(x, {_quoted(SYMBOLS)}, ' ', 'g'), ' ') END), lambda x: x <> ''),
      lambda x: CASE WHEN regexp_matches(x, {_quoted(SPELLINGS)}) THEN trim({same}, ' ') ELSE x END)"""
    known = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)
    return f"""
WITH texts AS (SELECT * FROM (VALUES {known}) v(license, text)),
known AS (SELECT digest, min(license) AS license FROM (
  SELECT license, sha256(array_to_string({lines}, ' ')) AS digest FROM texts) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, {lines} AS ls FROM documents),
l AS (SELECT r, k.license FROM (SELECT r, unnest(ls) AS line FROM d) x JOIN known k ON k.digest = sha256(line)),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM l GROUP BY r),
t AS (SELECT r, doc_id, sha256(array_to_string(ls, ' ')) AS text_digest FROM d)
SELECT doc_id, text_digest, k.license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM t LEFT JOIN known k ON k.digest = t.text_digest LEFT JOIN n USING (r)"""


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES = {"op9_license_scan": _oracle()}
