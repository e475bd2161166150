"""Query op10: the main text of all pages."""

from fieldloom.llm.html_cut import extract_main_text
from fieldloom.session import table


def op10_html_cut(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"), sample_pages=400)


QUERIES = {"op10_html_cut": op10_html_cut}

#: SQL has no maximum flow: tests/llm holds cuts against brute force and texts against planted articles.
ORACLES: dict[str, str] = {}
