"""Query op6: documents that hold windows of benchmark items."""

from fieldloom.llm.decontaminate import contaminated_windows
from fieldloom.session import table


def op6_decontaminate(spark, sf_dir):
    return contaminated_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


QUERIES = {"op6_decontaminate": op6_decontaminate}

#: SQL has no SimHash: tests/llm holds the pairs against all windows of a small fixture.
ORACLES: dict[str, str] = {}
