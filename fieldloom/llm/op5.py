"""Query op5: toxicity of all documents."""

from fieldloom.llm.toxicity import toxicity
from fieldloom.session import table


def op5_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


QUERIES = {"op5_toxicity": op5_toxicity}

#: SQL has no compressor: tests/llm holds the scores against a plain loop and the held-out labels.
ORACLES: dict[str, str] = {}
