"""Query op2: the 20 nearest vectors of every twentieth vector, by learned partitions."""

from fieldloom.llm.ann import nearest
from fieldloom.session import table


def op2_learned_partitions(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


QUERIES = {"op2_learned_partitions": op2_learned_partitions}

#: The search is approximate: tests/llm measures its recall against all inner products.
ORACLES: dict[str, str] = {}
