"""Query op7: byte-level BPE of all documents by the merge automaton, and back."""

import public_tokenizers

from fieldloom.llm.bpe_automaton import bpe_digests
from fieldloom.session import table


def op7_bpe_automaton(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op7_bpe_automaton": op7_bpe_automaton}

#: SQL has no tokenizer: tests/llm holds the result against the tokenizers library.
ORACLES: dict[str, str] = {}
