"""Query op8: token files of all documents, written, read back and digested."""

import public_tokenizers

from fieldloom.llm.token_files import token_file_digests
from fieldloom.session import table


def op8_token_files(spark, sf_dir):
    return token_file_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )


QUERIES = {"op8_token_files": op8_token_files}

#: SQL has no tokenizer: tests/llm holds the result against the tokenizers library.
ORACLES: dict[str, str] = {}
