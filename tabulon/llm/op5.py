"""The registered query of best-fit packing."""

import public_tokenizers

from tabulon.llm.base import query, table
from tabulon.llm.packing import pack

TOKENIZER = "word_bpe_49k.json"


@query("op5_packing")
def op5_packing(spark, folder):
    return pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
