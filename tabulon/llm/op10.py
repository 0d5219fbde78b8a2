"""The registered query of repeated byte strings."""

from pyspark.sql import functions as F

from tabulon.llm.base import query, table
from tabulon.llm.suffixes import remove_repeated_strings


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, folder):
    return remove_repeated_strings(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
