"""The registered query of document fingerprints."""

from tabulon.llm.base import query, table
from tabulon.llm.fingerprints import fingerprint_documents


@query("op6_fingerprints")
def op6_fingerprints(spark, folder):
    return fingerprint_documents(table(spark, folder, "documents"))
