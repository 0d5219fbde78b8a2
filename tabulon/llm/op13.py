"""The registered query of language identification."""

from tabulon.llm.base import query, table
from tabulon.llm.languages import held_out, label_languages, learn_languages


@query("op13_language_id")
def op13_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    found = label_languages(docs, learn_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
