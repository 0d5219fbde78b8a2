"""The registered query of toxicity scores."""

from pyspark.sql import functions as F

from tabulon.llm.base import query, table
from tabulon.llm.toxicity import held_out, learn, score_documents


@query("op9_toxicity")
def op9_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    lexicon = learn(docs, table(spark, folder, "labels"))
    return score_documents(docs, lexicon).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
