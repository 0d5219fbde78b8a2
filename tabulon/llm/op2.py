"""The registered query of chat formatting."""

from pyspark.sql import functions as F

from tabulon.llm.base import query, table
from tabulon.llm.chat import format_windows, loss_text_of, turns_of

HARD_TEXT = "\\### Assistant: </turn> ok"


@query("op2_chat")
def op2_chat(spark, folder):
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"),
    )
    windows = format_windows(given.unionByName(hard))
    read = windows.select(
        "conv_id", "window", F.length("formatted").alias("chars"),
        turns_of(windows).alias("turns"), loss_text_of(windows).alias("target"),
    )
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", line.alias("line"), "target"))).alias("all"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    target = F.array_join(F.col("all.target"), "")
    return each.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("all.line"), ""), 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars",
    )
