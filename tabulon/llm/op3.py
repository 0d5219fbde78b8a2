"""The registered query of the secret scan."""

from pyspark.sql import functions as F

from tabulon.llm.base import query, table
from tabulon.llm.secrets import KINDS, scan_secrets


@query("op3_secrets")
def op3_secrets(spark, folder):
    found = scan_secrets(table(spark, folder, "documents"))

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(KINDS[:3])
    counts = [F.size(of([kind])).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
