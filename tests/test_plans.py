from pyspark.sql import functions as F

from scriptorium import catalog
from scriptorium.operators import quality


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_gate_cuts_a_text_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = plan_of(quality.Profile().verdict(docs, "text", ["Python basics"], F.lit(0)))
    # Paragraphs once, lines for readability and for the head of the text; tokens once, and once a paragraph.
    assert plan.count("split(") == 3 and plan.count("{2,}, 0)") == 2
    gate = plan_of(catalog.queries()["quality_gate"](spark, sf))
    assert gate.count("split(") == 2
