"""Tables that grow with the words stay out of the driver, small as they are here."""

from pyspark.sql import functions as F

from lexispark.operators import questions as K
from lexispark.operators import vocab as V


def test_rings_and_choices_are_not_broadcast(spark):
    w = spark.range(40).select("id", F.concat(F.lit("w"), "id").alias("lemma"), (F.col("id") % 2).cast("string").alias("pos"), F.concat(F.lit("d"), "id").alias("definition"), F.lit("").alias("context_definition"), F.expr("array(named_struct('form', 'f', 'morphology', 'm'))").alias("forms"))
    ranked = V.ranked(w.withColumn("one", F.lit(1)), ["pos"], "one", "definition")
    for df in (ranked, K.build(w, "greek-to-english")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert ranked.count() == 40
