"""What the toxicity models ask of the driver."""

from __future__ import annotations

from nearwise.llm import toxicity


def test_levels_are_found_together(spark):
    """Counting beginnings and their evidence takes few jobs, whatever the number of levels: plans are what fills the driver."""
    texts = [(f"alpha beta {'gamma' if i % 4 else 'extraordinary'} w{i % 7}".encode(), i % 4) for i in range(80)]
    rows = spark.createDataFrame(texts, "text binary, group int").repartition(3)
    spark.sparkContext.setJobGroup("levels", "levels")
    try:
        known = toxicity.evidence(*toxicity.counted(rows))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["kind"] for r in known.collect()} == set(range(10))
    assert 0 < jobs <= 24
