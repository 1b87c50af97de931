"""Labels that disagree: the smallest counts, whatever the order of the rows."""

from cairn.llm import quality_rules, toxicity
from llm_tables import documents


def test_smallest_of_labels_that_disagree(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(6)])
    rows = [(0, 1, 0), (0, 0, 1), (1, 1, 1), (1, 1, 1), (2, 0, 0), (3, None, None), (3, 1, 1), (4, 7, 1), (None, 1, 1)]
    for order in (rows, rows[::-1]):
        labels = spark.createDataFrame(order, "doc_id long, quality int, toxic int").repartition(3)
        got = {(r.text, r.y) for r in quality_rules.labelled(docs, labels, "quality", 100).collect()}
        assert got == {("text 0", 0), ("text 1", 1), ("text 2", 0), ("text 3", 1)}
        sample, _, toxic = toxicity.labelled(docs, labels)
        assert {r.text: r.y for r in sample.collect()}.get("text 0", 0) == 0
        assert {r.text for r in toxic.collect()} <= {"text 1", "text 3", "text 4"}
