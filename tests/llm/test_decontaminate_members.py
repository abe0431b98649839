"""All ids of benchmark items with the same tokens."""

from classweave.llm import decontaminate as d


def test_every_id_of_equal_items_is_named(spark):
    text = "one two three four five six seven eight nine ten"
    other = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame(
        [(12, text.upper()), (10, text), (11, text.replace(" ", ", ")), (None, text),
         (20, other), (10, other)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"so {text} it is"), (2, other), (3, f"{text} {other}"), (4, "clean")],
        "doc_id long, text string")
    rows = d.overlaps(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.item_ids) for r in rows) == [
        (1, 10, [10, 11, 12]), (2, 10, [10, 20]), (3, 10, [10, 11, 12, 20])]
