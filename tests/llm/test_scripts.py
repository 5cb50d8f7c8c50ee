"""Benchmark items of any script, and items without an id, are found in documents."""

from flowlens.llm import decontaminate as dc


def test_items_of_any_script_and_without_id(spark, documents):
    items = [(1, "Какая река протекает через этот старый город? Это река Нева у самого моря."),
             (None, "an item that has no id but words enough to be found"),
             (2, "日本で一番高い山はどこですか。それは富士山という山です。"),
             (3, "ποια είναι η πρωτεύουσα της χώρας αυτής σήμερα"), (None, "。、"), (4, "!?")]
    texts = [t for _, t in items[:4]]
    rows = [(n, f"some words before {t} and after") for n, t in enumerate(texts)]
    rows += [(10, "彼はこう言った" + texts[2][:-1] + "と答えた"), (11, "ничего общего с этим текстом тут нет"),
             (12, "。、 !?"), (13, None)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(documents(*rows), frame).collect()}
    assert found == {(0, 1), (1, None), (2, 2), (3, 3), (10, 2)}
    assert {r["doc_id"] for r in dc.drop_contaminated(documents(*rows), frame).collect()} == {11, 12, 13}
