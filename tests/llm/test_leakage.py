"""Leaks in pieces far apart, none of which holds much of the item."""

from orelode.llm.leakage import find_leaks

ITEM = [f"w{k}x" for k in range(160)]
FILLER = " ".join(f"plain{k}" for k in range(150))


def test_a_leak_in_many_small_pieces_is_found(spark):
    pieces = [" ".join(ITEM[s : s + 10]) for s in range(0, 160, 20)]  # half of the item, a sixteenth in each piece
    texts = [(1, f" {FILLER} ".join(pieces)), (2, f" {FILLER} ".join(pieces[:4])), (3, FILLER), (4, f" {FILLER} ".join(pieces[::-1]))]
    items = [(10, " ".join(ITEM)), *((20 + k, " ".join(f"o{k}y{i}" for i in range(60))) for k in range(30))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 10)]
