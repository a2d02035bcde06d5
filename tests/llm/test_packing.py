"""Sum-of-squares packing of texts."""

import random

from orelode.llm import packing as p


def test_little_room_is_left_and_nothing_overflows():
    r = random.Random(3)
    for capacity in (64, 512):
        sizes = sorted((r.randint(1, capacity // 2) for _ in range(3000)), reverse=True)
        filled: dict[int, int] = {}
        for k, s in zip(p.pack(sizes, capacity), sizes):
            filled[k] = filled.get(k, 0) + s
        assert max(filled.values()) <= capacity and sorted(filled) == list(range(len(filled)))
        assert len(filled) * capacity < 1.02 * sum(sizes)
    assert p.pack([], 8) == [] and p.pack([8, 8, 4, 4], 8) == [0, 1, 2, 2]


def test_every_token_once_and_short_texts_whole(spark):
    texts = ["", None, "one", "word " * 5, "é😀汉" * 60, "x" * 5000, "A line of text.\n" * 40, "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = p.encoding()
    for group in (100_000, 3):
        rows = p.pack_texts(df, 64, group=group).collect()
        room: dict[int, int] = {}
        for x in rows:
            room[x["container_id"]] = room.get(x["container_id"], 0) + x["n_tokens"]
        assert max(room.values()) <= 64
        for i, t in enumerate(texts):
            tokens, own = enc.encode_ordinary(t or ""), sorted((x["token_start"], x["n_tokens"]) for x in rows if x["doc_id"] == i)
            assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == len(tokens)
            assert len(own) == 1 or not 0 < len(tokens) <= 64
            assert "".join(enc.decode(tokens[s : s + n], errors="strict") for s, n in own) == (t or "")


def test_registered_for_each_token_budget(spark, tmp_path):
    from __spark_entry__ import queries

    root = str(tmp_path)
    spark.createDataFrame([(1, "some words " * 900), (2, "few"), (3, None)], "doc_id bigint, text string").write.parquet(f"{root}/documents.parquet")
    budgets = [(f"pack_{c}", "tokens", c, None) for c in (512, 2048, 4096)]
    spark.createDataFrame(budgets, "budget_name string, unit_name string, capacity int, overlap_size int").write.parquet(f"{root}/budgets.parquet")
    for _, _, capacity, _ in budgets:
        got = queries()[f"p6_pack_{capacity}"](spark, root)
        assert {r["doc_id"] for r in got.collect()} == {1, 2}
        assert max(r["s"] for r in got.groupBy("container_id").agg({"n_tokens": "sum"}).toDF("c", "s").collect()) <= capacity
