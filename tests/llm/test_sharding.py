import random
import zlib

from lodestone.llm import sharding


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard string")


def test_shards_are_near_equal_whole_and_numbered(spark):
    rng = random.Random(6)
    rows = [(i, "w" * rng.randint(0, 300), rng.choice(["a", "b", None]), rng.choice(["en", "de"]), "x") for i in range(900)]
    rows += [(1000 + i, "copy of one text " * 10, "a", "en", "x") for i in range(700)] + [(5000, None, None, None, "x"), (5001, "", "a", "en", "x")]
    out = sharding.sharded(_docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    sizes = [0] * 8
    slots = [[] for _ in range(8)]
    for r in out:
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        assert r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    target = sum(sizes) / 8
    assert all(abs(s - target) < 0.03 * target for s in sizes)
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_small_groups_stay_together(spark):
    rows = [(i, f"text number {i // 2} " * (i % 5 * 0 + 20), f"s{i % 7}", "en", "x") for i in range(3000)]
    out = sharding.sharded(_docs(spark, rows)).collect()
    shards = {}
    for r in out:
        shards.setdefault(r["doc_id"] // 2, set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_few_and_no_rows(spark):
    assert sharding.sharded(_docs(spark, [(1, "a", "b", "c", "d")]).limit(0)).collect() == []
    out = sharding.sharded(_docs(spark, [(1, "a", "b", "c", "d"), (1, "a", "b", "c", "d")])).collect()
    assert len(out) == 2 and all(0 <= r["shard"] < 8 for r in out)
