import zlib

from pyspark.sql import functions as F

from pagelens.llm import sharding


def jump(key, shards):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = spark.range(300).select(F.xxhash64("id").alias("k"))
    for shards in (1, 2, 8, 9, 100, 5000):
        assert all(r.s == jump(r.k, shards) for r in keys.select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect())


def test_rows_slots_and_growth(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "é"), *[(k, f"text {k}") for k in range(3, 400)]]
    out = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(out) == len(rows)
    for shard in range(8):
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own)))
    texts = dict(rows)
    for r in out:
        raw = (texts.get(r.doc_id) or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
    assert any(r.grown_shard == 8 for r in out)
