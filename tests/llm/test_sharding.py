import random
from collections import defaultdict
from zlib import crc32

from glyphstream.llm import queries, sharding


def hold(rows, texts, shards, slack):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (i, len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t in texts
    )
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    assert set(slots) <= set(range(shards))
    mean = sum(sizes.values()) / shards
    biggest = max(r.size for r in rows)
    assert all(abs(sizes[s] - mean) <= slack * mean + biggest for s in range(shards))


def test_shards_with_a_hot_text(spark):
    rng = random.Random(5)
    texts = [(i, "copied text é") for i in range(400)] + [(7, "copied text é")] * 100 + [(-1, None), (-2, "")]
    texts += [(1000 + i, "w" * rng.randint(0, 300)) for i in range(900)]
    df = spark.createDataFrame([(i, t, 3) for i, t in texts], "doc_id long, text string, shard int").repartition(5)
    hold(sharding.shard(df, 8).collect(), texts, 8, 0.01)


def test_all_rows_equal_and_too_few_rows(spark):
    same = [(1, "x")] * 240
    df = spark.createDataFrame(same, "doc_id long, text string")
    hold(sharding.shard(df, 24).collect(), same, 24, 0.01)
    few = [(1, "a"), (2, "bb")]
    rows = sharding.shard(spark.createDataFrame(few, "doc_id long, text string"), 24).collect()
    assert len(rows) == 2 and all(r.slot == 0 for r in rows)
    assert sharding.shard(df.limit(0), 24).count() == 0


def test_equal_texts_stay_together(spark):
    texts = [(i, f"text {i % 50}") for i in range(500)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sharding.shard(df, 4, tolerance=0.1).collect()
    own = defaultdict(set)
    for r in rows:
        own[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in own.values()) == 0


def test_whole_rows_are_written_once(spark, tmp_path):
    rows = [(1, "a", "en"), (1, "a", "en"), (None, "b", "de"), (2, None, None), (3, "a", "fr")] + [(10 + i, "x" * i, "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sharding.write_shards(df, 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    none = lambda r: tuple((x is not None, x or "") if not isinstance(x, int) else (True, str(x)) for x in r)
    assert sorted(map(none, ((r.doc_id, r.text, r.lang) for r in back))) == sorted(map(none, rows))
    slots = defaultdict(list)
    for r in back:
        slots[r.shard].append(r.slot)
    assert set(slots) == {0, 1, 2, 3} and all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_parts_of_shards(spark):
    """More partitions than shards: slots go on over a shard's parts."""
    texts = [(i, f"t{i % 7}" * (i % 90)) for i in range(1500)]
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        hold(sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), 3).collect(), texts, 3, 0.01)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op10_histogram_shards(spark, sf).collect()
    hold(rows, texts, 24, 0.01)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
