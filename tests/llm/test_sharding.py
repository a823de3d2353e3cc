import zlib

from pagesift.llm.sharding import shard_documents


def jump(key, n):
    b, j = -1, 0
    key &= 2**64 - 1
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


ROWS = [(i, "é" * (i % 7), "en", "s", 0) for i in range(-40, 400)] + [(2**62 + 1, "x", None, None, None), (None, None, None, None, None)]


def test_jump_hash_matches_the_definition(spark, docs_schema):
    got = {r.doc_id: r for r in shard_documents(spark.createDataFrame(ROWS, docs_schema)).collect()}
    assert len(got) == len(ROWS)
    for i, text, *_ in ROWS:
        raw = (text or "").encode()
        assert (got[i].shard, got[i].grown_shard) == (jump(i or 0, 8), jump(i or 0, 9))
        assert (got[i].size, got[i].text_crc32, got[i].law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert got[i].grown_shard in (got[i].shard, 8)


def test_slots_are_gapless_with_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(7, "t", 1, 2, 3)] * 50 + [(i, None, 1, 2, 3) for i in range(100)], "doc_id long, text string, shard int, slot int, _part int")
    rows = shard_documents(df, 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 150 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_empty_and_one_shard(spark, docs_schema):
    assert shard_documents(spark.createDataFrame([], docs_schema)).count() == 0
    rows = shard_documents(spark.createDataFrame([(5, "a", "", "", 1)], docs_schema), 1).collect()
    assert [(r.shard, r.slot) for r in rows] == [(0, 0)]
