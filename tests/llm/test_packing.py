import random
import zlib

import numpy as np
import pytest

from pairloom.llm import packing as K

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_encode_as_the_tokenizer_does():
    encoder = K.Encoder(PATH)
    rng = random.Random(2)
    marks = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "é", "中文", "12", "!?", "\xa0", " ", "\x1f", "<|endoftext|>", ".\n", "x\ny"]
    texts = ["", " ", "\n", "a\n", " a", "a " * 500] + ["".join(rng.choice(marks) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        assert encoder.encode(text) == encoder.whole(text), repr(text)


def test_differencing_deals_every_item():
    rng = random.Random(4)
    for n in (1, 2, 3, 40, 700):
        sizes = [rng.randint(1, 256) for _ in range(n)]
        found = K.windows(sizes, 1024)
        assert sorted(i for w in found for i in w) == list(range(n))
        loads = [sum(sizes[i] for i in w) for w in found]
        assert max(loads) <= 1024 and len(found) <= -(-sum(sizes) // 1024) * 1.03 + 1
    loads = [load for load, _ in K.difference([rng.randint(1, 256) for _ in range(900)], 100)]
    assert max(loads) - min(loads) < 40


def test_packs_every_token_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = K.pack(docs, PATH, with_ids=True).toPandas()
    encoder = K.Encoder(PATH)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(pieces.doc_id) == set(texts)
    for doc, mine in pieces.sort_values("start").groupby("doc_id"):
        ids = b"".join(mine.ids)
        assert ids == encoder.whole(texts[doc]) + b"\0\0\0\0"
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]] and set(mine.doc_tokens) == {len(ids) // 4}
        assert [zlib.crc32(x) for x in mine.ids] == list(mine.ids_crc32)
    for _, mine in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(mine.offset) == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() <= 1024
    assert pieces.sequence_id.nunique() * 1024 < 1.03 * pieces.length.sum()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "a b", 9), (None, "a b", 9), (4, "a b", 9), (4, "a b", 9), (5, "word " * 9000, 9)], "doc_id long, text string, length int")
    rows = K.pack(docs, PATH).collect()
    assert sorted(r.doc_tokens for r in rows if r.doc_id != 5) == [1, 1, 3, 3, 3, 3]
    assert sum(r.length for r in rows if r.doc_id == 5) == next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert K.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_equal_rows_are_spread_over_groups(spark):
    """Neither rows of one null id and text nor rows of one id gather in a group."""
    docs = spark.range(6000).selectExpr("if(id < 3000, null, 7L) doc_id", "if(id % 2 = 0 or id < 3000, 'a b c', concat('t', id % 50)) text").repartition(4)
    rows = K.pack(docs, PATH, group_pieces=200).selectExpr("doc_id", "sequence_id >> 32 g", "sequence_id", "offset")
    sizes = {(r.doc_id, r.g): r["count"] for r in rows.groupBy("doc_id", "g").count().collect()}
    assert len({g for _, g in sizes}) == 30 and max(sizes.values()) < 170
    assert rows.distinct().count() == 6000


def test_equal_lengths(spark):
    """Ties in length are dealt one by one, to full windows."""
    assert sorted(map(len, K.windows([256] * 40, 1024))) == [4] * 10
    assert sorted(map(len, K.windows([300] * 9, 1024))) == [3, 3, 3]
