"""Sub-word ids against the published tokenizer of the same vocabulary."""

import base64
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kestrel.operators import subwords as sw
from kestrel.plans.catalog import QUERIES
from tests.conftest import SF01, SF001

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_of_all_documents(spark, plain):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = sw.encode_subwords(docs, "text", PATH).select("text", "tokens").collect()
    assert len(rows) == docs.count()
    assert [r.tokens for r in rows] == plain.encode_ordinary_batch([r.text for r in rows])


def test_any_text(plain):
    m = sw.PairMerger(sw.read_ranks(PATH))
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(260), 0x85, 0x1c, 0x2003, 0x3000, 0x200b, 0x2028, 0x301, 0x660, 0x4e2d, 0x1f600, 0xfeff]] + list("  \n\t'sdlaeiou") * 10
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        ids = m.encode(text)
        assert ids == plain.encode_ordinary(text) and m.decode(ids) == text
    for text in ("ab" * 100_000, " " * 50_000, "é" * 50_000):  # one word
        assert m.encode(text) == plain.encode_ordinary(text)


def test_memory_is_bounded(monkeypatch, plain):
    monkeypatch.setattr(sw, "REMEMBERED", 10)
    m = sw.PairMerger(sw.read_ranks(PATH))
    text = " ".join(f"word{i} again" for i in range(500))
    assert m.encode(text) == plain.encode_ordinary(text) and len(m.known) <= 10


def test_nulls_empty_texts_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "id long, text string")
    t = sw.encode_subwords(df, "text", PATH)
    got = sorted(((r.id, r.tokens) for r in t.collect()), key=str)
    assert got[0] == (1, None) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) == 2
    back = sw.decode_subwords(t.select("id", "tokens"), "tokens", PATH)
    assert sorted(map(str, back.select("id", "text").collect())) == sorted(map(str, df.collect()))
    assert sw.encode_subwords(df.where("id > 9"), "text", PATH).count() == 0
    with pytest.raises(ValueError, match="already"):
        sw.encode_subwords(df, "text", PATH, out="id")
    with pytest.raises(ValueError, match="256"):
        sw.PairMerger([(b"a", 0)])


def test_a_cut_inside_a_character(spark):
    m = sw.PairMerger(sw.read_ranks(PATH))
    ids = m.encode("\U0001f9ea")
    assert len(ids) > 1 and "�" in m.decode(ids[:1])


def test_queries_cut_and_pad(spark, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    ids = {k: plain.encode_ordinary(t or "") for k, t in texts.items()}
    for r in QUERIES["h17b_subword_truncate"](spark, SF001).collect():
        assert (r.n_tokens, r.n) == (len(ids[r.doc_id]), min(512, len(ids[r.doc_id])))
    widths = {}
    for k, v in ids.items():
        widths[k // 8] = max(widths.get(k // 8, 0), min(200, len(v)))
    p = QUERIES["h12b_subword_batch"](spark, SF001)
    assert {r.doc_id: r.width for r in p.collect()} == {k: widths[k // 8] for k in ids}
    assert p.where(F.col("width") > 200).count() == 0
