"""The stored lexical index against plain scores."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions.stem import STOP_WORDS, stem
from kestrel.operators import lexical
from kestrel.operators import retrieval as rt
from tests.conftest import SF01

TOKEN = re.compile(r"\w+")


def plain_run(corpus, queries, k, english=False):
    def words(text):
        out = TOKEN.findall(text.lower())
        return [stem(w) for w in out if w not in STOP_WORDS.split()] if english else out

    docs = [Counter(words(t or "")) for _, t in corpus]
    terms = {t: i for i, t in enumerate(sorted({t for d in docs for t in d}))}
    tf = np.zeros((len(docs), len(terms)))
    for i, d in enumerate(docs):
        for t, n in d.items():
            tf[i, terms[t]] = n
    dl = tf.sum(1)
    df = (tf > 0).sum(0)
    weight = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl[:, None] / dl.mean()))
    pids = np.array([p for p, _ in corpus])
    out = {}
    for qid, q in queries:
        s = np.round(weight[:, [terms[t] for t in sorted(set(words(q))) if t in terms]].sum(1), 9)
        order = [i for i in np.lexsort((pids, -s))[:k] if s[i] > 0]
        if order:
            out[qid] = [(int(pids[i]), float(s[i])) for i in order]
    return out


def of(run):
    out = {}
    for r in sorted(run.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((r.pid, r.score))
        assert r.rank == len(out[r.qid]) - 1
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [p for p, _ in got[q]] == [p for p, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    names = [f"{a}{b}" for a in ("walk", "run", "gener", "act", "form", "care", "hope", "zoo") for b in
             ("", "s", "ed", "ing", "er", "al", "alize", "ation", "fulness", "ly")] + STOP_WORDS.split()
    share = 1 / np.arange(1, len(names) + 1)
    pick = lambda n: " ".join(rng.choice(names, n, p=share / share.sum()))
    corpus = [(int(p), pick(rng.integers(1, 60))) for p in rng.permutation(700)] + [(900, None), (901, ""), (902, pick(4000)), (903, "walk")]
    return corpus, [(i, pick(rng.integers(1, 7)).capitalize() + "?") for i in range(5000)] + [(7000, "nothing known here"), (7001, "")]


@pytest.mark.parametrize("analysis", ["plain", "english"])
def test_thousands_of_queries_against_brute_force(spark, tmp_path, texts, analysis):
    """5,000 queries in four slabs, shards and cells smaller than the corpus."""
    corpus, queries = texts
    docs = spark.createDataFrame([(p, "", t) for p, t in corpus], "pid long, title string, text string").repartition(3, "pid")
    asked = spark.createDataFrame(queries, "qid long, q string")
    folder = str(tmp_path / "index")
    lexical.build_index(docs, folder, analysis=analysis, shard_passages=200, shard_tokens=3_000)
    index = lexical.open_index(spark, folder)
    assert index.n_docs == len(corpus) and index.passages.count() > 3
    run, cells = lexical.search(index, asked, k=5, slab=1_500)
    same(of(run), plain_run(corpus, queries, 5, analysis == "english"))
    c = cells.agg(F.sum("met").alias("met"), F.sum("skipped").alias("skipped")).first()
    assert 0 < c.skipped < c.met  # some cells are skipped, and the result above is whole
    assert str(tmp_path) in "".join(run.inputFiles()) or all("kestrel-tables" in f for f in run.inputFiles())  # never the corpus


def test_more_queries_than_a_block_use_the_index(spark, texts):
    corpus, queries = texts
    docs = spark.createDataFrame([(p, "", t) for p, t in corpus], "pid long, title string, text string")
    asked = spark.createDataFrame(queries[:60], "qid long, q string")
    same(of(rt.bm25_topk(docs, asked, k=7, block=50)), plain_run(corpus, queries[:60], 7))
    same(of(rt.bm25_topk(docs, asked, k=7, block=60)), plain_run(corpus, queries[:60], 7))


def test_real_documents_and_a_damaged_index(spark, tmp_path):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").alias("pid"), F.col("source").alias("title"), "text")
    asked = spark.read.parquet(f"{SF01}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    folder = str(tmp_path / "index")
    run, _ = lexical.search(lexical.build_index(docs, folder, shard_passages=100), asked, k=40)
    same(of(run), of(rt.bm25_topk(docs, asked, k=40)))
    spark.createDataFrame([(0, [1])], "shard long, pids array<long>").write.mode("append").parquet(f"{folder}/passages")
    with pytest.raises(ValueError, match="passages of"):
        lexical.open_index(spark, folder)
    with pytest.raises(ValueError, match="no analysis"):
        lexical.build_index(docs, folder, analysis="french")


def test_an_empty_corpus_and_no_queries(spark, tmp_path):
    docs = spark.createDataFrame([], "pid long, title string, text string")
    asked = spark.createDataFrame([(1, "walk")], "qid long, q string")
    index = lexical.build_index(docs, str(tmp_path / "none"))
    assert lexical.search(index, asked)[0].collect() == [] and math.isclose(index.avgdl, 0)
    one = lexical.build_index(spark.createDataFrame([(1, None, "a walk")], docs.schema), str(tmp_path / "one"))
    assert lexical.search(one, asked.where("false"))[0].collect() == []


def test_published_stems():
    pairs = ("caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat "
             "troubled troubl sized size hopping hop falling fall fizzed fizz filing file happy happi sky sky relational relat "
             "conditional condit vietnamization vietnam operator oper decisiveness decis formalize formal electrical electr hopeful hope "
             "goodness good revival reviv allowance allow adjustment adjust adoption adopt effective effect bowdlerize bowdler probate probat "
             "rate rate cease ceas controll control roll roll as as zoë zoë").split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]
