"""The pipeline's rows against a plain version of its five stages."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from kestrel.llm import catalog, toxicity
from tests.conftest import SF001
from tests.llm.test_native import fill
from tests.llm.test_text_ops import plain_groups, plain_lines


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def split_budget(total, leaves):
    """Tokens of each leaf (domain, lang, source) by water filling down the tree."""
    given, out = {(): total}, {}
    for depth, level in enumerate(("domain", "lang", "source")):
        kids = defaultdict(dict)
        for path, tokens in leaves.items():
            old = kids[path[:depth]].get(path[depth], (0, 0))[1]
            kids[path[:depth]][path[depth]] = (catalog.MIX_WEIGHTS[level].get(path[depth], 1), old + catalog.MIX_EPOCHS * tokens)
        out = {parent + (k,): v for parent, c in kids.items() for k, v in fill(given[parent], c).items()}
        given = out
    return out


def plain_mix(rows):
    """Copies of each row (doc_id, lang, source, text)."""
    def leaf(r):
        n = re.search(r"([0-9]{1,9})$", r[2] or "")
        return (f"d{int(n[1]) % 3 if n else 0}", r[1] or "", r[2] or "")

    tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", r[3] or "")) for r in rows]
    leaves = Counter()
    for r, n in zip(rows, tokens):
        leaves[leaf(r)] += n
    quota = split_budget(sum(tokens) * catalog.MIX_PERCENT // 100, leaves)
    out = []
    for path, total in leaves.items():
        epochs, rest = divmod(quota[path], total) if total else (0, 0)
        own = []
        for r, n in zip(rows, tokens):
            if leaf(r) == path:
                fp = f"{r[0]}-{hashlib.md5((r[3] or '').encode()).hexdigest()}"
                own.append((hashlib.md5(f"{catalog.MIX_SEED}-{epochs}-{fp}".encode()).hexdigest(), r, n))
        before = 0
        for _, r, n in sorted(own, key=lambda x: x[0]):
            out += [r] * (epochs + (before < rest))
            before += n
    return out


def test_pipeline_against_a_plain_version(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = toxicity.fit_on_labels(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    rows = docs.collect()
    kept = [r for r in rows if model.score(toxicity.terms(r.text)) < toxicity.THRESHOLD]
    lines = dict(plain_lines([(r.doc_id, r.text) for r in kept], 10).keys())
    stays = {d for (d, _, _, k) in plain_groups([(r.doc_id, lines[r.doc_id]) for r in kept], 5, 80) if k}
    mixed = plain_mix([(r.doc_id, r.lang, r.source, lines[r.doc_id]) for r in kept if r.doc_id in stays])
    lib = sentencepiece.SentencePieceProcessor(model_file=catalog.piece_model())
    want = Counter()
    for d, lang, source, text in mixed:
        ids = lib.encode(text)
        want[d, lang, source, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))] += 1
    got = Counter(map(tuple, corpus_pipeline.run(spark, SF001).collect()))
    assert got == want and 0 < len(kept) < len(rows) and 0 < len(stays) < len(kept)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.dtypes == docs.dtypes and out.count() == 0
