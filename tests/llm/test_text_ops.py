"""Line dedup, near-duplicates and the tokenizer against plain Python."""

import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kestrel.llm import line_dedup, near_dups, piece_tokenizer
from kestrel.llm.catalog import piece_model
from kestrel.llm.components import star_components

DOCS = "doc_id bigint, text string, h1 string, doc string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], DOCS)


def line_key(line):
    return line.encode().strip(b" \t\n\x0b\x0c\r").lower()


def plain_lines(rows, least):
    found = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            found[line_key(x)].add(i)
    gone = {k for k, d in found.items() if k and len(d) >= least}
    return Counter((i, "\n".join(x for x in (t or "").split("\n") if line_key(x) not in gone)) for i, t in rows)


@pytest.mark.parametrize("parts", [2, 8])
def test_lines(spark, parts):
    rng = random.Random(parts)
    pool = [f"Line {k} É" for k in range(40)] + ["", " ", "\x1f", " ", " hot "]
    rows = [(i, "\n".join(rng.choice([rng.choice(pool), "HOT", " hot\t", f"own {i} {k}"]) for k in range(rng.randrange(0, 30)))) for i in range(80)]
    rows += [(None, "HOT\nLine 1 É"), (None, "Line 2 É"), (3, None), (3, "HOT\nother"), rows[5], rows[5], (999, "long " * 30_000 + "\nhot")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = docs(spark, rows)
        for least in (2, 10):
            got = line_dedup.drop_shared_lines(df, least)
            assert got.columns == df.columns
            assert Counter((r.doc_id, r.text) for r in got.collect()) == plain_lines(rows, least)
        assert line_dedup.drop_shared_lines(df.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_bitmaps_only_for_documents_that_lose_lines(spark):
    df = docs(spark, [(i, f"own {i}\nshared" if i < 12 else f"own {i}") for i in range(20)])
    assert sorted(r.doc for r in line_dedup.keep_bitmaps(df).collect()) == list(range(12))


def shingles(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def plain_groups(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = d if not sets[i] else min(least[find(i)], default=None)
        out.append((d, len(sets[i]), c, d == c))
    return Counter(out)


def near_rows(seed, groups, copies, edits):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([2, 5, 30, 90, 250]))]
        if g % 3 == 0:
            base = base[:20] + passage + base[20:]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, edits)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, percent, seed", [(3, 85, 1), (5, 80, 2)])
def test_near_duplicates(spark, width, percent, seed):
    rows = near_rows(seed, 40, 12, 7)
    rows += [(1000, None), (1001, ""), (1002, "One"), (1003, "oNE"), (None, "one"), rows[0], (5000, rows[1][1].upper()), (7, "twice used id one two")]
    df = docs(spark, rows)
    got = near_dups.near_duplicates(df, width, percent)
    assert Counter((r.doc, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == plain_groups(rows, width, percent)
    left = near_dups.drop_near_duplicates(df, width, percent)
    assert left.columns == df.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for (d, _, _, k), n in plain_groups(rows, width, percent).items() if k for _ in range(n))


def test_one_large_chain_of_near_copies(spark):
    """Each copy is near the next only: the component needs every link."""
    words = [f"a{i}" for i in range(400)]
    rows = []
    for step in range(60):
        w = list(words)
        for k in range(6 * step):
            w[(k * 67) % 400] = f"s{step if k >= 6 * (step - 1) else 0}x{k}"
        rows.append((step, " ".join(words[step * 6:] + [f"n{j}" for j in range(step * 6)])))
    got = near_dups.near_duplicates(docs(spark, rows), 3, 85)
    assert Counter((r.doc, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == plain_groups(rows, 3, 85)


def test_no_rows_and_no_links(spark):
    df = docs(spark, [(1, "a b c d e f"), (2, "g h i j k l")])
    assert {(r.doc, r.component_id) for r in near_dups.near_duplicates(df).collect()} == {(1, 1), (2, 2)}
    assert near_dups.near_duplicates(df.where("false")).count() == 0


def test_least_shared_bound():
    assert near_dups.least_shared(64, 85) == 36
    assert near_dups.least_shared(64, 80) < near_dups.least_shared(64, 85)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in star_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert star_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(8)
    alpha = "abcdeéßñ ▁\n\t.,🙂日本語0123<>/=%&\x00\r"
    fixed = ["", " ", "  a  b ", "a\n\tb", "▁x ▁", "ﬁ Ａ é", "　x", "<s> a</s> <unk> <0x0A>", "   \n  \n\n x", " " * 900 + "x" + " " * 37, "a" * 700, "." * 5000, "\n"]
    return fixed + ["".join(rng.choice(alpha) for _ in range(rng.randrange(1, 70))) for _ in range(3000)]


def test_tokenizer_equals_library(model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    tok = piece_tokenizer.PieceTokenizer(piece_tokenizer.read_vocabulary(model))
    for t in odd_texts():
        ids = lib.encode(t)
        assert tok.encode(t) == ids, t
        assert tok.decode(ids) == lib.decode(ids), t
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice((rng.randrange(32_000), rng.randrange(259))) for _ in range(rng.randrange(1, 12))]
        assert tok.decode(ids) == lib.decode(ids), ids


def test_encode_and_decode_frames(spark, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(i, t) for i, t in enumerate(odd_texts()[:300])] + [(None, None), (3, "twice"), (3, "twice"), (9, "very long text " * 20_000)]
    df = docs(spark, rows).withColumn("ids", F.lit("taken"))
    got = piece_tokenizer.encode(df, model)
    assert got.columns == [*df.columns, "_ids"]
    back = piece_tokenizer.decode(got, model, "_ids").collect()
    assert Counter((r.doc_id, tuple(r["_ids"])) for r in back) == Counter((i, tuple(lib.encode(t or ""))) for i, t in rows)
    assert all(r.decoded == lib.decode(r["_ids"]) for r in back)
    assert piece_tokenizer.encode(df.where("false"), model).count() == 0


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(piece_tokenizer, "MEMORY_PARTS", 50)
    tok = piece_tokenizer.PieceTokenizer(piece_tokenizer.read_vocabulary(model))
    text = " ".join(f"word{i}x" for i in range(2000))
    assert tok.decode(tok.encode(text)) == text
    assert len(tok.words) <= 50 and len(tok.older) <= 50 and len(tok.pairs) <= 50


@pytest.mark.parametrize("other", [
    lambda t: "▁" + unicodedata.normalize("NFKC", t).replace(" ", "▁") if t else "",  # another rule
    lambda t: "▁" + "▁".join(t.split(" ")).strip("▁") if t else "",  # outer white space goes
    lambda t: "▁" + re.sub(" +", "▁", t) if t else "",  # runs become one
    lambda t: t.replace(" ", "▁"),  # no mark in front
    lambda t: "▁" + t if t else ""])  # spaces stay
def test_models_with_other_settings_are_refused(other):
    class Model:
        normalize = staticmethod(other)

    with pytest.raises(ValueError, match="normalisation"):
        piece_tokenizer.refuse_other_settings(Model)


def test_the_given_model_is_taken():
    assert len(piece_tokenizer.read_vocabulary(piece_model())) == 32_000
