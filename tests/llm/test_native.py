"""Quality rules, sharding, mixing and chat trees against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kestrel.llm import chat_trees, mixing, quality_rules, sharding

DOCS = "doc_id bigint, text string, lang string, source string, words_ string, shard int, copies string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, "x", 5, "y") for i, t, lang, src in rows], DOCS)


ROWS = [(1, "the cat sat " * 30, "en", "src0"), (2, None, None, None), (3, "", "en", "src1"), (None, "a b\nc\n\nc\n c", "de", "src1"),
        (5, "one two", "en", "src0"), (5, "one two", "en", "src0"), (6, "ä€ #$ |x|\t\x0bend", "fr", "src2"),
        (7, " ".join(f"w{i}" for i in range(4000)) + " of the", "en", "src0"),
        (8, "x1 x2 x3 x4 x5 x6 x7 x8 y x1 x2 x3 x4 x5 x6 x7 x8 " + " ".join(f"and{i}" for i in range(60)) + " the of", "es", "src4")]


def plain_quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for p in at for j in range(p, p + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark):
    got = quality_rules.quality_report(docs(spark, ROWS)).collect()
    want = Counter((i, *plain_quality(t)) for i, t, _, _ in ROWS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (r.failed_rule is None)
    assert {r.doc_id for r in got if r.kept} == {8} | ({7} if any(r.doc_id == 7 and r.kept for r in got) else set())


def test_quality_filter_and_empty(spark):
    df = docs(spark, ROWS)
    assert quality_rules.quality_filter(df).columns == df.columns
    assert quality_rules.quality_report(df.where("false")).count() == 0
    plan = quality_rules.quality_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_hypergeometric_law():
    rng = random.Random(1)
    got = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(40_000))
    for k in range(5):
        want = math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4)
        assert abs(got[k] / 40_000 - want) < 0.012
    assert sharding.hypergeometric(rng, 0, 9, 3) == 0 and sharding.hypergeometric(rng, 9, 0, 3) == 3


def test_matrix_sums():
    sizes = {b: random.Random(b).randrange(0, 5000) for b in range(50)}
    m = sharding.communication_matrix(sizes, 8, 3)
    assert all(sum(m[b]) == sizes[b] for b in sizes)
    cols = [sum(r[s] for r in m.values()) for s in range(8)]
    assert max(cols) - min(cols) <= 1 and min(min(r) for r in m.values()) >= 0


def test_shards(spark):
    df = docs(spark, ROWS * 20)
    a = sharding.shuffle_into_shards(df, ["doc_id"])
    rows = a.collect()
    assert a.columns[:-2] == df.columns and a.columns[-2:] == ["_shard", "slot"]
    by = defaultdict(list)
    for r in rows:
        by[r["_shard"]].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 8
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter(tuple(r)[:-2] for r in rows) == Counter(map(tuple, df.collect()))
    b = sharding.shuffle_into_shards(df.repartition(3, "text"), ["doc_id"]).collect()
    assert Counter(rows) == Counter(b)
    assert sharding.shuffle_into_shards(df.where("false"), ["doc_id"]).count() == 0


def test_shards_are_uniform(spark):
    df = spark.range(4000)
    r = sharding.shuffle_into_shards(df, ["id"]).toPandas()
    low = r[r.id < 2000].shard.value_counts()
    assert low.sum() == 2000 and low.min() > 200 and low.max() < 300
    assert abs(r.id.corr(r.slot)) < 0.06


def fill(budget, kids):
    """Water filling one unit of level at a time, in exact fractions."""
    from fractions import Fraction
    out, rest, left = {}, Fraction(budget), dict(kids)
    while left:
        w = sum(x[0] for x in left.values())
        full = [k for k, (a, cap) in left.items() if rest * a >= cap * w]
        if not full:
            for k, (a, _) in left.items():
                out[k] = int(rest * a / w)
            return out
        for k in full:
            out[k] = left[k][1]
        rest -= sum(left.pop(k)[1] for k in full)
    return out


def test_water_fill(spark):
    rng = random.Random(4)
    for case in range(6):
        kids = {f"k{i}": (rng.randrange(1, 9), rng.choice([0, rng.randrange(1, 1000)])) for i in range(rng.randrange(1, 9))}
        budget = rng.randrange(0, 3000)
        df = spark.createDataFrame([("p", k, w, c, budget) for k, (w, c) in kids.items()], "p string, k string, w bigint, c bigint, b bigint")
        got = {r.k: r.s for r in mixing.water_fill(df, ["p"], "k", "w", "c", "b", "s").collect()}
        want = fill(budget, kids)
        assert all(abs(got[k] - want[k]) <= 1 for k in kids), (kids, budget, got, want)
        assert sum(got.values()) <= max(budget, 0) and all(got[k] <= kids[k][1] for k in kids)


def test_mix_takes_seeded_prefixes(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(0, 9))), rng.choice(["en", "de", None]), rng.choice(["src0", "src1"])) for i in range(300)]
    df = docs(spark, rows + rows[:3] + [(None, None, None, None)])
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.select_mix(df, levels, {"lang": {"en": 9}}, 50, 4, 3)
    assert got.columns == [*df.columns, "n_tokens", "_copies"]
    out = got.collect()
    assert len(out) == 304
    tokens = {}
    leaf = defaultdict(list)
    for r in out:
        tokens[r.doc_id] = r.n_tokens
        leaf[r.lang or "", r.source or ""].append(r)
        assert r.n_tokens == len((r.text or "").split())
    total = sum(r.n_tokens for r in out)
    taken = sum(r.n_tokens * r["_copies"] for r in out)
    assert 0.5 * total <= taken <= 0.5 * total + 8 * 2 * len(leaf)
    for rows_ in leaf.values():
        assert max(r["_copies"] for r in rows_) - min(r["_copies"] for r in rows_) <= 1
    en = sum(r.n_tokens * r["_copies"] for r in out if r.lang == "en")
    assert en > 0.7 * taken
    again = mixing.select_mix(df.repartition(2, "text"), levels, {"lang": {"en": 9}}, 50, 4, 3)
    assert Counter(out) == Counter(again.collect())
    assert mixing.repeat_copies(got, "_copies").count() == sum(r["_copies"] for r in out)
    assert mixing.select_mix(df.where("false"), levels).count() == 0


TREE = "tree bigint, node bigint, parent bigint, role string, text string, score double, depth string"


def test_branches_ranked_and_formatted(spark):
    rows = [(1, 1, None, "system", "s", 0.0), (1, 2, 1, "user", "hi <|im_end|>", 1.0), (1, 3, 2, "assistant", "a\n<\\|b", 0.2),
            (1, 4, 2, "assistant", "better <", 0.9), (1, 5, 4, "user", None, None), (2, 7, 99, "assistant", "", 1.0),
            (None, 1, None, None, "x", 1.0), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (3, 3, 2, "user", "leaf of a loop", 1.0),
            (3, 4, None, "we\nird<|\\n", "y", 1.0), (1, 5, 4, "user", None, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], TREE)
    got = chat_trees.format_branches(df, top=None).select(
        "tree", "leaf", "branch", "formatted", chat_trees.read_turns(F.col("formatted")).alias("turns"),
        chat_trees.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {(r.tree, r.leaf): r for r in got}
    assert set(by) == {(1, 3), (1, 5), (2, 7), (None, 1), (3, 4)}
    assert [tuple(t) for t in by[1, 5].turns] == [("system", "s"), ("user", "hi <|im_end|>"), ("assistant", "better <"), ("user", "")]
    assert [tuple(t) for t in by[1, 3].turns][-1] == ("assistant", "a\n<\\|b") and by[1, 3].loss == "a\n<\\|b"
    assert by[1, 5].loss == "better <" and [tuple(t) for t in by[3, 4].turns] == [("we\nird<|\\n", "y")]
    assert by[1, 5].branch == 1 and by[1, 3].branch == 2  # mean 0.475 against 0.4
    best = chat_trees.format_branches(df).collect()
    assert {(r.tree, r.leaf) for r in best} == {(1, 5), (2, 7), (None, 1), (3, 4)}
    assert chat_trees.format_branches(df.where("false")).count() == 0


def test_branches_of_a_spine_stay_linear(spark, monkeypatch):
    n, written, plain = 600, [], chat_trees.materialize

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(chat_trees, "materialize", counted)
    spine = [(1, i, i - 1 if i else None, 0.5) for i in range(n)]
    leaves = [(1, n + i, i, 1.0 if i == 400 else 0.0) for i in range(n)]  # a leaf at every node
    df = spark.createDataFrame(spine + leaves, "tree int, node int, parent int, score double")
    paths = chat_trees.branch_paths(df).collect()
    assert sorted((r.depth, r.node) for r in paths) == [(i, i) for i in range(401)] + [(401, n + 400)]
    assert {(r.leaf, r.branch) for r in paths} == {(n + 400, 1)}
    assert max(written) <= 2 * n and sum(written) <= 2 * n * 14


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_long_chains(spark, n):
    conv = spark.createDataFrame([(5, t, "assistant" if t % 2 else "user", f"t{t}<|\\") for t in range(n)] * 2, "conv_id bigint, turn int, role string, text string")
    r = chat_trees.format_branches(chat_trees.chains(conv)).select(chat_trees.read_turns(F.col("formatted")).alias("t"), "loss_spans", "formatted").collect()
    assert len(r) == 1
    want = [x for t in range(n) for x in [("assistant" if t % 2 else "user", f"t{t}<|\\")] * 2]
    assert [tuple(t) for t in r[0].t] == want
    text = r[0].formatted
    assert [chat_text(text[s.start:s.end]) for s in r[0].loss_spans] == [t for role, t in want if role == "assistant"]


def chat_text(escaped):
    return re.sub(r"<(\\*)\\\|", r"<\1|", escaped)


def test_digest_shape():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
