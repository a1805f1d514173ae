"""Conversation repair, filter audit and the bit-sliced index against plain
Python."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import bit_slices, filter_audit, turn_repair
from kestrel.llm.catalog import DIGEST
from kestrel.llm.turn_repair import Fold, Repair, Turn

CONV = "conv_id bigint, turn bigint, role string, text string, copies string, first int, gone string"


def plain_repair(turns):
    """Every way to edit, by (cost, audit, rows)."""
    memo = {}

    def best(i, state, inserts=0):
        key = i, state, inserts
        if key not in memo:
            found = []
            if i == len(turns) and state in (0, 3):
                found.append((0, "", ()))
            if inserts < 3:
                role = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
                nxt = best(i, {"u": 2, "a": 3}[role[0]], inserts + 1)
                if nxt:
                    found.append((nxt[0] + 3, "I" + nxt[1], ((role, ""), *nxt[2])))
            if i < len(turns):
                t = turns[i]
                options = [(4, "D", None, state)]
                if not t.must_go:
                    late = 3 * t.truncated
                    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
                    if (state, t.role[:1]) in go:
                        options.append((late, "K", t.role, go[state, t.role[:1]]))
                    options += [(3 + late, "R", r, go[state, r[0]]) for r in ("user", "assistant") if (state, r[0]) in go]
                for cost, letter, role, to in options:
                    nxt = best(i + 1, to)
                    if nxt:
                        found.append((nxt[0] + cost, letter + nxt[1], ((((role, t.text),) if role is not None else ()) + nxt[2])))
            memo[key] = min(found) if found else None
        return memo[key]

    return best(0, 0)


ROWS_FOLD = Fold(tuple, lambda old, rows: old + tuple(rows), lambda x: x, "")


@pytest.mark.parametrize("seed", range(60))
def test_repair_is_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 2, 5, 9, 31, 32, 33, 70, 150])
    turns = [Turn(rng.choice(["user", "assistant", "system", "", " ", "u", "tool"][:rng.choice([2, 3, 7])]), f"t{i}",
                  rng.random() < 0.2, int(rng.random() < 0.3)) for i in range(n)]
    r = Repair(ROWS_FOLD)
    for t in turns:
        r.add(t)
    assert r.done() == plain_repair(turns)


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "x", 3, "y") for c, t, r, x in rows], CONV)


TALK = ([(1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (1, 2, "assistant", "So."), (1, 5, "user", "And"),
         (2, None, "user", "Null turn."), (2, None, None, "no role."), (2, 3, "assistant", None), (2, 3, "user", ""),
         (None, 1, "user", "No id!"), (None, 4, "assistant", "Yes \t"), (7, 1, "", "empty role."), (7, 1, "", "empty role."),
         (8, None, "user", " \n"), (9, 2, "user", "long " * 50_000 + "."), (9, 3, "assistant", "ok.")]
        + [(10, i, "tool", f"x{i}.") for i in range(200)])


def plain_report(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, kinds, illegal, before = set(), [], Counter(), 0, None
        for t, r, x in mine:
            said = x.strip(" \t\n\x0b\x0c\r")
            kind = "blank" if not said else "dup" if (r, x) in seen else "trunc" if said[-1] not in ".!?" else ""
            kinds[kind] += 1
            seen.add((r, x))
            turns.append(Turn(r, x, kind in ("blank", "dup"), int(kind == "trunc")))
            illegal += before is not None and before + r[:1] not in ("su", "ua", "au")
            before = r[:1]
        some = [t for t, _, _ in mine if t is not None]
        gaps = max(some) - min(some) + 1 - len(set(some)) if some else 0
        cost, audit, left = plain_repair(turns)
        out.append((conv, gaps, kinds["blank"], kinds["dup"], kinds["trunc"], illegal, cost, audit, tuple(left)))
    return Counter(out)


def test_repair_of_a_table(spark):
    df = conversations(spark, TALK)
    got = Counter((*r[:8], tuple((x.role, x.text) for x in r.repaired)) for r in turn_repair.repair(df).collect())
    assert got == plain_report(TALK)
    digests = {r.conv_id: r.h for r in turn_repair.repair(df.repartition(5), DIGEST, "h").collect()}
    for r in got:
        assert digests[r[0]] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in r[8]).encode()).hexdigest()
    assert turn_repair.repair(df.where("false")).count() == 0


def test_damage_keeps_every_conversation(spark):
    df = conversations(spark, TALK + [(i, 1, "user", "One. Two") for i in range(100, 140)])
    hurt = turn_repair.damage(df)
    kinds = {(r.conv_id, r.turn): r.k for r in df.select("conv_id", "turn", (F.crc32(F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20).alias("k")).collect()}
    for r in hurt.where("conv_id >= 100").collect():
        k = kinds[r.conv_id, r.turn]
        assert (r.gone, r.copies, r.role) == (k == 0, 2 if k == 3 else 1, "user") and r.text == {1: "", 2: "One Two"}.get(k, "One. Two")
    done = turn_repair.repair(hurt, DIGEST, "h", F.col("copies"), F.col("gone")).collect()
    assert {r.conv_id for r in done} == {r[0] for r in TALK} | set(range(100, 140))
    empty = hashlib.sha256(b"").hexdigest()
    for r in done:
        if r.conv_id and r.conv_id >= 100 and kinds[r.conv_id, 1] == 0:
            assert tuple(r[1:]) == (0, 0, 0, 0, 0, 0, "", empty)


def test_hot_conversation(spark):
    """One conversation with most rows, mostly copies: counted before the
    shuffle, and a digest that holds no text."""
    hot = spark.range(20_000).select(F.lit(1).cast("bigint").alias("conv_id"), (F.col("id") % 40).alias("turn"), F.lit("user").alias("role"),
                                     F.lit("Same.").alias("text"))
    r = turn_repair.repair(hot, DIGEST, "h").first()
    assert (r.blank, r.duplicate, r.gaps, r.cost) == (0, 19_999, 0, 19_999 * 4 + 3) and r.audit == "K" + "D" * 19_999 + "I"


DOCS = "doc_id bigint, text string, source string, mask int, part int, digest string"


def test_orders_by_swaps():
    for n in range(1, 6):
        names = "ABCDE"[:n]
        diagram = filter_audit.Diagram(names, [(0, (1,))])
        seen = ["".join(diagram.order)]
        for level in filter_audit.swaps_through_all_orders(n):
            diagram.swap(level)
            seen.append("".join(diagram.order))
        assert len(seen) == len(set(seen)) and set(seen) == {"".join(p) for p in permutations(names)}


def plain_audit(filters, rows):
    out, gone = [], Counter()
    for order in permutations(filters):
        left = list(rows)
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            out_now = [(m, c) for m, c in left if m & bit]
            left = [(m, c) for m, c in left if not m & bit]
            every = sum(c[0] for m, c in rows if m & bit)
            removed = sum(c[0] for _, c in out_now)
            gone[f] += removed
            out.append(["".join(order), step, sum(c[0] for _, c in left), removed, every - removed,
                        sum(c[0] for m, c in rows if m == bit), sum(c[1] for _, c in out_now), sum(c[2] for _, c in out_now)])
    return sorted((*r, gone[r[0][r[1] - 1]]) for r in out)


@pytest.mark.parametrize("filters,seed", [("A", 0), ("AB", 1), ("ABC", 2), ("ABCDE", 3), ("ABCDE", 4)])
def test_diagram_equals_filtering(filters, seed):
    rng = random.Random(seed)
    masks = rng.sample(range(1 << len(filters)), rng.randint(1, 1 << len(filters)))
    rows = [(m, (rng.randint(0, 9), rng.randint(0, 3), rng.randint(0, 3))) for m in masks]
    assert sorted(filter_audit.audit(filters, rows)) == plain_audit(filters, rows)


def test_filter_masks(spark):
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None, None), (2, "", "s"), (3, words, "s"), (4, words, "t"), (4, words, "t"), (None, words, "t"), (5, words + " #", "s"),
            (6, words.upper(), "s"), (7, "a " * 400, "s"), (8, "x " * 100_000, "s")]
    df = spark.createDataFrame([(i, t, s, 9, 9, "z") for i, t, s in rows], DOCS)
    got = filter_audit.failure_masks(df, filter_audit.own_failures(F.col("text")))
    want = [(1, "", 1), (2, "s", 17), (3, "s", 0), (4, "t", 16), (4, "t", 16), (None, "t", 0), (5, "s", 8), (6, "s", 4), (7, "s", 2), (8, "s", 2)]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, 1, None), (99, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    counts = {(r.part, r.mask): (r.n, r.good, r.toxic) for r in filter_audit.part_counts(got, labels).collect()}
    assert counts["s", 0] == (1, 1, 1) and counts["t", 16] == (2, 2, 0) and counts["t", 0] == (1, 0, 0)
    audit = filter_audit.interaction_audit(filter_audit.part_counts(got, labels), "ABCDE")
    assert audit.groupBy("part").count().where("count = 600").count() == 3
    none = filter_audit.failure_masks(df.where("false"), filter_audit.own_failures(F.col("text")))
    assert filter_audit.interaction_audit(filter_audit.part_counts(none, labels), "ABCDE").count() == 0


def plain_top(rows, is_query, k, scale=64):
    usable = {(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = Counter()
    for i, q in usable:
        if is_query(i):
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
            out.update((i, r, j, -s) for r, (s, j) in enumerate(best, 1))
    return out


VECS = "vec_id bigint, embedding array<double>, label int, dim int, q string, place string"


@pytest.mark.parametrize("case", ["ties", "wide", "small", "odd"])
def test_bit_slices_are_exact(spark, case):
    rng = np.random.default_rng(len(case))
    if case == "ties":
        rows = [(int(i), [float(x) for x in rng.integers(-1, 2, 4) / 64]) for i in range(300)]
    elif case == "wide":
        rows = [(int(i), [float(x) for x in rng.normal(size=6) * 10.0 ** rng.integers(-3, 4)]) for i in range(200)]
    elif case == "small":
        rows = [(0, [0.5, -0.5]), (20, [0.25, 0.1]), (3, [0.0, 0.0])]
    else:
        nan, inf = float("nan"), float("inf")
        rows = ([(int(i), [float(x) for x in rng.normal(size=3)]) for i in range(70)]
                + [(20, None), (40, [nan, 1.0, 1.0]), (41, [inf, 1.0, 1.0]), (60, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (80, [1.0]), (81, [2.0]),
                   (100, []), (101, []), (5, [9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0]), (20, [0.0, 0.0, 0.0])])
    df = spark.createDataFrame([(i, v, 1, 1, "x", "y") for i, v in rows], VECS)
    want = plain_top(rows, lambda i: i % 20 == 0, 20)
    assert Counter(map(tuple, bit_slices.top_k(df, F.col("vec_id") % 20 == 0).collect())) == want
    vectors = bit_slices.integer_vectors(df, "vec_id", "embedding")
    index = bit_slices.build_index(vectors, block_rows=33)
    got = bit_slices.search(index, vectors.where("vec_id % 20 = 0"), 20, slab=6)
    assert Counter(map(tuple, got.collect())) == want


def test_bit_slices_of_nothing(spark):
    df = spark.createDataFrame([], VECS)
    assert bit_slices.top_k(df, F.col("vec_id") % 20 == 0).collect() == []
    assert bit_slices.top_k(spark.createDataFrame([(1, [1.0], 1, 1, "x", "y")], VECS), F.col("vec_id") % 20 == 0).collect() == []
