"""What filters do to each other: every order of a set of filters at once.

Each document becomes a mask of the filters it fails, and each part of the
table at most 2^n rows (mask, counts). A part's counts are then a decision
diagram: one level for each filter, two children (passes, fails) at each node,
equal subtrees shared, and the counts of the documents below on every edge's
end. In an order of the filters the path that passes everything shows each
step: what is still there at a level, and what its failing child takes away.
The orders follow one another by swaps of neighbouring filters, and a swap only
remakes the two levels it touches; all others are shared as they are.

Texts are read once, into a slim written table (mask, digest of the text): the
filter on repeated texts needs the smallest id of every text in the table.

Nulls: a null text is empty, a null part is the empty string, and a row with a
null id has no smaller one and is smaller than none. Rows of one id that share
their text do not fail on each other. A document's label counts if any of its
label rows has it; labels of no document are ignored. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import empty_if_null, materialize, words_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Node(NamedTuple):
    """Documents below, and the children that pass and fail the level's
    filter (None: a leaf)."""

    counts: tuple[int, ...]
    passing: "Node | None"
    failing: "Node | None"


class Diagram:
    """Count-weighted decision diagram of the masks of one part."""

    def __init__(self, filters: str, rows: list[tuple[int, tuple[int, ...]]]):
        self.order = list(filters)
        self._made: dict[tuple, Node] = {}
        self.nothing = tuple(0 for _ in rows[0][1])
        by_mask = dict(rows)
        self.root = self._grown(by_mask, 0, 0)

    def node(self, counts: tuple[int, ...], passing: Node | None, failing: Node | None) -> Node:
        """The one node with these children and counts."""
        key = counts, id(passing), id(failing)
        return self._made.setdefault(key, Node(counts, passing, failing))

    def _over(self, passing: Node, failing: Node) -> Node:
        return self.node(tuple(a + b for a, b in zip(passing.counts, failing.counts)), passing, failing)

    def _grown(self, by_mask: dict, level: int, mask: int) -> Node:
        if level == len(self.order):
            return self.node(by_mask.get(mask, self.nothing), None, None)
        return self._over(self._grown(by_mask, level + 1, mask), self._grown(by_mask, level + 1, mask | 1 << level))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one: the nodes of
        these two levels and the paths above are made anew, subtrees below stay."""
        done: dict[int, Node] = {}

        def remade(node: Node, depth: int) -> Node:
            if id(node) not in done:
                if depth < level:
                    done[id(node)] = self._over(remade(node.passing, depth + 1), remade(node.failing, depth + 1))
                else:
                    pp, pf, fp, ff = node.passing.passing, node.passing.failing, node.failing.passing, node.failing.failing
                    done[id(node)] = self._over(self._over(pp, fp), self._over(pf, ff))
            return done[id(node)]

        self.root = remade(self.root, 0)
        self.order[level:level + 2] = self.order[level + 1], self.order[level]

    def all_pass_path(self) -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) of each step."""
        out, node = [], self.root
        for f in self.order:
            out.append((f, node.passing.counts, node.failing.counts))
            node = node.passing
        return out


def swaps_through_all_orders(n: int) -> list[int]:
    """Levels to exchange, one after the other, to visit all n! orders: the
    last element walks through the orders of the others, there and back."""
    if n < 2:
        return []
    inner, out = swaps_through_all_orders(n - 1), []
    for i, last in enumerate([*inner, None]):
        forth = i % 2 == 1
        out += range(n - 1) if forth else range(n - 2, -1, -1)
        if last is not None:
            out.append(last if forth else last + 1)
    return out


def audit(filters: str, rows: list[tuple[int, tuple[int, ...]]]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, then what of
    the other counts is lost, shapley) of every order. ``rows``: mask (bit i: fails
    filter i) and counts, the documents' first."""
    diagram = Diagram(filters, rows)
    fails = {f: sum(c[0] for m, c in rows if m >> i & 1) for i, f in enumerate(filters)}
    only = {f: sum(c[0] for m, c in rows if m == 1 << i) for i, f in enumerate(filters)}
    steps, shapley = [], dict.fromkeys(filters, 0)
    for level in [None, *swaps_through_all_orders(len(filters))]:
        if level is not None:
            diagram.swap(level)
        for step, (f, kept, removed) in enumerate(diagram.all_pass_path(), 1):
            steps.append(("".join(diagram.order), step, f, kept[0], removed))
            shapley[f] += removed[0]
    return [(order, step, kept, removed[0], fails[f] - removed[0], only[f], *removed[1:], shapley[f])
            for order, step, f, kept, removed in steps]


#: The contract's filters: what a document fails on by its own text.
def own_failures(text: Column) -> dict[str, Column]:
    words = words_of(text)
    t = empty_if_null(text)
    n = F.char_length(t)
    upper = n - F.char_length(F.translate(t, UPPER, ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * upper > 2 * n, "D": t.rlike(r"[#$%&*|]")}


def failure_masks(docs: DataFrame, own: dict[str, Column]) -> DataFrame:
    """(doc_id, part, mask): bit i of the mask is set if a document fails
    the i-th filter of ``own``; the bit after those, if a smaller id has the very
    same text."""
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own.values())), F.lit(0))
    slim = materialize(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
                                   F.unhex(F.sha2(empty_if_null("text"), 256)).alias("digest")))
    shared = slim.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return slim.join(shared, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(again, 1 << len(own)).otherwise(0)).alias("mask"))


def part_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those of them whose
    label says so."""
    marks = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COLUMNS[3:])


def interaction_audit(counts: DataFrame, filters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from counts by
    (part, mask)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = audit(filters, [(r["mask"], (r["n"], r["good"], r["toxic"])) for r in rows])
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(found)), pa.array(columns[0]), pa.array(columns[1], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in columns[2:])], COLUMNS)

    parts = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("rows"))
    return parts.mapInArrow(run, _OUT)


def orders(filters: str) -> set[str]:
    return {"".join(p) for p in permutations(filters)}
