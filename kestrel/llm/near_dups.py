"""Near-duplicates by bottom-k sketches from one hash function.

A text's shingles are hashed once; the k smallest values are its sketch and
equal sets are one class. The k smallest values of two sketches together are
a uniform sample of the union, and those in both sketches estimate the
similarity. A pair at the threshold has at least ``least_shared`` of them in
common (but for a chance below ``MISS``), so it must share one of the first
k - least_shared + 1 retained values in any fixed order: classes are listed
under these values only, rarest first. For sets of at most k shingles the
sketch is the whole set and the bound is exact.

Lists are not expanded into pairs. Each list has a hub, the class with most
common values (so lists of one group mostly have the same), and the classes of
all lists with one hub are a star group. First every class is compared with
its hubs only: linear work, which joins all but the outer members of a group
of near copies into one component. Then the loose members, those still outside
their hub's component, meet the members of their groups in blocks bounded in
classes and bytes; a key of that join holds one loose block and up to ``RUN``
member blocks, and a block pair sends on one link for each loose class and
component at most. Two classes of a list are both in its hub's group, so no
pair that might link two components is left out. Estimates come from the
sketches; links are confirmed on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import drop_table, fresh, materialize, row_key
from kestrel.llm.components import star_components

SKETCH = 64
MISS = 1e-8
BLOCK = 128  # classes of a block
BLOCK_BYTES = 4 << 20  # and bytes of their sets; a larger set is a block of its own size
RUN = 16  # member blocks that meet a loose block under one key
_WORDS_KEPT = 150_000
_word_hash: dict[bytes, int] = {}


def least_shared(k: int, percent: int, miss: float = MISS) -> int:
    """Largest t for which a pair at the threshold shares fewer than t of the
    k smallest values of its union with a chance of ``miss`` at most."""
    p, below, t = percent / 100, 0.0, 0
    while (below := below + comb(k, t) * p**t * (1 - p) ** (k - t)) <= miss:
        t += 1
    return t


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``: A-Z
    lower-cased, words split at ``[\\x20\\x09-\\x0D]``; with fewer words than
    ``width`` the whole sequence is the one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    known = _word_hash
    if len(known) > _WORDS_KEPT:
        known.clear()
    h = np.array([known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w) or 1) for w in words], np.uint64)
    span = min(width, len(words))
    acc = np.full(len(words) - span + 1, span, np.uint64)
    for j in range(span):
        acc = (acc ^ h[j:len(h) - span + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(32)
    return np.unique(acc.view(np.int64))


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cid, sketch = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                cid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                sketch.append(s[:k])
            flat = np.concatenate(sketch) if sketch else np.empty(0, np.int64)
            ends = np.cumsum([0, *map(len, sketch)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cid, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                ["doc", "rk", "n", "cid", "sketch"])
    return run


def _sets(width: int):
    """(cid, n, text) to (cid, n, codes): the whole set as sorted bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["cid", "n", "codes"])
    return run


def _least_common(n: int, k: int, shared: int, percent: int) -> int:
    """Values that the sketch of a set of n must have in common with that of
    a partner: exact if all possible partners' sketches are whole sets."""
    return -(-n * percent // 100) if n * 100 <= k * percent else shared


def _linked(a: np.ndarray, b: np.ndarray, k: int, shared: int, percent: int) -> bool:
    """The estimate from the k smallest values of the union, then the sets."""
    x, y = a[:k], b[:k]
    last = np.union1d(x, y)[:k][-1]
    both = np.intersect1d(x, y, assume_unique=True)
    if np.searchsorted(both, last, "right") < min(_least_common(len(a), k, shared, percent), _least_common(len(b), k, shared, percent)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(k: int, shared: int, percent: int):
    """Rows (hub, cid, hub's codes, codes) to the linked pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i in range(batch.num_rows) if _linked(
                np.frombuffer(batch.column(2)[i].as_buffer(), np.int64), np.frombuffer(batch.column(3)[i].as_buffer(), np.int64), k, shared, percent)]
            out = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], ["a", "b"])
    return run


class _Block:
    """Sets of a block, to be counted against one set at a time."""

    def __init__(self, members: list[dict], k: int):
        self.cid = np.array([m["cid"] for m in members], np.int64)
        self.comp = np.array([m["comp"] for m in members], np.int64)
        sets = [np.frombuffer(m["codes"], np.int64) for m in members]
        self.sets, self.size = sets, np.array([len(x) for x in sets])
        self.whole, self.short = self._index(sets), self._index([x[:k] for x in sets])

    def _index(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    def shared(self, index: tuple[np.ndarray, np.ndarray], a: np.ndarray) -> np.ndarray:
        """How many values of ``a`` each set of the block has."""
        values, owner = index
        lo, hi = np.searchsorted(values, a, "left"), np.searchsorted(values, a, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return np.bincount(owner[at], minlength=len(self.sets))


def _compare(k: int, shared: int, percent: int):
    """Rows (loose block, member block) to links between components: for each
    loose class one of each component that it is linked with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                loose, block = _Block(batch.column(0)[i].as_py(), k), _Block(batch.column(1)[i].as_py(), k)
                for cid, comp, a in zip(loose.cid, loose.comp, loose.sets):
                    fit = (block.comp != comp) & (100 * np.minimum(block.size, len(a)) >= percent * np.maximum(block.size, len(a)))
                    if not fit.any():
                        continue
                    least = np.array([min(_least_common(len(a), k, shared, percent), _least_common(n, k, shared, percent)) for n in block.size])
                    fit &= block.shared(block.short, a[:k]) >= least
                    if not fit.any():
                        continue
                    both = block.shared(block.whole, a)
                    fit &= 100 * both >= percent * (block.size + len(a) - both)
                    _, first = np.unique(block.comp[fit], return_index=True)
                    out.extend((int(cid), int(x)) for x in block.cid[fit][first])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
    return run


def _prefix_lists(classes: DataFrame, k: int, shared: int, percent: int) -> DataFrame:
    """(v, cid, n, common): classes under the rarest of their retained values
    that a partner must share one of; values of two classes or more."""
    posts = classes.select("cid", "n", F.explode("sketch").alias("v"))
    often = materialize(posts.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    # sets well below k are known whole, and so are those of all their possible partners
    whole = F.col("n") * 100 <= k * percent
    size = F.least(F.col("n"), F.lit(k))
    needed = F.when(whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(shared))
    by_rarity = Window.partitionBy("cid").orderBy("df", "v")
    ranked = posts.join(often, "v").select(
        "v", "cid", "n", F.row_number().over(by_rarity).alias("r"),
        F.count("*").over(Window.partitionBy("cid")).alias("common"))
    once = size - F.col("common")  # values of no other class come first
    lists = materialize(ranked.where(F.col("r") + once <= size - needed + 1).select("v", "cid", "n", "common"))
    drop_table(often)
    return lists


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc, rk, n_shingles, component_id, kept) for every row of ``df``; ``rk``
    is its ``row_key``.

    Rows with 100 · |A ∩ B| >= percent · |A ∪ B| are linked;
    ``component_id`` is the smallest id reachable and ``kept`` says that it is
    the row's own. Rows without words (null and empty texts) are linked with
    nothing. Repeated rows and rows that share an id are rows of their own
    (both are kept if theirs is the smallest id). Null ids count as larger than
    all; a component without any id has a null ``component_id`` and keeps its
    rows. An empty table gives none. Extra columns are not read.
    """
    shared = least_shared(k, percent)
    rows = materialize(df.select(F.col(id_col).cast("bigint").alias("doc"), row_key(id_col, text_col).alias("rk"),
                                 F.col(text_col).alias("text"))
                       .mapInArrow(_sketches(width, k), "doc bigint, rk bigint, n bigint, cid bigint, sketch array<bigint>"))
    classes = rows.where("n > 0").select("cid", "n", "sketch").dropDuplicates(["cid"])
    lists = _prefix_lists(classes, k, shared, percent)
    hubs = (lists.groupBy("v").agg(F.max(F.struct("common", F.bitwise_not("cid").alias("low"), "n")).alias("top"), F.count("*").alias("c"))
            .where("c > 1").select("v", F.bitwise_not("top.low").alias("hub"), F.col("top.n").alias("hub_n")))
    hubs = materialize(hubs)  # a table, so that the lists of a value in very many classes can be split
    group = materialize(lists.join(hubs, "v").where("hub <> cid").select("hub", "cid", "n", "hub_n").distinct())
    parts = materialize(_members(df, rows, group, width, id_col, text_col))
    sets = parts.select("cid", "codes")
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    stars = (group.where(fits).select("hub", "cid").join(sets, "cid")
             .join(sets.select(F.col("cid").alias("hub"), F.col("codes").alias("hub_codes")), "hub").select("hub", "cid", "hub_codes", "codes"))
    links = materialize(stars.mapInArrow(_verify(k, shared, percent), "a bigint, b bigint"))
    first = materialize(star_components(links))
    late = _loose_links(group, sets, first, k, shared, percent)
    roots = star_components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
    ids = rows.select("doc", "rk", F.col("n").alias("n_shingles"), "cid")
    ids = materialize(ids.join(roots, ids["cid"] == roots["node"], "left")
                      .select("doc", "rk", "n_shingles", "cid", F.coalesce("root", "cid").alias("root")))
    least = materialize(ids.where("root is not null").groupBy(F.col("root").alias("own")).agg(F.min("doc").alias("least")))
    for t in (rows, lists, hubs, group, parts, links, first, late, roots):
        drop_table(t)
    out = ids.join(least, F.col("root") == F.col("own"), "left")
    component = F.when(F.col("cid").isNull(), F.col("doc")).otherwise(F.col("least"))
    return out.select("doc", "rk", "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))


def _members(df: DataFrame, rows: DataFrame, group: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, n, codes) of the classes in groups, one row each."""
    wanted = group.select("cid").unionByName(group.select(F.col("hub").alias("cid"))).distinct()
    one = (rows.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("doc", "rk", "n")).alias("one"))
           .select("cid", "one.*"))
    text = df.select(F.col(id_col).cast("bigint").alias("d"), row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    got = one.join(text, F.col("doc").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("k"))).select("cid", "n", "text")
    return got.mapInArrow(_sets(width), "cid bigint, n bigint, codes binary").dropDuplicates(["cid"])


def _loose_links(group: DataFrame, sets: DataFrame, roots: DataFrame, k: int, shared: int, percent: int) -> DataFrame:
    """Links of the members that are outside their hub's component with the
    other members of their groups."""
    root = roots.select("node", "root")
    at = (group.select("hub", "cid", "n").join(root, group["cid"] == F.col("node"), "left").withColumn("comp", F.coalesce("root", "cid"))
          .select("hub", "cid", "n", "comp"))
    of_hub = root.select(F.col("node").alias("h"), F.col("root").alias("hub_root"))
    at = materialize(at.join(of_hub, F.col("hub") == F.col("h"), "left")
                     .select("hub", "cid", "n", "comp", (F.col("comp") != F.coalesce("hub_root", "hub")).alias("loose")))
    is_loose = F.when(F.col("loose"), F.lit(1))
    size = materialize(at.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("mn"), F.count(is_loose).alias("l"), F.sum(is_loose * F.col("n")).alias("ln"))
                       .where("l > 0 and m > 1")
                       .select("hub", *[F.ceil(F.greatest(F.col(c) / BLOCK, F.col(c + "n") * 8 / BLOCK_BYTES)).alias(c + "bs") for c in ("m", "l")]))
    deal = [F.pmod(F.xxhash64("cid"), F.col(c + "bs")).alias(c + "b") for c in ("m", "l")]
    dealt = at.join(size, "hub").select("hub", "cid", "comp", "loose", "mbs", "lbs", *deal).join(sets, "cid")
    one = F.struct("cid", "comp", "codes")
    members = (dealt.groupBy("hub", "mb").agg(F.collect_list(one).alias("members"), F.max("lbs").alias("lbs"))
               .select("hub", F.floor(F.col("mb") / RUN).alias("run"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lbs") - 1)).alias("lb"), "members"))
    loose = (dealt.where("loose").groupBy("hub", "lb").agg(F.collect_list(one).alias("loose_members"), F.max("mbs").alias("mbs"))
             .select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("mbs") - 1) / RUN))).alias("run"), "lb", "loose_members"))
    links = materialize(members.join(loose, ["hub", "run", "lb"]).select("loose_members", "members")
                        .mapInArrow(_compare(k, shared, percent), "a bigint, b bigint").distinct())
    drop_table(at)
    drop_table(size)
    return links


def drop_near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is their component's smallest."""
    gone = near_duplicates(df, width, percent, id_col=id_col, text_col=text_col).where("not kept")
    rk = fresh(df.columns, "rk_")
    keyed = df.withColumn(rk, row_key(id_col, text_col))
    gone = gone.select(F.col("doc").alias("gone_doc"), F.col("rk").alias("gone_rk")).distinct()
    hit = F.col(id_col).cast("bigint").eqNullSafe(F.col("gone_doc")) & (F.col(rk) == F.col("gone_rk"))
    return keyed.join(gone, hit, "left_anti").drop(rk)
