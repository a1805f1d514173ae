"""HTML extraction, toxicity and nearest neighbours against plain versions."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import html_extract, nn_descent, toxicity
from tests.conftest import SF001

PAGES = "page_id bigint, url string, html string, host string, key int, runs int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, 2) for r in rows], PAGES)


MENU = "<nav><ul><li><a href='/a'>Home</a></li><li>Shop now</li></ul></nav>"
FOOT = "<footer>&copy; 2020 example, all rights reserved by us</footer>"


@pytest.mark.parametrize("html, want", [
    (f"<html><head><title>T</title><script>var x='</p>';</script></head><body>{MENU}<div class=\"ad\">Buy</div><article><h1>Big &amp; small</h1>"
     f"<p><b>One<br>two<p>three\n  four</p></article>{FOOT}</body></html>", "Big & small\n\nOne two\n\nthree four"),
    ("<article><p>cut off", "cut off"), ("<article><p>a &lt;b&gt; &#233;&nbsp;&amp c &bogus; &am</p></article>", "a <b> é & c &bogus; &am"),
    ("<main><header><h1>Title</h1></header><p>x</p><aside>side</aside><form>f</form><section id=comments><article class=comment>no</article></section></main>",
     "Title\n\nx"),
    ("<form><main><p>in a form</p></main></form>", "in a form"), ("<article><p>a<!-- <p>no</p> -->b</p><style>p{}</style></article>", "ab"),
    ("<article><div role='navigation'>m</div><p>x</p><div class='share-bar social'>s</div></article><div>after</div>", "x"),
    ("<body class='home sidebar-right'><div class='layout has-sidebar'><article>kept</article><div id='sidebar'>no</div></div>", "kept"),
    ("<div class='cookie-notice'>we use cookies</div><div class='post-content'><p>x</p><div class='ad-box'>buy</div></div>", "x"),
    ("", ""), (None, ""), ("no tags at all", "no tags at all"), ("<p>a < b and <i>c</i></p>", "a < b and c"), ("<<<>>><article", "<<<>>><article"),
])
def test_main_text(spark, html, want):
    got = html_extract.extract_main_text(pages(spark, [(1, "http://h.example/x", html)])).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, want, len(want))]


def test_host_repeats_leave_unmarked_pages(spark):
    shared = "<div>Subscribe to our weekly letter for more of this</div>"
    rows = [(i, "https://Host.example/p", f"<div>Unique story number {i} begins here and {' '.join(f'w{i}x{k}' for k in range(20))}</div>{shared}") for i in range(4)]
    rows += [(10, "https://other.example/", f"<div>Alone</div>{shared}"), (11, None, shared), (None, "nothing", shared), (12, "https://host.example/", f"<article>{shared}</article>")]
    rows += [rows[4], rows[4]]  # a page that is there three times repeats nothing by itself
    got = html_extract.extract_main_text(pages(spark, rows)).collect()
    text = {(r.page_id, r.url): r.text for r in got}
    assert len(got) == len(rows)
    for i in range(4):
        assert text[i, "https://Host.example/p"].startswith(f"Unique story number {i}") and "letter" not in text[i, "https://Host.example/p"]
    assert text[10, "https://other.example/"] == "Alone\n\nSubscribe to our weekly letter for more of this"
    assert text[11, None] == text[None, "nothing"] == "Subscribe to our weekly letter for more of this"  # no host: nothing is shared
    assert text[12, "https://host.example/"].startswith("Subscribe")
    assert html_extract.extract_main_text(pages(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("html, want", [
    ("<datalist><option value=a></datalist><article>kept</article>", "kept"),
    ("<datalist><option>no<option>no</datalist><article>kept</article>", "kept"),
    ("<div><button>no</div><article>kept</article><button>no</button>", "kept"), ("<video src=a><article>kept</article>", "kept"),
    ("<article>a <svg><path d='x'/><text>no</text></svg>b <select><option>no<option>no</select>c</article>", "a b c"),
    ("<template><article>no</article></template><article>kept</article>", "kept"),
    ("<article>kept<canvas>no</article><p>after</p>", "kept"), ("<article>a<noscript><p>no</p></noscript> b</article>", "a b"),
    ("<div class='page sidebar-right'><article>kept</article><p>side</p></div>", "kept"),
    ("<div class=search><div role=main>kept</div></div>", "kept"),
    ("<article>kept</article><div class=related><article>no</article></div>", "kept"),
    ("<article>kept<div class=comments><article>no</article></div></article>", "kept"),
    ("<div class=post>teaser</div><article>kept</article>", "kept"),
    ("<div class=entry>few</div><p>most of this text is open, so it stays</p>", "few\n\nmost of this text is open, so it stays"),
])
def test_markup_rules_keep_articles(html, want):
    found = html_extract.blocks(html)
    kept = [t for z, t in found if z == "main"] or [t for z, t in found if z == "open"]
    assert "\n\n".join(kept) == want


def test_copies_and_phrases_stay(spark):
    story = [" ".join(f"s{i}x{k}" for k in range(60)) for i in range(3)]
    phrase, run = "on the other hand it may well be", " ".join(f"foot{k}" for k in range(html_extract.RUN_TOKENS))
    rows = [(1, "http://c.example/a", f"<p>{story[0]}</p>"), (2, "https://c.example/a", f"<nav>other menu</nav><p>{story[0]}</p>"),
            (3, "http://d.example/1", f"<p>{story[1]} {phrase} end</p><p>one {run}</p>"),
            (4, "http://d.example/2", f"<p>{story[2]} {phrase} fin</p><p>two {run}</p>")]
    text = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
    assert text[1] == text[2] == story[0]  # copies of a page do not cover each other
    assert text[3] == f"{story[1]} {phrase} end\n\none" and text[4] == f"{story[2]} {phrase} fin\n\ntwo"


def plain_covered(pages_, n):
    """Blocks without the words in runs of n, or in whole blocks, that a page
    of other text has too."""
    runs, whole = {}, {}
    for blocks in pages_:
        words = [w for b in blocks for w in b]
        for i in range(len(words) - n + 1):
            runs.setdefault(tuple(words[i:i + n]), set()).add(str(blocks))
        for b in blocks:
            whole.setdefault(tuple(b), set()).add(str(blocks))
    out = []
    for blocks in pages_:
        words = [w for b in blocks for w in b]
        gone = {j for i in range(len(words) - n + 1) if len(runs[tuple(words[i:i + n])]) > 1 for j in range(i, i + n)}
        at, left = 0, []
        for b in blocks:
            if len(b) >= html_extract.BLOCK_TOKENS and len(whole[tuple(b)]) > 1:
                gone |= set(range(at, at + len(b)))
            left.append(" ".join(w for i, w in enumerate(b, at) if i not in gone))
            at += len(b)
        out.append("\n\n".join(x for x in left if x))
    return out


@pytest.mark.parametrize("n", [3, 6])
def test_repeats_against_all_runs(spark, n):
    rng = random.Random(n)
    streams = [[[rng.choice("abc") for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(0, 5))] for _ in range(14)]
    streams += streams[:2]  # copies
    rows = [(i, "http://x.example/", "".join(f"<p>{' '.join(b)}</p>" for b in s)) for i, s in enumerate(streams)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows).repartition(3), run_tokens=n).collect()}
    want = plain_covered(streams, n)
    assert [got[i] for i in range(16)] == want
    whole = ["\n\n".join(" ".join(b) for b in s) for s in streams]
    assert 3 < sum(a != b for a, b in zip(want, whole))  # there are repeats to find
    apart = [(i, None, h) for i, _, h in rows]
    alone = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, apart), run_tokens=n).collect()}
    assert [alone[i] for i in range(16)] == whole


def test_notices_inside_marked_articles(spark):
    notice, shared = (" ".join(f"{w}{k}" for k in range(html_extract.RUN_TOKENS + 7)) for w in ("notice", "passage"))
    lead = [" ".join(f"lead{i}x{k}" for k in range(30)) for i in range(6)]
    page = lambda i, host, side: (i, f"http://{host}/{i}", f"<aside>{side}</aside><article><h1>Story {i}</h1><p>{lead[i]}</p><p>{notice}</p>"  # noqa: E731
                                                           f"<p>{shared}</p><p>End of {i}</p></article>")
    whole = [f"Story {i}\n\n{lead[i]}\n\n{notice}\n\n{shared}\n\nEnd of {i}" for i in range(6)]
    # four articles hold a notice that two pages have in a sidebar, next to a teaser of article 0
    rows = [page(i, "n.example", f"menu {notice} more {lead[0]}" if i < 2 else "menu") for i in range(4)]
    rows += [page(i, "two.example", f"menu {notice}") for i in (4, 5)]  # two articles only
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows).repartition(3)).collect()}
    assert [got[i] for i in range(6)] == [t.replace(notice + "\n\n", "") if i < 4 else t for i, t in enumerate(whole)]
    apart = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, [(i, None, h) for i, _, h in rows])).collect()}
    assert [apart[i] for i in range(6)] == whole  # pages without a host share nothing


def plain_articles(pages_, n):
    """Main parts without the blocks whose runs of n words, laid end to end,
    all stand outside main parts of two texts and in three articles."""
    outside, begun, articles = {}, [], {}
    for side, main in pages_:
        for i in range(len(side) - n + 1):
            outside.setdefault(tuple(side[i:i + n]), set()).add(str(main))
    twice = {r for r, texts in outside.items() if len(texts) > 1}
    tiles = lambda b: [tuple(b[i:i + n]) for i in [*range(0, len(b) - n, n), len(b) - n]] if len(b) >= n else []
    for _, main in pages_:
        for b in main:
            if tiles(b) and tiles(b)[0] in twice:
                for r in tiles(b):
                    articles.setdefault(r, set()).add(str(main[0]))
    gone = lambda b: bool(tiles(b)) and all(r in twice and len(articles.get(r, ())) >= html_extract.ARTICLES for r in tiles(b))
    return ["\n\n".join(" ".join(b) for b in main if not gone(b)) for _, main in pages_]


@pytest.mark.parametrize("n", [3, 4])
def test_marked_pages_against_all_runs(spark, n):
    rng = random.Random(n)
    made = [([rng.choice("ab") for _ in range(rng.randrange(0, 12))], [[rng.choice("ab") for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 6))])
            for _ in range(16)]
    made += made[:2]  # copies
    rows = [(i, "http://x.example/", f"<nav>{' '.join(side)}</nav><main>{''.join(f'<p>' + ' '.join(b) for b in main)}</main>") for i, (side, main) in enumerate(made)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows).repartition(3), run_tokens=n).collect()}
    want = plain_articles(made, n)
    assert [got[i] for i in range(18)] == want
    whole = ["\n\n".join(" ".join(b) for b in main) for _, main in made]
    assert 3 < sum(a != b for a, b in zip(want, whole)) and any(a == b for a, b in zip(want, whole))


def test_long_and_broken_pages_stay_linear():
    assert html_extract.blocks("<div " * 20_000) is not None
    assert html_extract.blocks("<a b='" * 20_000) is not None
    assert len(html_extract.blocks("<div>x" * 5_000)) == 5_000
    assert html_extract.blocks("<article>" + "word " * 200_000)[0][1].count(" ") == 199_999


def labelled(n, seed):
    """Toxic: an insult together with a group; either alone is not."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"filler{rng.randrange(300)}" for _ in range(rng.randrange(3, 30))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += [rng.choice(["zilch", "krud"])] * insult + [rng.choice(["northerners", "southerners"])] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def plain_used(x, y):
    """Used terms, counted row by row."""
    def counted(rows):
        out = {}
        for terms, label in rows:
            for t in terms.tolist():
                out.setdefault(t, [0, 0])[int(1 - label)] += 1
        b = np.array(sorted(out), np.int64)
        ab = np.array([out[t] for t in b.tolist()], float).reshape(-1, 2)
        return b, ab[:, 0], ab[:, 1]

    def beside(seeds, most):
        best = {}
        for s in seeds.tolist():
            inside = [(t, label) for t, label in zip(x, y) if s in t]
            n1 = sum(label for _, label in inside)
            b, a, c = counted(inside)
            for t, chi in zip(b.tolist(), toxicity.chi_square(a, c, n1, len(inside) - n1).tolist()):
                best[t] = max(best.get(t, 0.0), chi)
        b = np.array(sorted(best), np.int64)
        return b, np.array([best[t] for t in b.tolist()])

    return toxicity.used_terms(*counted(zip(x, y)), y.sum(), len(y) - y.sum(), beside)


def fitted(x, y):
    used = plain_used(x, y)
    place = np.full(toxicity.BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    return toxicity.fit([p[p >= 0] for p in (place[t] for t in x)], y, used)


def test_machine_learns_pairs():
    rows = labelled(3000, 1)
    x, y = [toxicity.terms(t) for _, t, _ in rows], np.array([c for *_, c in rows], float)
    m = fitted(x[:2000], y[:2000])
    right = np.mean([(m.score(a) >= 0.5) == b for a, b in zip(x[2000:], y[2000:])])
    m.factors[:] = 0  # the additive part alone
    alone = np.mean([(m.score(a) >= 0.5) == b for a, b in zip(x[2000:], y[2000:])])
    assert right > 0.95 and right > alone


def test_a_term_without_an_effect_of_its_own_enters_a_pair():
    """Toxic: an insult with the group, or a threat without it. The group's
    mention alone says nothing."""
    rng, rows = random.Random(8), []
    for i in range(4000):
        insult, threat, group = rng.random() < 0.3, rng.random() < 0.3, rng.random() < 0.5
        words = [f"filler{rng.randrange(300)}" for _ in range(12)] + ["zilch"] * insult + ["krud"] * threat + ["northerners"] * group
        rng.shuffle(words)
        rows.append((" ".join(words), int((insult and group) or (threat and not group))))
    x, y = [toxicity.terms(t) for t, _ in rows], np.array([c for _, c in rows], float)
    assert set(toxicity.token_terms("northerners")) <= set(plain_used(x[:3000], y[:3000]).tolist())
    m = fitted(x[:3000], y[:3000])
    right = np.mean([(m.score(a) >= 0.5) == b for a, b in zip(x[3000:], y[3000:])])
    m.factors[:] = 0
    alone = np.mean([(m.score(a) >= 0.5) == b for a, b in zip(x[3000:], y[3000:])])
    assert right > 0.95 and right > alone + 0.1


def test_spark_chooses_and_fits_as_the_plain_version(spark):
    """The whole query at sf0.001 against a fit and scores row by row."""
    from kestrel.llm.catalog import op2

    d = SF001
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    marks = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.doc_id in docs]
    learnt = sorted((i, c) for i, c in marks if crc32(str(i).encode()) % 4 != 2 and c in (0, 1))
    model = fitted([toxicity.terms(docs[i]) for i, _ in learnt], np.array([c for _, c in learnt], float))
    got = {r.doc_id: r for r in op2(spark, d).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        assert got[i].score == pytest.approx(model.score(toxicity.terms(text))) and got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (crc32(str(i).encode()) % 4 == 2)
    assert 0 < sum(r.predicted for r in got.values()) < len(got)


def test_ids_with_many_texts_and_ids_of_strings(spark):
    rows = [("a", "krud x"), ("b", "nice y"), ("c", "krud z"), ("d", "kind x")] + [("a", f"krud {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    marks = spark.createDataFrame([(i, int(i in "ac")) for i in "abcd"], "doc_id string, toxic int")
    assert toxicity._sample(docs, marks, "doc_id", "text", "toxic", 2).count() <= 4
    assert toxicity.score_texts(docs, toxicity.fit_on_labels(docs, marks)).count() == 54


def test_pair_sum_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.FactorizationMachine(0.3, np.arange(50), rng.normal(size=50), rng.normal(size=(50, 4)))
    x = np.array([3, 7, 8, 40])
    want = 0.3 + m.weights[x].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(x) for b in x[:i])
    assert m.raw(x) == pytest.approx(want)


def test_scores_of_texts_and_of_terms_agree():
    rows = labelled(800, 4)
    m = fitted([toxicity.terms(t) for _, t, _ in rows], np.array([c for *_, c in rows], float))
    for t in [rows[0][1], rows[1][1].upper(), "krud, (northerners)!", "", None, "  \n"]:
        assert m.score_text(t) == pytest.approx(m.score(toxicity.terms(t)))


DOCS = "doc_id bigint, text string, score string, toxic int"


def test_held_out_rows_do_not_teach(spark):
    rows = labelled(600, 3)
    docs = spark.createDataFrame([(i, t, "s", 9) for i, t, _ in rows], DOCS)
    marks = spark.createDataFrame([(i, c) for i, _, c in rows], "doc_id bigint, toxic int")
    flipped = spark.createDataFrame([(i, 1 - c if crc32(str(i).encode()) % 4 == 2 else c) for i, _, c in rows], "doc_id bigint, toxic int")
    a, b = toxicity.fit_on_labels(docs, marks), toxicity.fit_on_labels(docs.repartition(5), flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()
    got = toxicity.score_texts(docs, a)
    assert got.columns == [*docs.columns, "_score"]


def test_scores_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (None, "krud"), (4, "krud"), (4, "krud"), (5, "x " * 100_000)]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    r = toxicity.score_texts(docs, toxicity.fit_on_labels(docs, none)).collect()
    assert len(r) == 7 and all(0 <= x["_score"] <= 1 for x in r)
    assert toxicity.drop_toxic(docs.where("false"), none).count() == 0
    one = spark.createDataFrame([(1, None), (4, 1), (4, 1), (None, 0), (2, 7)], "doc_id bigint, toxic int")
    assert toxicity.drop_toxic(docs, one, threshold=1.1).count() == 7


def test_real_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit_on_labels(docs, marks)
    r = (toxicity.score_texts(docs.select("doc_id", "text"), model).join(marks, "doc_id")
         .where(toxicity.is_held_out(F.col("doc_id"))).select("score", "toxic").toPandas())
    toxic, clean = r[r.toxic == 1].score, r[r.toxic == 0].score
    assert (toxic >= toxicity.THRESHOLD).mean() > 0.8 and (clean >= toxicity.THRESHOLD).mean() < 0.01


VEC = "vec_id bigint, embedding array<float>, label int, node string, d int"


def brute(rows, every, k):
    out = Counter()
    for q, a in rows:
        if q % every == 0:
            near = sorted((math.dist(a, b), i) for i, b in rows if i != q)[:k]
            out.update((q, r + 1, i, round(s, 9)) for r, (s, i) in enumerate(near))
    return out


def test_small_tables_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [np.float32(rng.gauss(0, 1)) for _ in range(6)]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, rows[3][1])]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    bad = [(300, None), (400, [0.0] * 6), (500, [float("nan")] * 6), (600, [float("inf")] + [1.0] * 5), (700, [None] + [1.0] * 5), (None, [1.0] * 6), (800, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows + bad + rows[:2]], VEC)
    got = Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nn_descent.nearest_neighbours(df, 10).collect())
    assert got == brute(rows, 10, 10)
    assert nn_descent.nearest_neighbours(df.where("false")).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert nn_descent.nearest_neighbours(few, 100).count() == 2
    assert nn_descent.nearest_neighbours(df.where("vec_id = 100 and embedding is not null").limit(1)).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    got = nn_descent.nearest_neighbours(df).toPandas()
    hits = 0
    for q, near in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(set(near.vec_id) & set(ids[np.lexsort((ids, d))[:10]]))
    assert hits >= 0.9 * len(got) and len(got) == 10 * (ids % 100 == 0).sum()


def hits_of_ten(got, x, ids):
    """Share of each query's ten nearest rows (brute force) that ``got`` has."""
    hits = []
    for q, near in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits.append(len(set(near.vec_id) & set(ids[np.lexsort((ids, d))[:10]])) / 10)
    return np.mean(hits)


@pytest.mark.parametrize("kind", ["one large row", "norms far apart", "far from the origin"])
def test_recall_whatever_the_norms(spark, kind):
    p = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    if kind == "one large row":
        x[7, 3] = 1000.0
    elif kind == "norms far apart":
        x *= 10.0 ** np.random.default_rng(2).integers(-6, 7, size=(len(x), 1))
    else:
        x += 1000.0
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>")
    got = nn_descent.nearest_neighbours(df, 20).toPandas()
    assert len(got) == 10 * (ids % 20 == 0).sum()
    assert hits_of_ten(got, x, ids) >= 0.9
