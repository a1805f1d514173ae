"""Main text of web pages: block zones by markup, and a suffix array for each
host that finds what its pages repeat.

1. A scanner cuts each page into text blocks and gives every block a zone from
   the elements around it: ``main`` (article, main), ``chrome`` (menus,
   headers, footers, sidebars, notices, adverts, forms, comments) or ``open``.
2. The words of all blocks outside ``main`` are the page's stream. A host's
   suffix array is the suffixes of its pages' streams in order of their words:
   a range partition by (host, suffix) and a sort inside, for every host.
   Neighbours from pages of different text whose common prefix is ``RUN_TOKENS``
   words or more are a repeated substring; all maximal repeats are unions of
   such beginnings, so suffixes are cut behind that many words (a word is a
   64-bit code). A whole block of ``BLOCK_TOKENS`` words or more that two pages
   have is a repeat too. Pages whose text outside chrome is the same are copies
   and cover nothing of each other. Pages without a host share nothing.
3. Words covered by repeats are boilerplate. Open blocks keep their unique
   runs; chrome goes even if unique (a menu that only one page has). Of a main
   part, blocks that consist of repeated runs go if they stand in ``ARTICLES``
   articles or more: a notice inside the article. Passages that only articles
   share stay (copies of an article are articles), and so does the beginning
   of an article that sidebars repeat as a teaser.

A task reads its range of suffixes once and holds two of them, so a passage
that a third of a host's pages share is a long run of one task and no group in
memory.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import materialize

RUN_TOKENS = 20
BLOCK_TOKENS = 5  # a whole block repeats from so many words on
ARTICLES = 3  # a notice inside main parts stands in so many articles (told apart by their first block)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements whose content is not text of the page: up to their end tag, or else to the end of the page ...
_RAW = frozenset("script style title iframe textarea".split())
#: ... or up to the end of the element around them, or to the main part if they lack an end tag (an option: to the next tag).
_HIDDEN = frozenset("noscript template object svg math select button canvas audio video".split())
#: Elements that do not end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike "
                    "strong sub sup time tt u var wbr input".split())
_SPACE = frozenset(("br", "img", "input", "wbr"))
_HOLDERS = frozenset("article main section div nav header footer aside form ul ol dl table menu dialog figure details fieldset body".split())
_MAIN = frozenset(("article", "main"))
_CHROME = frozenset(("nav", "footer", "aside", "menu", "dialog", "form"))
_MAIN_ROLES = frozenset(("main", "article"))
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CHROME_WORDS = frozenset("ad ads advert adverts advertisement adbox banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
                          "sidebar aside footer header masthead topbar cookie cookies consent notice gdpr popup modal overlay newsletter subscribe "
                          "signup login search share sharing social related recommended comment comments disqus respond replies widget pagination".split())
_LAYOUT = re.compile(r"(?:has|with|no|without|is)[-_]")
_MAIN_WORDS = frozenset("article content main post entry story".split())
_HIDDEN_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_HIDDEN))})(?=[\s/>])[^>]*>?", re.I)
_raw_end: dict[str, re.Pattern] = {}


def _zone(name: str, attrs: str, inside: str) -> str:
    """Zone of an element's content, given that around it. Chrome holds for
    all inside, but a form or header may hold the main part, and so may what is
    chrome by its class only (``named``: main parts in it are ``inner``) or
    hidden and lacks its end tag. Main by class only is ``classed``."""
    if inside == "chrome":
        return inside
    words: set[str] = set()
    if attrs:
        for key, *values in _ATTR.findall(attrs):
            value = "".join(values).lower()
            if key.lower() == "role":
                if value in _CHROME_ROLES:
                    return "chrome"
                if value in _MAIN_ROLES:
                    return "inner" if inside in ("named", "inner") else "main"
            elif key.lower() in ("class", "id") and name != "body":
                # a layout's name says what stands inside or beside ("has-sidebar"), not what it is
                words.update(w for part in value.split() if not _LAYOUT.match(part) for w in re.split(r"[^a-z]+", part))
    part = inside in ("main", "inner", "classed")
    if words & _CHROME_WORDS and not (part and "header" in words):
        return "hidden" if inside == "hidden" else "named" if inside in ("open", "soft", "named") else "chrome"
    if inside == "hidden" and name not in _MAIN:
        return inside
    if name in _CHROME:
        return "soft" if name == "form" and inside == "open" else "chrome"
    if name == "header":
        return inside if part or inside == "named" else "soft"
    if name in _MAIN:
        return "inner" if inside in ("named", "inner") else "main"
    if words & _MAIN_WORDS and inside in ("open", "soft"):
        return "classed"
    return inside


def _settle(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """One kind of main part a page: elements and roles; else what is main by
    class, if that is most of the page's text; else main parts in a wrapper
    that is chrome by class. The other kinds are open and chrome text."""
    size = {"main": 0, "classed": 0, "inner": 0, "open": 0}
    for z, t in found:
        if z in size:
            size[z] += len(t)
    if size["main"]:
        main = "main"
    elif size["classed"] > size["open"] + size["inner"]:
        main = "classed"
    else:
        main = "inner"
    plain = {main: "main", "open": "open"}
    return [(plain.get(z, "open" if z == "classed" else "chrome"), t) for z, t in found]


def _closed(page: str) -> dict[int, int]:
    """Where hidden elements that have an end tag begin, to where they end."""
    starts: dict[str, list[int]] = {}
    out = {}
    for m in _HIDDEN_TAG.finditer(page):
        name = m[2].lower()
        if m[1]:
            if starts.get(name):
                out[starts[name].pop()] = m.end()
        elif not m[0].endswith("/>"):
            starts.setdefault(name, []).append(m.start())
    return out


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of the page's blocks with text, in order: character
    references decoded, white space made one space, trimmed."""
    if not page:
        return []
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    zone, shown, buffer, pos, n = "open", "open", [], 0, len(page)

    def end_block() -> None:
        if buffer:
            text = " ".join(html_lib.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((shown, text))

    def add(text: str) -> None:
        nonlocal shown
        if zone != "hidden":
            shown = zone
            buffer.append(text)

    search, closed = _TAG.search, None
    while pos < n:
        m = search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos:m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in _RAW:
            if not m[1] and not m[3].endswith("/"):
                if name not in _raw_end:
                    _raw_end[name] = re.compile(rf"</{name}\b[^>]*>?", re.I)
                close = _raw_end[name].search(page, pos)
                pos = close.end() if close else n
            continue
        if name in _INLINE:
            if name in _SPACE:
                add(" ")
            continue
        if name == "option":
            if not m[1]:
                following = search(page, pos)
                pos = following.start() if following else n
            continue
        hides = name in _HIDDEN
        if hides and not m[1]:
            if m[3].endswith("/"):
                continue
            if closed is None:
                closed = _closed(page)
            if m.start() in closed:
                pos = closed[m.start()]
                continue
            stack.append((name, zone))
            if zone != "chrome":
                zone = "hidden"
            continue
        if not hides and zone != "hidden":
            end_block()
        if not hides and name not in _HOLDERS:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    zone = stack[i][1]
                    del stack[i:]
                    break
        else:
            stack.append((name, zone))
            around, zone = zone, _zone(name, m[3], zone)
            if around == "hidden" and zone != "hidden":
                end_block()
        if not hides and zone != "hidden":
            end_block()
    end_block()
    return _settle(out)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _kept(found: list[tuple[str, str]]) -> tuple[bool, list[str]]:
    """Whether the page marks a main part, and the blocks of that, or else the
    open ones."""
    main = [t for z, t in found if z == "main"]
    return bool(main), main or [t for z, t in found if z == "open"]


def _runs(host: str, words: list[str], starts: Iterable[int], run_tokens: int) -> list[int]:
    """Codes of the runs that begin at the given words."""
    return [_hash(f"{host}\n{' '.join(words[i:i + run_tokens])}") for i in starts]


_FOUND = ("host string, key bigint, marked boolean, content bigint, head bigint, stream array<bigint>, runs array<bigint>, places array<int>, "
          "blocks array<struct<h:bigint,lo:int,hi:int>>, passages array<struct<lo:int,hi:int,runs:array<bigint>>>")
_BLOCKS = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
_PASSAGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("runs", pa.list_(pa.int64()))]))


def _scan(run_tokens: int):
    """What the repeats need of every page: its stream as word codes, the runs
    and blocks in it, and the blocks of the main part as the runs they consist
    of. Ranges count the words of the blocks to keep (main, or else open)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(8)]
            for host, page in zip(batch.column(0).to_pylist(), batch.column(2)):
                found = blocks(page.as_py())
                marked, kept = _kept(found)
                words, before, whole, passages, k = [], [0], [], [], 0
                for t in kept if marked else ():
                    inner, lo = t.split(), k
                    k += len(inner)
                    if len(inner) >= run_tokens:
                        starts = [*range(0, len(inner) - run_tokens, run_tokens), len(inner) - run_tokens]
                        passages.append({"lo": lo, "hi": k, "runs": list(dict.fromkeys(_runs(host, inner, starts, run_tokens)))})
                for z, t in found:
                    if z != "main":
                        inner, lo = t.split(), before[-1]
                        words += inner
                        before.extend(range(lo + 1, lo + len(inner) + 1) if z == "open" else [lo] * len(inner))
                        if len(inner) >= BLOCK_TOKENS:
                            whole.append({"h": _hash("\n" + t), "lo": lo, "hi": before[-1]})
                for column, value in zip(out, (
                        marked, _hash("\n".join(t for z, t in found if z != "chrome")), _hash(kept[0]) if kept else None, [_hash(w) for w in words],
                        _runs(host, words, range(len(words) - run_tokens + 1), run_tokens), None if marked else before, whole, passages)):
                    column.append(value)
            types = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), _BLOCKS, _PASSAGES]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(out, types))],
                                             ["host", "key", "marked", "content", "head", "stream", "runs", "places", "blocks", "passages"])
    return run


def _suffixes(run_tokens: int):
    """(host, suffix, content, run) of every position that ``run_tokens`` words
    follow: the suffix as far as it matters, its first words' codes in bytes
    (equal words, equal bytes)."""
    width = 8 * run_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, content, stream, runs in zip(*(c.to_pylist() for c in batch.columns)):
                codes = np.array(stream, ">i8").tobytes()
                for at in range(0, len(runs), 5_000):
                    to = min(at + 5_000, len(runs))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([host] * (to - at), pa.string()), pa.array([codes[8 * i:8 * i + width] for i in range(at, to)], pa.binary()),
                         pa.array([content] * (to - at), pa.int64()), pa.array(runs[at:to], pa.int64())],
                        ["host", "suffix", "content", "run"])
    return run


def _common(a: bytes, b: bytes) -> int:
    """Words that two suffixes have in common at their beginning."""
    n = 0
    while n < len(a) and a[n:n + 8] == b[n:n + 8]:
        n += 8
    return n // 8


def _repeated(run_tokens: int):
    """Suffixes in order of host, words and page to the runs of those whose
    common prefix with a neighbour from another page is long, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, told = None, None
        for batch in batches:
            found = []
            for host, suffix, content, code in zip(*(c.to_pylist() for c in batch.columns)):
                if (before is not None and before[0] == host and before[2] != content and told != (host, suffix)
                        and _common(before[1], suffix) >= run_tokens):
                    told = host, suffix
                    found.append(code)
                before = host, suffix, content
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["run"])
    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pages without their covered words."""
    for batch in batches:
        texts = []
        for page, covered in zip(batch.column(2), batch.column(3).to_pylist()):
            _, kept = _kept(blocks(page.as_py()))
            if covered:
                drop, k, parts, kept = {i for r in covered for i in range(r["lo"], r["hi"])}, 0, kept, []
                for part in parts:
                    words = part.split()
                    left = [w for i, w in enumerate(words, k) if i not in drop]
                    k += len(words)
                    if left:
                        kept.append(" ".join(left))
            texts.append("\n\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, run_tokens: int = RUN_TOKENS, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    ``text``: the blocks of the main part joined by two newlines, without the
    notices that its host repeats outside main parts; of a page that marks
    none, the open blocks without what its host repeats (in pages of either
    kind): runs of ``run_tokens`` words and whole blocks. Null and empty pages
    have an empty text. Pages of one host with the same text outside chrome
    count once for repeats, and each is returned; pages whose url is null or
    has no host keep their blocks whole. An empty table gives an empty one;
    extra columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"),
                       F.xxhash64(id_col, url_col, html_col).alias("key"), F.col(html_col).alias("html"))
    id_type = src.schema["page_id"].dataType.simpleString()
    found = materialize(src.where("host <> ''").select("host", "key", "html").mapInArrow(_scan(run_tokens), _FOUND))
    # the suffix array of every host; pages without a host share nothing
    array = (found.select("host", "content", "stream", "runs").mapInArrow(_suffixes(run_tokens), "host string, suffix binary, content bigint, run bigint")
             .repartitionByRange("host", "suffix").sortWithinPartitions("host", "suffix", "content"))  # equal suffixes are in one range
    repeats = materialize(array.mapInArrow(_repeated(run_tokens), "run bigint"))
    # pages without a main part: runs and blocks with open words in them
    plain = found.where("not marked")
    asked = plain.select("key", "places", F.posexplode("runs").alias("at", "run")).select(
        "key", "run", F.expr("places[at]").alias("lo"), F.expr(f"places[at + {run_tokens}]").alias("hi")).where("lo < hi")
    asked = asked.join(repeats, "run", "left_semi").select("key", "lo", "hi")
    blocks_twice = (found.select("host", "content", F.inline("blocks")).groupBy("host", "h")
                    .agg(F.min("content").alias("least"), F.max("content").alias("most")).where("least <> most").select("host", "h"))
    asked_blocks = plain.select("host", "key", F.inline("blocks")).where("lo < hi").join(blocks_twice, ["host", "h"], "left_semi").select("key", "lo", "hi")
    # main parts: blocks all of whose runs are repeats that stand in several articles; first those that begin with a repeat
    begun = materialize(found.where("marked").select("key", "head", F.inline("passages")).withColumn("run", F.col("runs")[0])
                        .join(repeats, "run", "left_semi").select("key", "head", "lo", "hi", "runs"))
    inner = begun.select("key", "head", "lo", "hi", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    spread = inner.groupBy("run").agg(F.count_distinct("head").alias("articles")).where(F.col("articles") >= ARTICLES).select("run")
    notices = (inner.join(repeats, "run", "left_semi").join(spread, "run", "left_semi").groupBy("key", "lo", "hi", "n")
               .agg(F.count_distinct("run").alias("met")).where("met = n").select("key", "lo", "hi"))
    covered = materialize(asked.unionByName(asked_blocks).unionByName(notices).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("covered")))
    texts = src.join(covered, "key", "left").select("page_id", "url", "html", "covered").mapInArrow(_texts, f"page_id {id_type}, url string, text string")
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
