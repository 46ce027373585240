"""Main text of web pages by equivalence classes of tokens across a host's pages.

Tokens are block elements, told apart by their path from the root (names, classes
and ids, with digits blurred), and texts of blocks at their path. A token's
occurrence vector says how often each page of the host has it. Tokens of equal
vectors form a class; a class that is in nine tenths of the host's pages, once in
each, is part of the template. Such classes nest by their paths: the deepest of
their elements that still holds nearly all of the host's text outside menus and
the like is the core of the page. The slot that the pages fill with their article
is the core, or the smallest element around it beside which no text varies: a
place outside the core is the template's if most of its words stand there in nine
tenths of the pages, two pages at least, or most of its texts on several pages of
any hosts, as adverts do, or if its class or id names it so. A text that stands
at the same place in nine tenths of ``LEAST_PAGES`` pages or more is part of the
template, not of a slot. What remains in the slot is extracted.

Within the core no names decide: only elements that HTML itself sets apart (nav,
aside, form and the like, and the roles and the attribute that say the same) go,
with scripts, styles and other content that is no text.

Vectors are never built. Two tokens have the same vector if the sums of the hashes
of (page, count) agree, which is an aggregation with partial sums, so a host with
a third of all pages is no single task's work. A page is its content: pages that
a host has several times count once, for which only they are shuffled. A host's
template is a few dozen numbers; the table of them is broadcast if its size is
under a bound and joined otherwise. A host of one page goes the same way.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Batches, arrow_map, materialize, small_slices

#: HTML elements by their part in the text.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address hr fieldset center details summary hgroup search "
    "nav header footer aside form menu dialog head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog head".split())
CONTAINERS = frozenset("html body main article section div td".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri\w+|"
    r"share|sharing|social|related|sidebar|comments?|disqus|replies|nav\w*|menu|breadcrumbs?|footer|masthead|topbar|toolbar|widget\w*|login|signup)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe|noscript|template)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
HOST = r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)"  # of a URL; pages without one are one host's
ROOT = 1
SLICE = 2_000_000  # bytes of pages worked on at a time
OFTEN = 3  # pages of any hosts that have a text beside their cores which is no page's own
LEAST_PAGES = 3  # pages that can show which texts are the template's


@lru_cache(maxsize=100_000)
def _child(parent: int, step: str) -> int:
    """Signed 64-bit number of a path."""
    return np.array(xxhash.xxh64_intdigest(step.encode(), seed=parent & (1 << 64) - 1), np.uint64).view(np.int64).item()


@lru_cache(maxsize=100_000)
def _element(name: str, attributes: str) -> tuple[str, bool, bool]:
    """(step of the path, whether HTML sets it apart, whether its class or id says that it is no text)."""
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)} if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    apart = name in ASIDE or "hidden" in found or found.get("role", "").lower() in ROLES
    named = bool(ASIDE_NAMES.search(names)) and name not in ("body", "html", "article", "main")
    return f"{name}.{re.sub(r'[0-9]+', '0', names)}", apart, named


def blocks(page: str) -> tuple[list[tuple[tuple[int, ...], bool, bool, str]], dict[int, list]]:
    """Text blocks (paths that hold it, whether it is set apart, whether by name, text), and the block elements: path -> [count, depth, name]."""
    stack: list[tuple[str, int, bool, bool]] = [("", ROOT, False, False)]
    out, elements, buffer = [], {}, []

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                out.append((tuple(x[1] for x in stack), *stack[-1][2:], text))

    def text(part: str) -> None:
        if part:
            buffer.append(entities.unescape(part) if "&" in part else part)

    def pop_to(names: set[str], fence: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in fence:
                return

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            if m["raw"] is None:
                continue
            buffer.append(" ")
            continue
        name = name.lower()
        if name not in BLOCKS:
            if name in ("br", "img"):
                buffer.append(" ")
            continue
        flush()
        if m["end"]:
            pop_to({name})
            continue
        if name in VOID:
            continue
        if name in CLOSES:
            pop_to(CLOSES[name], frozenset(("ul", "ol", "table", "dl")))
        pop_to({"p"}, frozenset(("div", "article", "section", "main", "body", "td", "li", "blockquote")))
        if name == "body" or name == "html":
            pop_to({"head"})
        step, apart, named = _element(name, m["attributes"].strip())
        if name == "header" and not any(x[0] in ("article", "main") for x in stack):
            apart = True
        path = _child(stack[-1][1], step)
        stack.append((name, path, apart or stack[-1][2], named or stack[-1][3]))
        seen = elements.setdefault(path, [0, len(stack), name])
        seen[0] += 1
    text(page[at:])
    flush()
    return out, elements


def _token(path: int, text: str) -> int:
    return _child(path, "=" + text)


def _tokens(repeated):
    """Rows (host, token, kind, depth, place, pages, once, high, low, chars), added up within the task.

    Input: (key, host, html); pages whose key the filter ``repeated`` holds are left out.
    kind: 0 the host itself, 1 and 2 an element that may be a slot, 4 another element, 3 a text,
    6 a place of text outside the page's core (7 if its names set it apart), 5 a word and 8 a text there. The core is the deepest element with
    nearly all text; the depth of such a place is that of the deepest element around both.
    ``high`` and ``low`` are sums of halves of hashes, which no table is large enough to overflow.
    """

    def run(batches: Batches) -> Batches:
        held: dict[tuple, list[int]] = {}

        def rows() -> pa.RecordBatch:
            keys, values = list(zip(*held, strict=True)), list(zip(*held.values(), strict=True))
            held.clear()
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            cols = [pa.array(k, t) for k, t in zip(keys, kinds, strict=True)] + [pa.array(v, pa.int64()) for v in values]
            return pa.RecordBatch.from_arrays(cols, names=["host", "token", "kind", "depth", "place", "pages", "once", "high", "low", "chars"])

        for batch in small_slices(batches, "html", SLICE):
            if repeated is not None:
                batch = batch.filter(pa.array(~bloom.holds(repeated.value, batch.column(0).to_numpy().view(np.uint64))))
            for number, host, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for key, n, c in _page_tokens(host, page or ""):
                    sig = xxhash.xxh64_intdigest(f"{number}/{n}", seed=7)
                    row = held.get(key)
                    if row is None:
                        held[key] = [1, int(n == 1), sig >> 32, sig & 0xFFFFFFFF, c]
                    else:
                        row[0] += 1
                        row[1] += n == 1
                        row[2] += sig >> 32
                        row[3] += sig & 0xFFFFFFFF
                        row[4] += c
                if len(held) > 200_000:
                    yield rows()
        if held:
            yield rows()

    return run


def _page_tokens(host: str, page: str) -> list[tuple[tuple, int, int]]:
    """((host, token, kind, depth, place), how often, letters) of one page."""
    found, elements = blocks(page)
    chars: dict[int, int] = {}
    texts: dict[tuple[int, str], int] = {}
    for paths, apart, named, text in found:
        if not apart:
            for p in paths if not named else ():
                chars[p] = chars.get(p, 0) + len(text)
            texts[paths[-1], text] = texts.get((paths[-1], text), 0) + 1
    these = [((host, ROOT, 0, 0, 0), 1, chars.get(ROOT, 0))]
    these += [((host, p, 1 if name in ("article", "main") else 2 if name in CONTAINERS else 4, depth, 0), n, chars.get(p, 0)) for p, (n, depth, name) in elements.items()]
    these += [((host, _token(p, t), 3, 0, 0), n, 0) for (p, t), n in texts.items()]
    outside: dict[tuple, list[int]] = {}
    for key, size in _outside(found, elements, chars):
        x = outside.setdefault((host, *key), [0, 0])
        x[0] += 1
        x[1] += size
    return these + [(key, n, c) for key, (n, c) in outside.items()]


def _repeated(keys) -> object:
    """The pages whose key the filter holds."""

    def run(batches: Batches) -> Batches:
        for batch in small_slices(batches, "html", SLICE):
            yield batch.filter(pa.array(bloom.holds(keys.value, batch.column(0).to_numpy().view(np.uint64))))

    return run


def _outside(found: list, elements: dict[int, list], chars: dict[int, int]) -> list[tuple[tuple[int, int, int, int], int]]:
    """((token, kind, depth, place), letters) of the words and texts outside the page's core and of their places."""
    whole = chars.get(ROOT, 0)
    core = max((p for p, (n, _, name) in elements.items() if n == 1 and name in CONTAINERS and chars.get(p, 0) >= 0.8 * whole), key=lambda p: elements[p][1], default=None)
    around = next((x[0][: elements[core][1] + 1] for x in found if not x[1] and core in x[0]), None) if core and whole else None
    out = []
    for paths, apart, named, text in found if around else ():
        if not apart and core not in paths:
            depth = sum(x == y for x, y in zip(paths, around, strict=False)) - 1
            size = len(text) - text.count(" ")
            out.append(((paths[-1], 7 if named else 6, depth, paths[-1]), size))
            if not named:
                out.append(((_child(ROOT, text), 8, depth, paths[-1]), size))
                out += [((_child(paths[-1], "w=" + w), 5, depth, paths[-1]), len(w)) for w in text.split()]
    return out


def _templates(groups: Batches) -> Batches:
    """For each host its slot (the path of an element, 0 for none) and the texts of its template."""
    for batch in groups:
        hosts, slots, texts = [], [], []
        for host, pages, chars, members in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            classes: dict[tuple[int, int], list[dict]] = {}
            for t in members:
                if t["kind"] in (1, 2, 4) and t["once"] == t["pages"]:
                    classes.setdefault((t["high"], t["low"]), []).append(t)
            # a class of one token says nothing, unless the host has one page
            valid = [t for c in classes.values() if len(c) > 1 or pages == 1 for t in c]
            full = [t for t in valid if t["kind"] in (1, 2) and chars and t["chars"] >= 0.8 * chars]
            named = [t for t in full if t["kind"] == 1]
            best = min(named, key=lambda t: (t["depth"], t["token"])) if named else max(full, key=lambda t: (t["depth"], t["token"]), default=None)
            # up to where nothing that varies stands beside it; places of mostly the same words are the template's
            same: dict[tuple[int, int], int] = {}
            often: dict[tuple[int, int], int] = {}
            for t in members:
                if t["kind"] == 5 and pages > 1:
                    same[t["place"], t["depth"]] = same.get((t["place"], t["depth"]), 0) + t["chars"]
                if t["kind"] == 8:
                    often[t["place"], t["depth"]] = t["chars"]
            beside = [t for t in members if t["kind"] in (6, 7) and best and t["depth"] < best["depth"]]
            own = {t["place"] for t in beside if t["kind"] == 6 and 2 * max(x.get((t["place"], t["depth"]), 0) for x in (same, often)) < t["chars"]}
            if own:
                need = min(t["depth"] for t in beside if t["place"] in own)
                best = max((t for t in full if t["depth"] <= need), key=lambda t: t["depth"], default=None)
            hosts.append(host)
            slots.append(best["token"] if best else 0)
            texts.append([t["token"] for t in members if t["kind"] == 3] + sorted({t["place"] for t in beside} - own))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(slots, pa.int64()), pa.array(texts, pa.list_(pa.int64()))], names=["host", "slot", "texts"])


def templates(pages: DataFrame) -> DataFrame:
    """``host, slot, texts`` of all hosts; ``pages`` has (host, html)."""
    schema = "host string, token long, kind int, depth int, place long, pages long, once long, high long, low long, chars long"
    keyed = pages.select(F.xxhash64("host", "html").alias("key"), "host", F.coalesce("html", F.lit("")).alias("html"))
    several = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated_pages")
    if several.isEmpty():
        found = arrow_map(keyed, _tokens(None), schema)
    else:
        keys = pages.sparkSession.sparkContext.broadcast(bloom.build(several, "key"))  # 8 MB at most
        again = arrow_map(keyed, _repeated(keys), keyed.schema).dropDuplicates(["key"])
        found = arrow_map(keyed, _tokens(keys), schema).unionByName(arrow_map(again, _tokens(None), schema))
    tokens = found.groupBy("host", "token", "kind", "depth", "place").agg(
        *(F.sum(c).alias(c) for c in ("pages", "once", "high", "low", "chars"))
    ).where(f"kind <> 3 or pages >= {LEAST_PAGES}")
    tokens = materialize(tokens, "page_tokens")
    # texts beside the cores that stand on many pages of any hosts are adverts, notices and the like
    apart = tokens.where("kind = 8").select("token", "host", "depth", "place", "pages", "chars")
    widely = apart.groupBy("token").agg(F.sum("pages").alias("n")).where(f"n >= {OFTEN}").select("token")
    apart = apart.join(widely.hint("merge"), "token").groupBy("host", "depth", "place").agg(F.sum("chars").alias("chars"))
    zero = F.lit(0).cast("long")
    apart = apart.select("host", F.col("place").alias("token"), F.lit(8).alias("kind"), "depth", "place", *(zero.alias(c) for c in ("pages", "once", "high", "low")), "chars")
    hosts = tokens.where("kind = 0").select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    often = tokens.where("kind not in (0, 8)").unionByName(apart).join(hosts, "host").where(f"kind in (6, 7, 8) or pages >= 0.9 * all_pages and (kind <> 3 or all_pages >= {LEAST_PAGES})")
    # nine tenths of the pages hold each of these: not many more than one page has
    members = often.groupBy("host").agg(F.collect_list(F.struct("token", "kind", "depth", "place", "pages", "once", "high", "low", "chars")).alias("members"))
    both = hosts.join(members, "host", "left").select("host", "all_pages", "all_chars", F.coalesce("members", F.array().cast(members.schema["members"].dataType)).alias("members"))
    return materialize(arrow_map(both, _templates, "host string, slot long, texts array<long>"), "page_templates")


def main_text(page: str, slot: int, template_texts: frozenset[int]) -> str:
    """The text of the page's slot without what HTML sets apart and the template's; of the whole page, without what names set apart too, if it has no slot."""
    found, elements = blocks(page)
    own = slot if slot in elements else ROOT
    kept = [
        t
        for paths, apart, named, t in found
        if own in paths and not apart and not (named and own == ROOT) and not (template_texts and (paths[-1] in template_texts or _token(paths[-1], t) in template_texts))
    ]
    return " ".join(kept)


def _extract(batches: Batches) -> Batches:
    for batch in small_slices(batches, "html", SLICE):
        given = [frozenset(x or ()) for x in batch.column(4).to_pylist()]
        texts = [main_text(h or "", s or 0, t) for h, s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), given, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bound: int = 8_000_000) -> DataFrame:
    """``<id_col>, <url_col>, text`` for every page.

    Null and empty pages give an empty text. Pages without a host in their URL
    (or with a null one) are treated as one host's. Repeated rows are given back as
    often as they come, null ids are kept, empty tables give empty results, other
    columns are ignored. One page has to fit in memory.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), HOST, 1))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host)
    kind = dict(own.dtypes)["id"]
    known = templates(own)
    bytes_ = known.select(F.coalesce(F.sum(F.length("host") + 8 * F.size("texts") + 40), F.lit(0)).alias("b")).first()["b"]
    side = known.withColumnRenamed("host", "own_host")
    if bytes_ <= bound:
        side = F.broadcast(side)
    joined = own.join(side, F.col("host") == F.col("own_host"), "left")
    texts = arrow_map(joined.select("id", "url", "html", "slot", "texts"), _extract, f"id {kind}, url string, text string")
    return texts.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
