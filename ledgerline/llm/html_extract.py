"""HTML extraction by template deduction from equivalence classes of tokens.

A page is a sequence of tokens: tags, told apart by their path of open
elements, and text blocks, told apart by path and text. On pages of one host:

1. Each token's occurrence vector (how often it occurs on which page) is
   reduced to a 64-bit fingerprint that combines by XOR, so the vectors of a
   host with a third of all pages are aggregated map-side and never meet.
2. Tokens with equal vectors form an equivalence class. A class is valid if
   its tokens cover nearly all pages of the host and there are at least two.
   Valid classes nest: a token hangs below the token of the element around
   it, up to the page itself. What is reached from the page in this way is
   the host's template; a token in an element that is none goes with it.
3. What is not template is a slot. Slots inside elements that are no article
   (menus, headers, footers, side bars, notices, adverts, forms, scripts,
   styles, reader comments) are dropped.
4. The region of the article follows from where the host's text stands. An
   article or main element that holds template text only is template if the
   host's slots hold more text than it. If the slots beside the other ones
   hold no more text than these, they are the region of the pages that have
   one; otherwise their names are wrong and all slots of the page are. What
   stands in the region, block by block, is the main text.

A text block is template only if it stands on nearly all pages of a host
with at least ``MIN_PAGES`` pages, once each, beside other such tokens: an
article that a few pages share is a slot. Copies of a page count as one page,
and a block inside an article or main element is template only with the whole
element (4). A host with fewer pages has no classes: there the elements decide.

Defined results: null or empty html gives the empty text; a null url belongs
to the host "". Repeated rows give a row each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded, content_key, stored

MIN_PAGES = 10
SUPPORT = 0.95
FLUSH_TOKENS = 200_000
# The templates are broadcast only below this many bytes; otherwise they are joined by host.
TEMPLATE_BYTES = 16 << 20

# Elements and class / id / role words that are no part of an article.
OUTSIDE = set("nav footer aside form button select option menu dialog label fieldset head title datalist".split())
OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs footer header masthead sidebar aside widget related recommended cookie cookies consent "
    "notice notices alert popup modal dialog overlay comment comments disqus reply replies share sharing social "
    "newsletter subscribe subscription signup login search pagination pager toolbar complementary contentinfo".split())
OUTSIDE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sidebar", "sponsor")
# Inside an article only these names say so: a word like related or search may belong to the article's subject.
INSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs footer sidebar cookie cookies consent notice notices popup modal comment comments disqus share newsletter subscribe "
    "subscription pagination pager".split())
INSIDE_STARTS = OUTSIDE_STARTS
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",),
               "option": ("select",)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.I)
VALUES = re.compile(r"\"[^\"]*\"|'[^']*'")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# a layout that has (or lacks) a side bar is no side bar
LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_]\S+", re.I)


def outside_name(given: str, inside: bool = False) -> bool:
    """Whether class, id or role words name something that is no part of an article (``inside`` one: beyond doubt)."""
    found = [w.lower() for w in NAME_WORDS.findall(LAYOUT.sub(" ", given))]
    names, starts = (INSIDE_WORDS, INSIDE_STARTS) if inside else (OUTSIDE_WORDS, OUTSIDE_STARTS)
    return any(w in names or w.startswith(starts) for w in found)


def host(url: Column) -> Column:
    """Lower-case authority part of a URL; "" if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def parse(html: str) -> tuple[list[str], list[tuple[str, str, bool, str]], bool]:
    """Paths of the tags, the text blocks (path, text, outside, path of the outermost article or main element around or "")
    and whether there is such an element."""
    paths: list[str] = []
    blocks: list[tuple[str, str, bool, str]] = []
    # open elements: (tag, path, outside, path of the main element)
    stack: list[tuple[str, str, bool, str]] = [("", "", False, "")]
    held: list[str] = []
    has_main = False

    def flush():
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                _, path, out, main = stack[-1]
                blocks.append((path, text, out, main))

    def close(tag: str, until: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    for m in TOKEN.finditer(html):
        text = m.group(5)
        if text is not None:
            held.append(text)
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append("\n")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if m.group(2):
            close(tag)
            continue
        if block:
            close("p", ("article", "main", "section", "div", "td", "li", "body", "blockquote", "figure"))
            if tag in CLOSES_SELF:
                close(tag, CLOSES_SELF[tag])
        _, path, out, main = stack[-1]
        attrs = m.group(4)
        name = tag
        if attrs:
            given = " ".join(a or b or c for a, b, c in ROLE.findall(attrs))
            if given:
                name = f"{tag}.{given.replace('>', ' ')}"
                # the page itself may carry any name; an outermost article too, if it is no comment
                inside = any(e[0] == "article" for e in stack)
                if tag == "article" and not inside:
                    out = out or any(w.lower().startswith("comment") for w in NAME_WORDS.findall(given))
                elif tag not in ("html", "body", "main") and outside_name(given, inside):
                    out = True
            if HIDDEN.search(VALUES.sub("", attrs)):
                out = True
        if tag in OUTSIDE or (tag == "header" and not main):
            out = True
        path = f"{path}>{name}"
        if tag in ("article", "main") and not out:
            main, has_main = main or path, True
        paths.append(path)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append((tag, path, out, main))
    flush()
    return paths, blocks, has_main


def slots(html: str | None, fixed: frozenset[int] = frozenset(), whole_page: bool = False) -> str:
    """Main text of a page; ``fixed`` and ``whole_page`` as in ``regions``."""
    if not html:
        return ""
    _, blocks, has_main = parse(html)
    found = [(path, t, main) for path, t, out, main in blocks if not out]
    left = [(t, main) for path, t, main in found if not (fixed and text_token(path, t) in fixed)]
    # a page whose articles are all template has none
    if has_main and not whole_page and (any(main for _, main in left) or not any(main for *_, main in found)):
        left = [(t, main) for t, main in left if main]
    return "\n".join(t for t, _ in left)


def _hash(value: str) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def text_token(path: str, text: str) -> int:
    return _hash(f"{path}\0{text}")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, key, html): one row for each content of a host; ``key`` identifies it.

    Contents are told apart by 128 bits and counted without their bytes; only pages that have copies are grouped.
    """
    a, b = content_key(F.col("html"))
    rows = pages.select(host(F.col("url")).alias("host"), a.alias("key"), b.alias("key2"), "html")
    same = ["host", "key", "key2"]
    copied = bounded(stored(rows.groupBy(*same).count().where("count > 1").drop("count")))
    once = rows.join(copied, same, "left_anti")
    return once.unionByName(rows.join(copied, same, "left_semi").dropDuplicates(same)).select("host", "key", "html")


TOKENS = ("host string, token bigint, path string, parent bigint, article bigint, pages bigint, uses bigint, vector bigint, "
          "chars bigint, claimed bigint")


def token_vectors(pages: DataFrame, all_texts: bool = False) -> DataFrame:
    """(host, token, path, parent, article, pages, uses, vector, chars, claimed): each token's occurrence vector over
    distinct pages, fingerprinted.

    ``path`` is set for tags, null for text blocks; ``parent`` is the token of
    the element around. The token of the empty path stands on every page
    once, so its ``pages`` counts the host's pages. Texts of pages with an
    article or main element take part only with ``all_texts``; ``article`` is
    then the token of the outermost such element around the text. ``chars``
    are the characters of the text, or of all texts of the page or the
    outermost article (other tags: 0), ``claimed`` those of them in articles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        root = _hash("")

        def out():
            rows = [(h, t, *v) for (h, t), v in found.items()]
            found.clear()
            cols = list(zip(*rows)) if rows else [()] * 10
            types = (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 7)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                              names=["host", "token", "path", "parent", "article", "pages", "uses", "vector",
                                                     "chars", "claimed"])

        for b in batches:
            for h, key, html in zip(*(c.to_pylist() for c in b.columns)):
                paths, blocks, has_main = parse(html or "")
                # token: (path, parent, article), uses, chars, claimed
                counts: dict[int, list] = {root: [("", None, None), 1, 0, 0]}
                for p in paths:
                    k = _hash(p)
                    counts.setdefault(k, [(p, _hash(p.rpartition(">")[0]), None), 0, 0, 0])[1] += 1
                for p, t, outside, main in blocks:
                    if outside or has_main and not all_texts:
                        continue
                    k, n, up = text_token(p, t), len(t), _hash(main) if main else None
                    c = counts.setdefault(k, [(None, _hash(p), up), 0, 0, 0])
                    c[1] += 1
                    for c in (c, counts[root], *([counts[up]] if main else ())):
                        c[2] += n
                        c[3] += n if main else 0
                for t, (where, n, chars, claimed) in counts.items():
                    v = found.setdefault((h, t), [*where, 0, 0, 0, 0, 0])
                    v[3] += 1
                    v[4] += n
                    v[5] ^= _hash(f"{key}/{n}")
                    v[6] += chars
                    v[7] += claimed
                if len(found) > FLUSH_TOKENS:
                    yield out()
        yield out()

    # path, parent and article follow from the token
    return (distinct_pages(pages).mapInArrow(run, TOKENS).groupBy("host", "token", "path", "parent", "article")
            .agg(F.sum("pages").alias("pages"), F.sum("uses").alias("uses"), F.expr("bit_xor(vector)").alias("vector"),
                 F.sum("chars").alias("chars"), F.sum("claimed").alias("claimed")))


def nested(tokens: DataFrame) -> DataFrame:
    """The rows of ``tokens`` (host, token, path, parent, ...) that hang together from the page down, with their ``depth``.

    A tag's path names all elements around it, so one equi-join finds which of them are among ``tokens``; a text
    goes with its parent.
    """
    tags = tokens.where(F.col("path").isNotNull())
    steps = F.split("path", ">")
    above = F.when(F.col("path") != "", F.transform(F.sequence(F.lit(1), F.size(steps) - 1),
                                                    lambda i: F.array_join(F.slice(steps, F.lit(1), i), ">")))
    each = tags.select("host", "token", F.explode_outer(above).alias("up"))
    found = tags.select("host", F.col("path").alias("up"), F.lit(1).alias("here"))
    # the page itself has nothing above
    whole = stored(each.join(found, ["host", "up"], "left").groupBy("host", "token")
                   .agg(F.count(F.col("up")).alias("depth"), F.count("here").alias("n"))
                   .where(F.col("depth") == F.col("n")).select("host", "token", "depth"))
    texts = tokens.where(F.col("path").isNull()).join(
        whole.select("host", F.col("token").alias("parent"), (F.col("depth") + 1).alias("depth")), ["host", "parent"])
    return tags.join(whole, ["host", "token"]).unionByName(texts)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT, all_texts: bool = False) -> DataFrame:
    """(host, host_pages, token, path, parent, pages, uses, vector, class_size, depth, article, chars, claimed): the nested
    tokens of the valid classes.

    Rows of one class share (pages, uses, vector); ``parent`` is the token of
    the element around, ``depth`` the level below the page (depth 0). The
    other columns and ``all_texts`` are as in ``token_vectors``.
    """
    # fewer pages than this can't be nearly all of a host's: drop the tail of unique texts early
    often = stored(token_vectors(pages, all_texts).where(F.col("pages") >= min_pages))
    hosts = often.where(F.col("path") == "").select("host", F.col("pages").alias("host_pages"))
    known = often.join(hosts, "host").where(F.col("pages") >= support * F.col("host_pages"))
    # an element stands for its start and its end tag
    sizes = known.groupBy("host", "pages", "uses", "vector").agg(
        F.sum(F.when(F.col("path").isNull(), 1).otherwise(2)).alias("class_size"))
    valid = stored(known.join(sizes, ["host", "pages", "uses", "vector"]).where(F.col("class_size") >= 2))
    return nested(valid).select("host", "host_pages", "token", "path", "parent", "pages", "uses", "vector", "class_size", "depth",
                                "article", "chars", "claimed")


def regions(found: DataFrame) -> DataFrame:
    """(host, fixed, whole_page) of stored ``templates`` of all texts, for each host where they change what elements say.

    ``fixed`` are the text tokens to drop: those outside articles, and those
    of articles that hold nothing else and less than the host's slots.
    ``whole_page`` says that the other articles hold less text than the slots
    beside them, so that all slots are the region.
    """
    same = found.where(F.col("path").isNull() & (F.col("uses") == F.col("pages")))
    told = same.groupBy("host").agg(F.sum("chars").alias("a"), F.sum(F.col("chars") - F.col("claimed")).alias("b"))
    # characters of all slots, of those beside articles, and of the articles
    hosts = (found.where(F.col("path") == "").join(told, "host", "left")
             .select("host", (F.col("chars") - F.coalesce("a", F.lit(0))).alias("slots"),
                     (F.col("chars") - F.col("claimed") - F.coalesce("b", F.lit(0))).alias("beside"), "claimed"))
    held = same.groupBy("host", "article").agg(F.sum("chars").alias("held"))
    vacant = (found.where(F.col("path") != "").select("host", F.col("token").alias("article"), "chars")
              .join(held, ["host", "article"]).where(F.col("chars") == F.col("held"))
              .join(hosts.select("host", "slots"), "host").where(F.col("slots") > F.col("held")).select("host", "article", "held"))
    drop = (same.where(F.col("article").isNull()).select("host", "token")
            .unionByName(same.join(vacant, ["host", "article"], "left_semi").select("host", "token")))
    return (hosts.join(drop.groupBy("host").agg(F.collect_list("token").alias("fixed")), "host", "left")
            .join(vacant.groupBy("host").agg(F.sum("held").alias("emptied")), "host", "left")
            .select("host", "fixed", (F.col("beside") > F.col("claimed") - F.coalesce("emptied", F.lit(0))).alias("whole_page"))
            .where(F.col("whole_page") | F.col("fixed").isNotNull()))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    found = stored(templates(pages, min_pages, support, all_texts=True))
    where = stored(regions(found))
    weight = where.agg(F.sum(F.length("host") + 8 * F.coalesce(F.size("fixed"), F.lit(0)) + 16)).first()[0] or 0
    by_host = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    side = F.broadcast(where) if weight <= TEMPLATE_BYTES else where
    src = by_host.join(side, "host", "left").select("page_id", "url", "html", "fixed", "whole_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [slots(h, frozenset(f or ()), bool(w)) for h, f, w in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return src.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
