"""Main text of web pages by site template removal.

Every element's subtree is hashed (tags and text, children by their hashes) before any
rule looks at it. Spark counts, per host, on how many different pages each subtree
occurs; one that recurs on MIN_PAGES pages of a host is a template and is deleted
there, whatever its name and however large the host. Elements that HTML itself sets
apart from an article go as well (navigation, forms, scripts and the like), and those
whose class, id or role names them so. No rule by name and no template takes an
element that holds the page's main article or most of the text around it. Where a
page has articles (or else a main part), its text is theirs.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm.common import save

#: A subtree on at least so many different pages of a host is a template.
MIN_PAGES = 4

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
            "table tbody td tfoot th thead tr ul".split())
GONE = set("aside audio button canvas dialog embed footer form head iframe input math menu nav noscript object search select svg template "
           "textarea video script style title noembed noframes datalist".split())
#: Containers that may be templates inside an article, too; its paragraphs are not.
INNER = set("aside details div dl figure form nav ol section table ul".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
PARAGRAPH_ENDS = BLOCK - {"html", "head", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
STOPS = {"table", "td", "th", "article", "body", "html", "button", "div", "section", "main"}

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Words of class names that set an element apart; words that may follow them without a
# meaning of their own; and words that say something else about the element they are on.
APART = set("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dropdown "
            "gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommend "
            "recommendations recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
            "toolbar widget widgets".split())
FILLER = set("area bar block bottom box buttons button card cards col column container content count form group icons inner item items left links list main "
             "outer panel posts post primary row section secondary slot stories story text top articles article title unit wrap wrapper right region x px".split())
ABOUT = set("closed disabled enabled has hide is no none not off on open show with without".split())
SITE = re.compile(r"(?:site|page|global)?[_-]?(?:header|footer)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def set_apart(name: str) -> bool:
    """Whether a class or id names an element as no part of an article.

    Its last word that is not a filler decides: comment-list and social-share-box do,
    share-prices and has-sidebar do not.
    """
    words = [w.lower() for w in WORDS.findall(name)]
    if any(w in ABOUT for w in words):
        return False
    for w in reversed(words):
        if w in APART:
            return True
        if w not in FILLER and not w.isdigit():
            return False
    return False


def rule_of(tag: str, attributes: str, in_article: bool) -> int:
    """2: the markup itself drops the element; 1: its name does; 0: neither."""
    if tag in GONE or (tag == "header" and not in_article):
        return 2
    if not attributes.strip() or tag in ("html", "body", "main"):
        return 0
    have = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in have or have.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", have.get("style", ""), re.I):
        return 2
    names = [*have.get("class", "").split(), *have.get("id", "").split()]
    return int(have.get("role", "").lower() in ROLES or any(SITE.fullmatch(n) or set_apart(n) for n in names))


class Page:
    """One pass over a page: its blocks of text, and its elements with their hashes."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int]] = []  # text; 2 in an article, 1 in a main part
        self.nodes: list[tuple] = []  # tag, first block, end, rule, level, hash
        self.line: list[str] = []
        self.stack: list[tuple] = []  # tag, hasher, first block, rule, level, within what is dropped
        at, end = 0, len(html)
        while at < end:
            m = TOKEN.search(html, at)
            self._text(html[at:m.start() if m else end])
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3] or "")
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = stop.start() if stop else end
            elif tag == "plaintext":
                self._text(html[at:])
                break
        while self.stack:
            self._pop()
        self._flush()

    def _text(self, text: str) -> None:
        if not text:
            return
        text = unescape(text)
        if self.stack:
            if text.strip():
                self.stack[-1][1].update(" ".join(text.split()))
            if self.stack[-1][5]:
                return
        self.line.append(text)

    def _flush(self) -> None:
        if self.line:
            text = " ".join("".join(self.line).split())
            self.line = []
            if text:
                self.blocks.append((text, self.stack[-1][4] if self.stack else 0))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in PARAGRAPH_ENDS:
            self._until("p", STOPS)
        for other in CLOSES.get(tag, ()):
            self._until(other, {"ul", "ol", "dl", "table", "article", "select"})
        if tag == "br":
            self.line.append(" ")
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            if self.stack:
                self.stack[-1][1].update(f"<{tag}>")
            return
        top = self.stack[-1] if self.stack else None
        level, gone = (top[4], top[5]) if top else (0, False)
        rule = rule_of(tag, attributes, level == 2)
        if not gone and rule < 2:
            level = 2 if tag == "article" else max(level, 1 if tag == "main" or "main" in re.findall(r"role\s*=\s*[\"']?(\w+)", attributes) else 0)
        self.stack.append((tag, xxhash.xxh64(tag), len(self.blocks), rule, level, gone or rule == 2))

    def _until(self, tag: str, stops: set) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in stops:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._until(tag, {"article"} if tag not in ("article", "main", "body", "html") else set())
            if tag == "p":
                self._flush()
        else:
            self._until(tag, BLOCK)

    def _pop(self) -> None:
        tag, hasher, first, rule, level, _ = self.stack[-1]
        if tag in BLOCK:
            self._flush()
        self.stack.pop()
        digest = hasher.intdigest()
        if self.stack:
            self.stack[-1][1].update(digest.to_bytes(8, "little"))
        if tag in BLOCK and tag not in ("html", "body", "head"):
            self.nodes.append((tag, first, len(self.blocks), rule, level, digest - (1 << 64) if digest >= 1 << 63 else digest))

    def hashes(self) -> list[int]:
        """Hashes of all elements that hold text, dropped ones too; paragraphs of an article are its own."""
        return list(dict.fromkeys(d for tag, _, _, _, level, d in self.nodes if level < 2 or tag in INNER or tag == "article"))

    def text(self, templates: frozenset = frozenset()) -> str:
        """The page's text without what is set apart by name and without templates."""
        size = [0]
        for text, _ in self.blocks:
            size.append(size[-1] + len(text))
        held = lambda n: size[n[2]] - size[n[1]]
        # Elements are listed as they end, so what holds one comes after it.
        articles = [(k, n) for k, n in enumerate(self.nodes) if n[0] in ("article", "main") and n[3] < 2]
        main_at, main = max(articles, key=lambda a: (a[1][0] == "article", held(a[1])), default=(0, None))
        gone = [False] * len(self.blocks)
        for k, node in enumerate(self.nodes):
            tag, first, end, rule, level, digest = node
            template = digest in templates and (level < 2 or tag in INNER or tag == "article")
            if first == end or not (rule == 1 or template):
                continue
            if main is not None and main_at <= k and first <= main[1] and held(main):
                continue  # it holds the main article
            around = next((a for j, a in articles if j > k and a[0] == "article" and a[1] <= first), None)
            whole = held(around) if around else size[-1]
            if 2 * held(node) > whole and (rule == 1 or around):
                continue  # it holds most of the text around it
            gone[first:end] = [True] * (end - first)
        best = max((level for k, (_, level) in enumerate(self.blocks) if not gone[k]), default=0)
        return "\n\n".join(t for k, (t, level) in enumerate(self.blocks) if level == best and not gone[k])


def host(url) -> F.Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by an empty line).

    A null html is empty and gives an empty text; a page of any length is read whole,
    as one value of one row. Repeated rows each get their text; identical html on a
    host counts as one page, so that copies are no templates. Pages without a host
    share one. Other columns are ignored, whatever their names.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    rows = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))
    seen = rows.select("key", F.xxhash64(host(F.col("url"))).alias("host"), F.xxhash64("html").alias("page"), "html").where("html is not null")

    def hashed(batches):
        for b in batches:
            found = [Page(h.as_py()).hashes() for h in b.column(3)]
            n = [k for k, f in enumerate(found) for _ in f]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(n, pa.int64())) for c in range(3)),
                                              pa.array([h for f in found for h in f], pa.int64())], ["key", "host", "page", "subtree"])

    def extracted(batches):
        for b in batches:
            out = [Page(h.as_py() or "").text(frozenset(t.as_py() or ())) for h, t in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    # Saved, so that pages are parsed once for their hashes and once for their text.
    trees = save(seen.mapInArrow(hashed, "key long, host long, page long, subtree long"))
    often = trees.select("host", "subtree", "page").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    often = often.where(F.col("n") >= min_pages).select("host", "subtree")
    marked = trees.join(often, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("templates"))  # of one page
    known = rows.join(marked, "key", "left").select("page_id", "url", "html", "templates")
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
    return known.mapInArrow(extracted, schema)
