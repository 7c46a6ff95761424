"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: the tag paths of its elements and its text blocks with
their paths.  On the pages of one host, tokens of the same occurrence vector (how often
each page has them) form an equivalence class.  A vector is a fingerprint summed over
pages, so that no host's pages are gathered in one place.  A class is valid if it has
enough pages, and either many tokens, as the parts of one layout, or most of the pages
that have the path around it.  Valid classes nest by their paths: a token belongs to the
template if each path around it, up to the root, is of a valid class.

What stands between the template's paths are slots.  A slot whose blocks are nearly all
of valid classes is constant, and its texts belong to the template; a slot of varying
blocks is content, and nothing of it is constant, even a paragraph that most pages share;
nor are paragraphs, headings, items and cells within article and main elements, so that
copies of one article on most pages of a host stay whole.
Of the remaining slots those under navigation, headers, footers, sidebars, notices,
adverts, forms and reader comments are left out by their tags and names, as their texts
can differ from page to page; the others hold the main text.  If a page has article (or
else main) elements with any text left, only their slots count; articles with less than
half of the main element's text are teasers in it, and all of it counts.

Null and empty pages give an empty text.  Hosts of few pages have no valid class and rely
on tags and names.  Repeated pages count once in the vectors.  A page of any length is
read whole; an empty table gives an empty one.  Extra columns are passed on, whatever
their names; a column of the name of the added one is replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.components import unused, written

#: A valid class: on so many different pages of the host; and this part of those with the path around it, or so many tokens.
LEAST_PAGES, LEAST_PART, LEAST_TOKENS = 8, 0.8, 4
#: The part of a slot's blocks that are of valid classes, from which it is constant.
CONSTANT_PART = 0.8
#: Tokens of templates (8 bytes each) up to this many are broadcast.
BROADCAST_TOKENS = 500_000

# Element names of the HTML standard by their role.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
TEXT_ONLY = {"title", "textarea"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
LEFT_OUT = set("head nav header footer aside form button select option datalist fieldset menu dialog textarea title input label".split())
#: Words of class and id names that mark other content than the article.
NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent"
    " gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments commentlist disqus respond reply replies form toolbar pagination pager skip copyright".split()
)
#: What may stand beside such a word in a name without changing what it is.
GENERIC = set("container wrapper wrap box list item items slot bar block area inner outer top bottom left right primary secondary global site page sub mini small big large fixed sticky panel link links unit text body row col column zone region section group holder set first last fluid desktop mobile".split())
#: Words after or before which a name tells of a state or of what is absent, not of what it holds.
STATES = set("no not non with without has have is are open closed enabled disabled show hide hidden layout theme page".split())
#: Words that make a header that of a post, and elements whose names say nothing of what they hold.
POSTS, WHOLES = {"post", "entry", "article", "story", "content", "section"}, {"html", "body", "main", "article"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT = HEADINGS | {"p", "li", "dd", "dt", "td", "th", "blockquote", "pre", "figcaption"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: An open element of these ends when another of its group begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _other_content(words: list[str]) -> bool:
    """Whether the words of one class or id name other content: as its last word, or beside generic words.

    A word of state makes the name that of something around or beside such content; a
    header of a post is no site header.
    """
    names = NAMES - {"header", "masthead"} if POSTS.intersection(words) else NAMES
    if not names.intersection(words):
        return False
    rest = [w for w in words if w not in names and not w.isdigit()]
    if not STATES.isdisjoint(words[:-1]) or words[-1] in STATES:
        return GENERIC.issuperset(rest) and STATES.isdisjoint(words)
    return words[-1] in names or all(w in GENERIC or w in POSTS for w in rest)


def _marks(attributes: str, whole: bool = False) -> tuple[str, bool]:
    """The class and id as text for the path, and whether role, state or (unless ``whole``) names mark other content."""
    shown, out = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            out |= value.lower() in ROLES
        elif name in ("hidden", "aria-hidden"):
            out |= value.lower() != "false" and (name == "hidden" or value.lower() == "true")
        elif name in ("class", "id"):
            shown.append(value)
            for one in value.split():
                out |= not whole and _other_content([w.lower() for w in _NAME_WORDS.findall(one)])
    return "." + " ".join(shown).replace("/", "_") if shown else "", out


class Page:
    """Tag paths with their counts, and text blocks (path, text, left out, in article, in main)."""

    def __init__(self, source: str):
        self.paths: Counter[str] = Counter()
        self.blocks: list[tuple[str, str, bool, bool, bool]] = []
        #: Open elements: name, path, left out (2: a header within an article), article, main.
        self.stack: list[tuple[str, str, int, bool, bool]] = []
        self.buffer: list[str] = []
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join(html_lib.unescape("".join(self.buffer)).split())
            self.buffer = []
            if text:
                at = next((e for e in reversed(self.stack) if e[0] not in INLINE), ("", "", 0, False, False))
                out = any(e[2] == 1 for e in self.stack)
                if not out and any(e[2] == 2 for e in self.stack):  # of an article's own header the headings stay
                    out = not any(e[0] in HEADINGS for e in self.stack)
                self.blocks.append((at[1], text, out, any(e[3] for e in self.stack), any(e[4] for e in self.stack)))

    def _close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return

    def _read(self, s: str) -> None:
        at = 0
        while m := _TAG.search(s, at):
            if m.start() > at:
                self._text(s[at : m.start()])
            at = m.end()
            if m[2] is None:
                if s.startswith("<![CDATA[", m.start()):
                    self._text(s[m.start() + 9 : at - 3])
                continue
            name = m[2].lower()
            if name not in INLINE:
                self._flush()
            if m[1]:
                self._close(name)
                continue
            if name in RAW or name in TEXT_ONLY:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(s, at)
                    at = end.end() if end else len(s)
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self.buffer.append(" ")
                continue
            if name in ENDS:
                last = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] not in INLINE), None)
                if last is not None and self.stack[last][0] in ENDS[name]:
                    del self.stack[last:]
            elif name not in INLINE:
                for k in range(len(self.stack) - 1, -1, -1):  # a block ends an open paragraph
                    if self.stack[k][0] == "p":
                        del self.stack[k:]
                    elif self.stack[k][0] in INLINE:
                        continue
                    break
            shown, marked = _marks(m[3], name in WHOLES) if m[3] else ("", False)
            parent = next((e[1] for e in reversed(self.stack) if e[0] not in INLINE), "")
            path = parent if name in INLINE else f"{parent}/{name}{shown}"
            own = 2 if name == "header" and any(e[3] for e in self.stack) else int(name in LEFT_OUT)
            self.stack.append((name, path, 1 if marked else own, name == "article", name == "main"))
            if name not in INLINE:
                self.paths[path] += 1
        if at < len(s):
            self._text(s[at:])

    def _text(self, text: str) -> None:
        self.buffer.append(text)


def _token(path: str, text: str | None = None) -> int:
    return xxhash.xxh64_intdigest(path if text is None else f"{path}\x00{text}") - 2**63


def host(url: Column) -> Column:
    """The host of a URL; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def host_key(url: Column) -> Column:
    """A hash of the host, which stands for it in shuffles."""
    return F.xxhash64(host(url))


def page_tokens(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, page, token, within, is_text, n): the tokens of each page; ``within`` is the token of the enclosing path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            batch = batch.drop_duplicates(["host", "page"])
            for h, page, source in zip(batch.host, batch.page, batch.html, strict=True):
                parsed = Page(source or "")
                for path, n in parsed.paths.items():
                    out.append((h, page, _token(path), _token(path.rpartition("/")[0]), False, n))
                for (path, text), n in Counter((b[0], b[1]) for b in parsed.blocks).items():
                    out.append((h, page, _token(path, text), _token(path), True, n))
            yield pd.DataFrame(out, columns=["host", "page", "token", "within", "is_text", "n"])

    rows = pages.select(host_key(F.col(url)).alias("host"), F.xxhash64(F.coalesce(F.col(html), F.lit(""))).alias("page"), F.col(html).alias("html"))
    return rows.mapInPandas(run, "host bigint, page bigint, token bigint, within bigint, is_text boolean, n int")


def token_vectors(tokens: DataFrame) -> DataFrame:
    """(host, token, within, is_text, n_pages, n, vector) of each token of a host."""
    # A page and its exact copies are one: its tokens' counts are equal, and any of them will do.
    once = tokens.groupBy("host", "page", "token", "within", "is_text").agg(F.max("n").alias("n"))
    return once.groupBy("host", "token", "within", "is_text").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"))


def valid_tokens(vectors: DataFrame, least_pages: int = LEAST_PAGES, least_part: float = LEAST_PART, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """The tokens of valid classes, with the number of tokens of their class."""
    size = vectors.where(F.col("n_pages") >= least_pages).groupBy("host", "vector", "n_pages").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum((~F.col("is_text")).cast("int")).alias("n_paths"))
    around = vectors.where("not is_text").select("host", F.col("token").alias("within"), F.col("n_pages").alias("around"))
    # The outermost paths have nothing around them but the host's pages.
    pages = vectors.groupBy("host").agg(F.max("n_pages").alias("host_pages"))
    rows = vectors.join(size, ["host", "vector", "n_pages"]).join(around, ["host", "within"], "left").join(pages, "host")
    return rows.where(((F.col("n_tokens") >= least_tokens) & (F.col("n_paths") > 0)) | (F.col("n_pages") >= least_part * F.coalesce("around", "host_pages"))).drop("around", "host_pages", "n_paths")


def deduce_templates(vectors: DataFrame, constant_part: float = CONSTANT_PART, **settings) -> DataFrame:
    """(host, paths, texts): of each host the paths of valid classes, and the texts of constant slots."""
    valid = valid_tokens(vectors, **settings)
    slots = vectors.where("is_text").groupBy("host", "within").agg(F.sum("n").alias("all"))
    fixed = valid.where("is_text").groupBy("host", "within").agg(F.sum("n").alias("fixed"))
    constant = slots.join(fixed, ["host", "within"]).where(F.col("fixed") >= constant_part * F.col("all")).select("host", "within")
    texts = valid.where("is_text").join(constant, ["host", "within"], "left_semi").groupBy("host").agg(F.collect_set("token").alias("texts"))
    paths = valid.where("not is_text").groupBy("host").agg(F.collect_set("token").alias("paths"))
    return texts.join(paths, "host").select("host", "paths", "texts")


def slots(parsed: Page, paths: set[int], texts: set[int]) -> list[str]:
    """The texts of the slots that hold the main text, in page order."""

    def constant(path: str, text: str, marked: bool) -> bool:
        """Whether the text is of the template, in which each path around it nests in the next."""
        if not texts or _token(path, text) not in texts or (marked and re.split(r"[.]", path.rpartition("/")[2], maxsplit=1)[0] in CONTENT):
            return False
        while path:
            if _token(path) not in paths:
                return False
            path = path.rpartition("/")[0]
        return True

    left = [b for b in parsed.blocks if not b[2] and not constant(b[0], b[1], b[3] or b[4])]
    article, main = ([b[1] for b in left if b[k]] for k in (3, 4))
    # Articles that are a small part of the main element are teasers in it.
    if article and 2 * sum(map(len, article)) >= sum(map(len, main)):
        return article
    return main or article or [b[1] for b in left]


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", to: str = "text") -> DataFrame:
    """Adds the main text of each page."""
    templates = written(deduce_templates(written(token_vectors(page_tokens(pages, url, html)))))
    # The templates are counted before they are sent to all executors.
    # Beyond the bound Spark splits the side of a host that holds a third of all pages.
    n = templates.agg(F.sum(F.size("texts") + F.size("paths"))).first()[0] or 0
    host_, paths, texts = (unused(pages, c) for c in ("host", "paths", "texts"))
    templates = templates.select(F.col("host").alias(host_), F.col("paths").alias(paths), F.col("texts").alias(texts))
    joined = pages.withColumn(host_, host_key(F.col(url))).join(F.broadcast(templates) if n <= BROADCAST_TOKENS else templates, host_, "left")

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, paths, texts in batches:
            none: set[int] = set()
            yield pd.Series([" ".join(slots(Page(s or ""), none if p is None else set(p.tolist()), none if t is None else set(t.tolist()))) for s, p, t in zip(sources, paths, texts, strict=True)])

    return joined.withColumn(to, extract(F.col(html), F.col(paths), F.col(texts))).drop(host_, paths, texts)
