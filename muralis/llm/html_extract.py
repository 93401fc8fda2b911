"""Main text of web pages by template deduction from equivalence classes.

The tokens of a page are its elements, each named by its path, and its blocks of text, each named by path and hash. Across the pages of a host, tokens with the same occurrence
vector, how often each page holds them, form an equivalence class: they come from the same part of the host's template.
Valid classes nest; what lies between their tokens are the template's slots. The article's slot is the path of the template
under which most of the host's running text stands, within the template's article elements where it has any: running text is neither the
template's own nor a link. A page's main text is what remains in that slot. Elements that mean something
else (nav, aside, form ...) and containers whose class names say nothing but that (sidebar, cookie-notice ...) are no part
of any slot.

Occurrence vectors are never built: each token keeps the sum of its counts times a random number per page, which is equal
for equal vectors, adds up over tasks, and needs a few bytes per host and token.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.storage import materialise

#: Share of a host's pages that a token must be on to belong to the template.
SUPPORT = 0.01
#: Share of a host's running text that the article's slot must hold where no article element names it.
HOLDS = 0.6
#: The same for a block of text, and the pages that it must be on at least: on fewer, chance and copies of a page repeat text.
TEXT_SUPPORT = 0.5
TEXT_PAGES = 3
#: Elements nested deeper share their parent's path, as browsers nest no deeper either.
DEPTH = 512

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i input ins kbd label mark meter output progress q rp rt ruby s samp select small span strike strong sub sup textarea time tt u var wbr img".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_ITSELF = frozenset("li dt dd tr td th option".split())
DROPPED = frozenset("head nav footer header aside form script style noscript template iframe object svg math button select textarea dialog menu canvas audio video".split())
# Words of class, id and role names that mark what is not the article, and words that say nothing.
DROPPED_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion reactions commentlist nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice notices alert banner comment comments reply replies respond disqus share sharing social newsletter subscribe popup modal related recommended pagination search complementary contentinfo".split())
PLAIN_WORDS = frozenset("wp post thread reader user google area articles bar block body bottom box container content header inner items left link links list outer panel posts right row section slot text title top unit wrap wrapper".split())
ARTICLE_WORDS = frozenset("article entry main post story".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")


def named(tokens: list[str], words: frozenset[str]) -> bool:
    """Whether the names say that an element is one of ``words``, and nothing else: "cookie-notice box", but not "has-sidebar"."""
    parts = [w for t in tokens for w in _WORDS.findall(t)]
    return any(w in words for w in parts) and all(w in words or w in PLAIN_WORDS for w in parts)


class Element:
    """An open element: its path, and whether it or one around it is dropped or an article."""

    __slots__ = ("article", "dropped", "form", "name", "path")

    def __init__(self, name: str, attrs: str, parent: Element | None, depth: int):
        tokens = {kind.lower(): value.strip("\"'").lower().split() for kind, value in _NAMED.findall(attrs)} if attrs else {}
        self.name = name
        label = name + "".join(f".{t}" for t in sorted({re.sub(r"[>#\d]+", "", t) for ts in tokens.values() for t in ts}) if t)
        self.path = label if parent is None else f"{parent.path}>{label}" if depth < DEPTH else parent.path
        within = bool(parent and parent.article)
        region = name in DROPPED and not (name == "header" and within)  # an article's own header holds its title
        if name not in ("html", "body", "main") and not region:
            region = any(named(ts, DROPPED_WORDS) for ts in tokens.values())
        begins = name in ("article", "main")
        # Some sites wrap the whole page in a form: an article within it is none of its fields.
        self.form = not region and not begins and bool(parent and parent.form) or name == "form"
        self.dropped = region or bool(parent and parent.dropped and not (parent.form and begins))
        self.article = begins or within or any(named(ts, ARTICLE_WORDS) for ts in tokens.values())


def walk(page: str):
    """(element or None, text or None) in page order: an element that opens, a block boundary (None, None), or text and its
    element. Unclosed and misnested elements close where browsers close them, save that none is opened again."""
    stack: list[Element] = []
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield (stack[-1] if stack else None), page[at : m.start()]
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name not in INLINE:
            yield None, None
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        closes = "p" if name in ENDS_PARAGRAPH else name if name in ENDS_ITSELF else None
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == closes:
                    del stack[k:]
                    break
                if stack[k].name not in INLINE and stack[k].name != "p":
                    break
        if name not in VOID:
            stack.append(Element(name, m["attrs"], stack[-1] if stack else None, len(stack)))
            yield stack[-1], None
    if at < len(page):
        yield (stack[-1] if stack else None), page[at:]


def _plain(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def text_token(path: str, text: str) -> str:
    """The name of a block of text in an element."""
    return f"{path}>#{xxhash.xxh3_64_hexdigest(text)}"


def text_tokens(page: str):
    """The names of the page's blocks of text outside dropped elements, in page order."""
    path, parts = "", []
    for element, text in walk(page):
        if element is None and text is None:
            if parts and (plain := _plain(parts)):
                yield text_token(path, plain)
            path, parts = "", []
        elif text is not None and not (element and element.dropped):
            if not path and text.strip():
                path = element.path if element else ""
            parts.append(text)
    if parts and (plain := _plain(parts)):
        yield text_token(path, plain)


def _above(path: str):
    """The paths of the elements around ``path``, from the outermost."""
    at = path.find(">")
    while at >= 0:
        yield path[:at]
        at = path.find(">", at + 1)


def blocks(page: str, main: frozenset[str], texts: frozenset[str] = frozenset()) -> list[str]:
    """The page's main text, block by block. ``main``: paths of the template's article slots. On a page without text there, article
    elements count, and without these, all that is not dropped. ``texts``: the template's own blocks of text, which are left out
    unless nothing else is on the page."""
    found: list[tuple[bool, bool, str, bool]] = []
    held: dict[tuple[bool, bool], list[str]] = {}
    path = ""
    inside_of: dict[str, bool] = {}

    def inside(p: str) -> bool:
        if p not in inside_of:
            inside_of[p] = bool(main) and (p in main or any(q in main for q in _above(p)))
        return inside_of[p]

    def close() -> None:
        for (slot, article), parts in held.items():
            if text := _plain(parts):
                found.append((slot, article, text, bool(texts) and text_token(path, text) in texts))
        held.clear()

    for element, text in walk(page):
        if element is None and text is None:
            close()
            path = ""
        elif text is not None and (element is None or not element.dropped):
            if not path and text.strip():
                path = element.path if element else ""
            held.setdefault((element is not None and inside(element.path), bool(element and element.article)), []).append(text)
    close()
    which = 0 if any(slot for slot, *_ in found) else 1 if any(article for _, article, *_ in found) else None
    left = [(f[2], f[3]) for f in found if which is None or f[which]]
    return [t for t, own in left if not own] or [t for t, _ in left]


#: The host of a url, as a pattern of Spark's and of Python's.
_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: str) -> Column:
    """The host of the column ``url``; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def deduce(tokens: list[tuple[str, int, int, int, int, bool, bool]], pages: int) -> dict:
    """The template from (path, vector, total, pages, chars, dropped, article) of a host's tokens.

    Classes are the tokens of one vector. A class is valid if its tokens lie under a token of a valid class or of their own; the
    root class is on every page once. The slot is the template's outermost article elements: those that come once a page where there are
    such, and of several the ones that hold much of the running text. Without any it is the innermost path of valid classes that holds
    most of the running text, and reaches out to the elements that add running text and few links.
    """
    classes: dict[tuple[int, int, int], list[tuple]] = defaultdict(list)
    for row in tokens:
        if row[3] >= max(1, SUPPORT * pages):
            classes[row[1], row[2], row[3]].append(row)
    valid, paths = [], set()
    for key, rows in sorted(classes.items(), key=lambda kv: (-kv[0][2], kv[0][1], min(r[0].count(">") for r in kv[1]))):
        own = {r[0] for r in rows}
        nested = [r[0] for r in rows if ">" not in r[0] or any(p in paths or p in own for p in _above(r[0]))]
        if nested:
            valid.append({"pages": key[2], "total": key[1], "tokens": sorted(nested)})
            paths.update(nested)
    texts = sorted(p for p in paths if ">#" in p and not p.endswith(">#"))
    rows = [r for r in tokens if r[0] in paths and not r[5] and ">#" not in r[0]]
    running, links = defaultdict(int), defaultdict(int)
    for r in rows:
        linked = any(part == "a" or part.startswith("a.") for part in r[0].split(">"))
        for p in (*_above(r[0]), r[0]):
            (links if linked else running)[p] += r[4]
    top = max(running.values(), default=0)
    holders = [p for p, n in running.items() if n >= HOLDS * top > 0 and p.rpartition(">")[2].partition(".")[0] not in INLINE | {"p", "html", "body"}]
    articles = {r[0]: r for r in rows if r[6] and running[r[0]]}
    outermost = [p for p in articles if not any(q in articles for q in _above(p))]
    # A page has one article: elements that come once a page go before those that repeat, such as teasers and readers' remarks.
    once = [p for p in outermost if articles[p][2] <= articles[p][3]] or outermost
    if once:
        most = max(running[p] for p in once)
        return {"main": sorted(p for p in once if running[p] >= (1 - HOLDS) * most), "texts": texts, "classes": valid}
    if not holders:
        return {"main": [], "texts": texts, "classes": valid}
    slot = max(holders, key=lambda p: (p.count(">"), p))
    while (outer := slot.rpartition(">")[0]) in running and outer.rpartition(">")[2].partition(".")[0] not in ("html", "body"):
        if links[outer] - links[slot] > 0.3 * (running[outer] - running[slot] + links[outer] - links[slot]):
            break
        slot = outer
    return {"main": [slot], "texts": texts, "classes": valid}


def host_templates(pages: DataFrame) -> DataFrame:
    """host, template (JSON) from all ``pages`` (url, html)."""
    fields = "host string, path string, vector long, total long, pages long, chars long, dropped boolean, article boolean"

    def tokens(batches):
        for batch in batches:
            sums: dict[tuple[str, str], list] = {}
            for url, page, url_host in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                host, page = url_host or "", page or ""
                counts: dict[str, list] = {}
                for element, text in walk(page):
                    if element is None:
                        continue
                    row = counts.setdefault(element.path, [0, 0, element])
                    if text is None:
                        row[0] += 1
                    else:
                        row[1] += len(text.strip())
                for name in text_tokens(page):
                    counts.setdefault(name, [0, 0, None])[0] += 1
                lot = xxhash.xxh3_64_intdigest((url or "") + "\0" + page) >> 24
                sums.setdefault((host, ""), [0, 0, 0, 0, False, False])[2] += 1
                for path, (n, chars, element) in counts.items():
                    s = sums.setdefault((host, path), [0, 0, 0, 0, bool(element and element.dropped), bool(element and element.article)])
                    s[0] = (s[0] + n * lot) & 0x7FFFFFFFFFFF
                    s[1] += n
                    s[2] += 1
                    s[3] += chars
            keys = list(sums)
            arrays = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys])]
            arrays += [pa.array([sums[k][j] for k in keys], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "path", "vector", "total", "pages", "chars", "dropped", "article"])

    # Sums as decimals: those of very many tasks don't overflow.
    whole = F.pmod(F.sum(F.col("vector").cast("decimal(20,0)")), F.lit(1 << 47).cast("decimal(20,0)")).cast("long")
    sums = pages.select("url", "html", host("url").alias("host")).mapInArrow(tokens, fields).groupBy("host", "path").agg(whole.alias("vector"), *(F.sum(c).alias(c) for c in ("total", "pages", "chars")), *(F.max(c).alias(c) for c in ("dropped", "article")))
    sums = materialise(sums, "page-tokens")
    sizes = sums.filter("path = ''").select("host", F.col("pages").alias("size"))
    # Only tokens on a share of the host's pages remain: a host's group is as large as its template, not as its pages.
    # Text on too few pages goes before the join, which may deal rows by host.
    repeated = sums.filter(~F.col("path").contains(">#") | (F.col("pages") >= TEXT_PAGES))
    kept = repeated.filter("path <> ''").join(sizes, "host").filter(F.col("pages") >= F.when(F.col("path").contains(">#"), F.greatest(F.lit(float(TEXT_PAGES)), TEXT_SUPPORT * F.col("size"))).otherwise(F.greatest(F.lit(1.0), SUPPORT * F.col("size"))))

    def template(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("path", "vector", "total", "pages", "chars", "dropped", "article")), strict=True))
        found = deduce(rows, table.column("size")[0].as_py())
        return pa.table([table.column("host").slice(0, 1), pa.array([json.dumps(found)])], names=["host", "template"])

    return kept.groupBy("host").applyInArrow(template, "host string, template string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null or empty html gives the empty text. Pages without a host share a template. Repeated rows and null ids give a row
    each; pages of any length are read whole; an empty table gives no rows.
    """
    kind = dict(pages.dtypes)["page_id"]
    templates = materialise(host_templates(pages), "templates")

    def extract(batches):
        known: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
        for batch in batches:
            texts = []
            for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                main = known.get(template) if template else (frozenset(), frozenset())
                if main is None:
                    if len(known) > 10_000:
                        known.clear()
                    found = json.loads(template)
                    main = known[template] = frozenset(found["main"]), frozenset(found["texts"])
                texts.append(" ".join(blocks(page or "", *main)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # Spark broadcasts the templates only if their files are small enough, and else splits a hot host's pages.
    rows = pages.select("page_id", "url", "html", host("url").alias("host")).join(templates, "host", "left").select("page_id", "url", "html", "template")
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
