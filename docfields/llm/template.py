"""Main text of web pages by deducing the template of each host.

Tokens of a page are its elements (by path) and its text runs (by path and text). Tokens of a host that share their occurrence
vector - how often they occur on each page - form an equivalence class. The vector is kept as a mergeable
fingerprint (xor of a hash of page and count), so a host with a third of all pages is summed up where its pages lie and no
task ever holds it. Members of a class share all that is tested. A class is valid when it stands on at least three pages and half of
the host's pages with the same count on each; classes nest by path, and together they are the template. What is left between template tokens are slots:

* the content slots of a page lie in its <article> (or <main>) element, wherever the template has one, else in the body;
* slots in elements of another role (navigation, header, footer, aside, form, advert, notice, reader comments) are
  no content. <main> has its role wherever it stands; a form, or an <article> in an element that is of another role by its name only,
  counts on pages without other main text if it has more text than the rest;
* text of the template itself is no content either, inside <article> and <main> as elsewhere. An article that repeats as a whole is
  content: what stands on just the pages of one article (its text as a unit) is no template, and where more than half of an
  article would be template (near copies of one article), all of it stays.

The template of a host has as many rows as a page has tokens. All templates together are sent to every task only after a check of their
number; beyond it they are joined by host.

Null html counts as empty and gives an empty text. Without a host in the url a page belongs to the host ''. Equal pages and repeated
page_ids are rows of their own. Unclosed elements end with their parent. Other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import map_rows, stored, table

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)>", re.S
)
RAW = re.compile(r"</(script|style|noscript|template|svg|iframe|textarea|title|object|math|select)\s*>", re.I)
RAW_NAMES = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "math", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img",
}
OTHER_ROLE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head"}
#: Names in class, id or role that give an element another role than content: such words, alone or joined to each other or to words of place.
OTHER_NAME = re.compile(
    r"nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|cookies?|consent|gdpr|notice|alert|banner"
    r"|ads?|advert\w*|sponsor\w*|promo\w*|popup|modal|newsletter|subscribe|signup|login|share|social|related|recommend\w*"
    r"|comments?|replies|disqus|complementary|contentinfo|search", re.I
)
PLACE_NAME = re.compile(r"site|page|main|top|bottom|left|right|box|bar|list|block|section|area|global|primary|secondary|buttons?|links?|form", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: Path of the token that stands for a page's whole main text.
ARTICLE = "#article"
#: Rows of all templates that may be sent to every task.
SENT_ROWS = 200_000


def _is_other(value: str) -> bool:
    for name in value.split():
        parts = [part for part in re.split("[_-]+", name) if part]
        other = [bool(OTHER_NAME.fullmatch(part)) for part in parts]
        if any(other) and all(o or PLACE_NAME.fullmatch(part) for o, part in zip(other, parts)):
            return True
    return False


def _role(name: str, attributes: str, role: str) -> str:
    """Role of an element in one of `role`: 'main', 'other', 'named' (other by its class, id or role), 'inner' (an article in such an element),
    'form' or ''."""
    named = False
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role" and value.lower() == "main":
                return "main"
            named = named or (name not in ("html", "body") and _is_other(value))
    if name == "main":
        return "main"
    if role == "other" or name in OTHER_ROLE - {"form"}:
        return "other"
    if name == "article":
        return "inner" if named or role in ("named", "inner") else "main"
    if name == "form":
        return {"": "form", "main": "other", "inner": "other"}.get(role, role)
    return "named" if named else role


def blocks(page: str | None) -> tuple[list[tuple[str, str, str]], dict[str, int]]:
    """(text blocks as (path, role, text), elements by path with their counts). Roles are those of _role."""
    if not page:
        return [], {}
    found, elements = [], {}
    stack: list[tuple[str, str, str]] = []  # name, path, role
    text: list[str] = []
    place = ("", "")

    def end() -> None:
        plain = " ".join(entities.unescape("".join(text)).split())
        if plain:
            found.append((*place, plain))
        text.clear()

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        block = name not in INLINE
        if block:
            end()
        elif name in ("br", "img"):
            text.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(s[2] != "" for s in stack[i:]):
                        end()
                    del stack[i:]
                    break
        else:
            path, role = (stack[-1][1], stack[-1][2]) if stack else ("", "")
            if block:
                path = f"{path}/{name}"
                elements[path] = elements.get(path, 0) + 1
            own = _role(name, m[3], role)
            if own != role:
                end()  # also where an inline element has a role of its own
                role = own
            if name in RAW_NAMES and not m[3].endswith("/"):
                close = next((r for r in RAW.finditer(page, at) if r[1].lower() == name), None)
                at = close.end() if close else len(page)
                continue
            if name not in VOID and not m[3].endswith("/"):
                stack.append((name, path, role))
        place = (stack[-1][1], stack[-1][2]) if stack else ("", "")
    end()
    return found, elements


def run_token(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}".encode("utf-8", "replace")) >> 1


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _tokens(rows: dict) -> dict:
    out = {k: [] for k in ("host", "page", "token", "path", "is_text", "n")}
    for host, page, text in zip(rows["host"], rows["page"], rows["html"]):
        runs, elements = blocks(text)
        counts: dict[tuple[int, str], int] = {}
        for path, role, run in runs:
            key = (run_token(path, run), path)
            counts[key] = counts.get(key, 0) + 1
        listed = [(t, p, True, n) for (t, p), n in counts.items()] + [(run_token(p, ""), p, False, n) for p, n in elements.items()]
        article = "\n".join(run for _, role, run in runs if role == "main")
        if article:
            listed.append((run_token(ARTICLE, article), ARTICLE, False, 1))
        for token, path, is_text, n in listed:
            for k, v in zip(out, (host, page, token, path, is_text, n)):
                out[k].append(v)
    return out


def templates(pages: DataFrame) -> DataFrame:
    """host, class_id, token, path, is_text, parent_class of the template tokens of each host."""
    read = pages.select(host_of("url").alias("host"), F.xxhash64("page_id", "html").alias("page"), "html")
    tokens = map_rows(read, _tokens, "host string, page long, token long, path string, is_text boolean, n int", 64)
    vectors = tokens.groupBy("host", "token", "path", "is_text").agg(
        F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.sum(F.pmod(F.xxhash64("page"), F.lit(2**31))).alias("on_pages"),
    )
    of_host = read.groupBy("host").agg(F.count("*").alias("n_pages"))
    # only tokens that can belong to a valid class; a host's pages are counted apart, so nothing is collected
    kept = (
        vectors.filter(F.col("support") >= LEAST_PAGES).join(of_host, "host").filter(F.col("support") >= LEAST_SHARE * F.col("n_pages"))
        .filter("least = most OR NOT is_text")
        .select("host", "token", "path", "is_text", F.xxhash64("support", "vector").alias("class_id"), F.xxhash64("support", "on_pages").alias("on_pages"))
    )
    kept = stored(kept, "templates")
    # what stands on the pages of one article only is that article
    articles = kept.filter(F.col("path") == ARTICLE).select("host", "on_pages", F.lit(True).alias("is_text")).distinct()
    kept = kept.filter(F.col("path") != ARTICLE).join(articles, ["host", "on_pages", "is_text"], "left_anti").drop("on_pages")
    parents = kept.filter("NOT is_text").select("host", F.col("path").alias("parent"), F.col("class_id").alias("parent_class"))
    return kept.withColumn("parent", F.regexp_replace("path", "/[^/]*$", "")).join(parents, ["host", "parent"], "left").drop("parent")


def slots(page: str | None, template_text: set) -> list[str]:
    """The content slots of a page in page order."""
    runs, _ = blocks(page)
    main = [(path, text) for path, role, text in runs if role == "main"]
    if main:
        own = [text for path, text in main if run_token(path, text) not in template_text]
        return own if 2 * sum(map(len, own)) >= sum(len(text) for _, text in main) else [text for _, text in main]
    rest = [(role, text) for path, role, text in runs if role not in ("other", "named") and run_token(path, text) not in template_text]
    # a form, or an element named like another role, may hold the whole page
    size = {r: sum(len(text) for role, text in rest if (role == "") == r) for r in (True, False)}
    return [text for role, text in rest if role == "" or size[False] > size[True]]


def _extract(rows: dict) -> dict:
    text, n = [], []
    for page, known in zip(rows["html"], rows["known"]):
        plain = "\n\n".join(slots(page, set(known or ())))
        text.append(plain)
        n.append(len(plain))
    return {"page_id": rows["page_id"], "url": pa.array(rows["url"], pa.string()), "text": pa.array(text, pa.string()), "n_chars": n}


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = stored(templates(pages), "template")
    known = found.filter("is_text").groupBy("host").agg(F.collect_set("token").alias("known"))
    if found.filter("is_text").count() <= SENT_ROWS:
        known = F.broadcast(known)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of("url").alias("host"))
    return map_rows(
        rows.join(known, "host", "left").select("page_id", "url", "html", "known"), _extract, "page_id long, url string, text string, n_chars long", 64
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
