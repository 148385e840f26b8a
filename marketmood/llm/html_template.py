"""HTML extraction by equivalence-class template deduction.

A token is an element's path: the tags from the root down, each with its class,
id and role words (digits masked). Tokens of a host's pages that have the same
occurrence vector, the number of times on every page, form an equivalence
class. Vectors are compared by a 64-bit exclusive-or of hashes of (page,
count), so partial results merge and a host of any size needs one row a token.
Classes on at least half of the host's pages are valid; the class of tokens
that stand exactly once on every page is the host's frame. Other classes are
nested into the innermost frame token above them, and frame and nested classes
make the host's template, whose places between frame tokens are slots.

The host's main slot is the innermost frame element that holds at least four
fifths of the host's varying text outside links; slots outside of it are
boilerplate, but a first heading beside it stays. Inside it, a slot is
boilerplate if its text is the same on all pages, of which at least three have
distinct bodies (sub-headings with text under them stay), or if it consists of
links on the host's pages taken together (a nested class or a frame token).
Reader comments are nested classes too: elements that repeat, each with parts of
its own, under a name for comments; they are never part of a main slot. If the
page marks an article (outside comments), only slots in it remain.

Names break ties. A class, id or role name marks boilerplate only if all words
of it do (``ad``, ``cookie-notice``, but not ``ad-hoc`` or ``share-price``), and
never for an element that is or contains the main slot or the page's first
heading. A slot is judged by its own text, not by that of the slots in it.

A body is what a page's own tokens leave of it; pages with equal bodies are
copies. Hosts without two distinct bodies, hosts whose text has no such main
slot, and pages that don't fit their host's frame (a frame token missing or
repeated) are judged by marks, tags and names of their own alone, so that blocks
of links without such a name stay in their text. Near-copies count as distinct:
a host of nothing else loses what they share once a page. Elements nested so
deeply that their path has more than 4,000 characters share one token, which
bounds the memory a page takes.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import broadcast_if_small, free_name, read_table, rows_of, stored
from marketmood.llm.url_filter import host_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>"""
                   r"""|</?([a-zA-Z][^\s/>]*+)([^>]*+)>|<[a-zA-Z/!?][^<>]*\Z""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# Kinds of tags, and the words that mark boilerplate and articles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                   "nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "p": {"p"}}
BOUNDS = frozenset("article section div main body table ul ol dl nav aside footer header form td th blockquote".split())
BAD_TAGS = RAW | frozenset("head nav footer aside form button select option dialog menu object canvas audio video".split())
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent "
                      "contentinfo cookie cookies copyright disclaimer footer form gdpr masthead menu modal nav navbar "
                      "navigation newsletter notice notices pagination popup promo promotion related search "
                      "share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split())
# Words that say nothing by themselves: with one of the above they make a name of boilerplate.
PLAIN_WORDS = frozenset("# area bar block bottom box btn button buttons col column container footer group header icons inner item "
                        "items left link links list outer page panel post row section side site slot top unit wrap wrapper zone".split())
COMMENT_WORDS = frozenset("comment reply response discussion".split())
COMMENTS_WORDS = frozenset("comments commentlist replies responses discussions disqus respond guestbook".split())
AUTHOR_WORDS = (frozenset(["author"]), frozenset("about bio box card info profile".split()))
HEADERS = frozenset("header banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption legend".split())
DEEPEST, MOST_NOTED = 4000, 64  # characters of a path; elements with marks on it


def label(tag: str, attributes: str) -> str:
    """Tag with its class, id and role words, digits masked."""
    words = set()
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        words.update(w.lower() for w in PART.findall(entities.unescape(a or b or c)))
    return ".".join([tag, *sorted({"#" if w.isdigit() else w for w in words})]) if words else tag


def is_main(lab: str) -> bool:
    words = lab.split(".")
    return words[0] in ("article", "main") or ("main" in words[1:] and words[0] in ("div", "section")) or \
        {"article", "body"} <= set(words[1:])


@lru_cache(4096)
def name_kind(tag: str, attributes: str) -> str:
    """What an element's names say: "bad", "comment" (one), "comments" (a place for them), "header" or nothing."""
    if tag in ("html", "body"):
        return ""
    kind = "header" if tag == "header" else ""
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        for name in entities.unescape(a or b or c).split():
            words = {"#" if w.isdigit() else w.lower() for w in PART.findall(name)}
            if words & COMMENTS_WORDS or (words & COMMENT_WORDS and words & PLAIN_WORDS - {"item", "box", "#", "post"}):
                return "comments"
            if words & COMMENT_WORDS:
                kind = "comment"
            elif words & BAD_WORDS and words <= BAD_WORDS | PLAIN_WORDS:
                return "bad"
            elif all(words & some for some in AUTHOR_WORDS):
                return "bad"
            elif words and words <= HEADERS | PLAIN_WORDS and words & HEADERS:
                kind = kind or "header"
    return kind


class Page:
    """Blocks, element counts and texts of one page."""

    def __init__(self, source: str | None):
        self.counts: dict[str, int] = {}  # by path
        self.order: list[str] = []  # paths in the order of their first element
        self.blocks: list[tuple[str, bool, bool, str, int]] = []  # path, boilerplate, in an article, text, characters in links
        self.has_main = False
        self._judge(*self._read(source or ""))

    def _judge(self, blocks: list, noted: list[list]):
        """Judge the blocks by the marks and names on their paths, but by no name of what is or contains the main slot.

        A name for comments holds for an element without the first heading in
        it; a name for one comment only if the element repeats and has parts.
        The main slot is the marked element outside comments with the most text.
        Without one, it lies in every element with more than half of the text
        and a name that doesn't say only boilerplate.
        """
        parts = {p.rpartition("/")[0] for p, n in self.counts.items() if p.rpartition("/")[2].partition(".")[0] not in INLINE - {"time", "cite"}}
        remark = [not first and (kind == "comments" or (kind == "comment" and path in parts and (self.counts[path] > 1 or tag in ("li", "article"))))
                  for tag, path, _, kind, first in noted]
        chars, paths, total = [0] * len(noted), {}, 0
        for _, hard, on_path, body, _ in blocks:
            if not hard and not any(remark[e] for e in on_path):
                total += len(body)
                for k, e in enumerate(on_path):
                    chars[e] += len(body)
                    paths[e] = on_path[:k + 1]
        marked = [mark for _, _, mark, _, _ in noted]
        found = [e for e in paths if marked[e]]
        if found:
            keep = set(paths[max(found, key=lambda e: (chars[e], -e))])
        else:
            keep = {e for e in paths if (2 * chars[e] > total and noted[e][3] != "bad") or noted[e][4]}
        for path, hard, on_path, body, linked in blocks:
            bad, main = hard, False
            for e in on_path:
                bad = bad or remark[e] or (e not in keep and (noted[e][3] == "bad" or (noted[e][3] == "header" and not main)))
                main = main or (not bad and marked[e])
            self.has_main = self.has_main or main
            self.blocks.append((path, bad, main, body, linked))

    def _read(self, source: str) -> tuple[list[tuple[str, bool, tuple[int, ...], str, int]], list[list]]:
        """Blocks with whether a tag on their path is boilerplate, and the elements on it that have marks or names.

        Of these: tag, path, whether it marks an article, kind of its names,
        whether the page's first heading is in it.
        """
        blocks: list[tuple[str, bool, tuple[int, ...], str, int]] = []
        noted: list[list] = []
        headed = False
        # open elements: tag, path, boilerplate by a tag, elements noted
        stack: list[tuple[str, str, bool, tuple[int, ...]]] = [("", "", False, ())]
        text: list[str] = []
        links = [0, 0]  # open anchors, characters inside

        def close_block():
            words = "".join(text).split()
            if words:
                _, path, hard, on_path = next(e for e in reversed(stack) if e[0] not in INLINE)
                blocks.append((path, hard, on_path, " ".join(words), links[1]))
            text.clear()
            links[1] = 0

        def take(piece: str):
            if piece:
                piece = entities.unescape(piece)
                text.append(piece)
                if links[0]:
                    links[1] += len(piece.strip())

        def pop_to(k: int):
            if any(e[0] not in INLINE for e in stack[k:]):
                close_block()
            for e in stack[k:]:
                links[0] -= e[0] == "a"
            del stack[k:]

        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if not m:
                take(source[at:])
                break
            take(source[at:m.start()])
            at = m.end()
            tag = (m[1] or m[3] or "").lower()
            if not tag:
                continue
            if source[m.start() + 1] == "/":
                if tag == "br":
                    text.append(" ")
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                    if tag not in BOUNDS and stack[k][0] in BOUNDS:
                        break
                if tag not in INLINE:
                    close_block()
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else n
                if tag not in INLINE:
                    close_block()
                continue
            if tag == "br":
                text.append(" ")
            elif tag not in INLINE:
                ended = SIBLINGS.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ended:
                        pop_to(k)
                        break
                    if stack[k][0] in BOUNDS and stack[k][0] not in ended:
                        break
                close_block()
            _, path, hard, on_path = stack[-1]
            lab = label(tag, m[2] or m[4] or "")
            path = f"{path}/{lab}" if len(path) + len(lab) < DEEPEST else path if path.endswith("/~") else f"{path}/~"
            if path not in self.counts:
                self.order.append(path)
            self.counts[path] = self.counts.get(path, 0) + 1
            if tag in VOID:
                continue
            kind, mark = name_kind(tag, m[2] or m[4] or ""), is_main(lab)
            if (mark or kind) and len(on_path) < MOST_NOTED:
                on_path = (*on_path, len(noted))
                noted.append([tag, path, mark, kind, False])
            if tag == "h1" and not headed:
                headed = True
                for e in on_path:
                    noted[e][4] = True
            links[0] += tag == "a"
            stack.append((tag, path, hard or tag in BAD_TAGS, on_path))
        pop_to(1)
        close_block()
        return blocks, noted

    def good(self) -> dict[str, int]:
        """Characters outside links in the blocks of each path that the page's own marks and names leave."""
        out: dict[str, int] = {}
        for path, bad, _, body, linked in self.blocks:
            if not bad:
                out[path] = out.get(path, 0) + max(0, len(body) - linked)
        return out

    def texts(self) -> dict[str, tuple[str, int]]:
        """All text and the link characters directly in the blocks of each path."""
        out: dict[str, tuple[str, int]] = {}
        for path, _, _, body, linked in self.blocks:
            t, k = out.get(path, ("", 0))
            out[path] = (f"{t}\n{body}", k + linked)
        return out


def tag_of(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def hash64(value: str) -> int:
    """Signed 64 bits of a string (two checksums of it)."""
    data = value.encode("utf-8", "surrogatepass")
    both = zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)
    return both - (1 << 64) if both >> 63 else both


def token_rows(host: str, key: str, page: Page, into: dict) -> None:
    """Add one page to the partial results of its host's tokens and bodies (rows without elements)."""
    texts, good = page.texts(), page.good()
    body = main_text(page, Template(None))
    if body:
        into.setdefault((host, f"{BODY}{hash64(body)}"), [0] * 8)[0] += 1
    for path, count in page.counts.items():
        body, linked = texts.get(path, ("", 0))
        h = hash64(body)
        row = into.get((host, path))
        if row is None:
            row = into[host, path] = [0, 0, 0, h, h, 0, 0, 0]
        row[0] += 1
        row[1] += count
        row[2] ^= hash64(f"{count}:{key}")
        row[3], row[4] = min(row[3], h), max(row[4], h)
        row[5] += len(body) - body.count("\n")
        row[6] += linked
        row[7] += good.get(path, 0)


BODY = "#"  # before the hash of a body; paths begin with a slash
STATS = ["pages", "times", "vector", "text_min", "text_max", "chars", "linked", "good"]


def token_stats(pages: DataFrame, flush: int = 50_000) -> DataFrame:
    """A row for each host and token, from columns host, page_key and t; every task pre-aggregates its pages."""
    def work(batches):
        def out(into):
            cols = list(zip(*[(h, p, *row) for (h, p), row in into.items()]))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(cols)],
                                              names=["host", "path", *STATS])
        into: dict = {}
        for batch in batches:
            for host, key, t in rows_of(batch):
                token_rows(host, key, Page(t), into)
                if len(into) > flush:
                    yield out(into)
                    into.clear()
        if into:
            yield out(into)

    rows = pages.select("host", "page_key", "t").mapInArrow(work, "host string, path string, " + ", ".join(f"{c} long" for c in STATS))
    return rows.groupBy("host", "path").agg(
        *[F.sum(c).alias(c) for c in ("pages", "times", "chars", "linked", "good")], F.bit_xor("vector").alias("vector"),
        F.min("text_min").alias("text_min"), F.max("text_max").alias("text_max"))


def templates(stats: DataFrame) -> DataFrame:
    """``(host, template)``: the valid classes of each host as JSON.

    Tokens on less than half of the pages are in no valid class; the others
    number at most twice the tokens of a mean page, which bounds a host's row.
    Copies tell nothing about what a host repeats, so distinct bodies count.
    """
    is_token = F.col("times") > 0
    size = stats.groupBy("host").agg(F.max(F.when(is_token, F.col("pages"))).alias("host_pages"),  # every page has its root path
                                     F.count_if(~is_token).alias("bodies"))
    valid = stats.filter(is_token).join(size, "host").filter((F.col("bodies") >= 2) & (2 * F.col("pages") >= F.col("host_pages")))
    token = F.struct("path", "vector", (F.col("pages") == F.col("host_pages")).alias("all"),
                     (F.col("pages") == F.col("times")).alias("once"),
                     ((F.col("text_min") == F.col("text_max")) & (F.col("bodies") >= 3) & (F.col("chars") > 0)).alias("fixed"),
                     F.when(F.col("chars") > 0, 2 * F.col("linked") > F.col("chars")).alias("links"),
                     F.when((F.col("text_min") < F.col("text_max")) & (F.col("good") > 0), F.col("good")).alias("good"))
    return valid.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(token))).alias("template"))


class Template:
    """Frame, nested classes and boilerplate slots of a host."""

    def __init__(self, text: str | None):
        tokens = json.loads(text) if text else []
        self.frame = {t["path"] for t in tokens if t["all"] and t["once"]}
        classes: dict[tuple[int, bool, str], list[dict]] = {}  # ordered and nested: all of a class lies in one slot
        for t in tokens:
            if t["path"] not in self.frame:
                classes.setdefault((t["vector"], t["all"], self.slot(t["path"])), []).append(t)
        self.nested: dict[str, list[list[str]]] = {}  # by frame token: the classes nested in its slot
        self.boilerplate = {t["path"] for t in tokens if t["all"] and (t["fixed"] or (t["once"] and t.get("links")))}
        self.linked = {t["path"] for t in tokens if t.get("links")}
        self.headings = {p for p in self.boilerplate if tag_of(p) in HEADINGS}
        self.main = self._main_slot(tokens)
        for (_, _, slot), members in classes.items():
            paths = [t["path"] for t in members]
            self.nested.setdefault(slot, []).append(paths)
            known = [t["links"] for t in members if t.get("links") is not None]  # of tokens with text of their own
            if known and all(known):
                self.boilerplate.update(paths)

    def _main_slot(self, tokens: list[dict]) -> str:
        """The innermost frame element, but no block of text alone, with four fifths of the varying text; "" without one."""
        weight: dict[str, int] = {}
        for t in tokens:
            path = t["path"] if t.get("good") else ""
            while path:
                weight[path] = weight.get(path, 0) + t["good"]
                path = path.rpartition("/")[0]
        total = sum(t.get("good") or 0 for t in tokens)
        large = [p for p, w in weight.items() if p in self.frame and 5 * w >= 4 * total and tag_of(p) in BOUNDS - {"body"}]
        return max(large, key=len, default="")

    def slot(self, path: str) -> str:
        """The innermost frame token on a path."""
        while path and path not in self.frame:
            path = path.rpartition("/")[0]
        return path

    def fits(self, page: Page) -> bool:
        return bool(self.frame) and all(page.counts.get(p) == 1 for p in self.frame)


def main_text(page: Page, template: Template) -> str:
    """The text of the remaining slots, a block a line."""
    use = template.fits(page)
    slot = f"{template.main}/" if use and template.main else ""

    def inside(path: str) -> bool:
        """In the main slot, or the first heading beside it."""
        return f"{path}/".startswith(slot) or (tag_of(path) == "h1" and slot.startswith(f"{path.rpartition('/')[0]}/"))

    blocks = [(path, not bad and inside(path), main, body) for path, bad, main, body, _ in page.blocks]
    has_main = any(stays and main for _, stays, main, _ in blocks)
    kept: list[tuple[bool, str]] = []  # whether a heading that all pages have, its text
    for path, stays, main, body in blocks:
        stays = stays and (main or not has_main)
        if use and path in template.boilerplate and (path not in template.headings or path in template.linked):
            stays = False
        if stays:
            kept.append((use and path in template.headings, body))
        elif kept and kept[-1][0]:
            kept.pop()  # nothing that stays is under it
    while kept and kept[-1][0]:
        kept.pop()
    return "\n".join(body for _, body in kept)


def extract(pages: DataFrame, html: str = "html", url: str = "url", id_col: str = "page_id") -> DataFrame:
    """All rows and columns of ``pages`` but the source, with the main text and its length.

    Null and empty sources give an empty text. Pages without a host (null or
    malformed URL) share the empty host's template. Repeated rows are kept;
    columns ``text`` and ``n_chars`` are replaced.
    """
    data = pages.drop(*[c for c in ("text", "n_chars") if c not in (html, url, id_col)])
    key = F.concat_ws("|", F.col(id_col).cast("string"), F.col(url), F.xxhash64(F.col(html)).cast("string"))
    keyed = data.select(host_of(F.col(url)).alias("host"), key.alias("page_key"), F.col(html).alias("t"))
    made = stored(templates(stored(token_stats(keyed), "tokens")), "templates")
    host, template = free_name(data, "page_host"), free_name(data, "page_template")
    side = made.select(F.col("host").alias(host), F.col("template").alias(template))
    joined = data.withColumn(host, host_of(F.col(url))).join(broadcast_if_small(side), host, "left")

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ready: dict = {}  # of the task: a template is read once
        for sources, hosts, known in batches:
            out = []
            for source, h, t in zip(sources, hosts, known):
                if h not in ready:
                    if len(ready) >= 2000:
                        ready.clear()
                    ready[h] = Template(t)
                out.append(main_text(Page(source), ready[h]))
            yield pd.Series(out, dtype=object)

    found = joined.withColumn("text", text_of(F.col(html), F.col(host), F.col(template)))
    keep = [c for c in data.columns if c not in (html, "text")]
    return found.select(*[F.col(f"`{c}`") for c in keep], "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_html_extraction(spark, sf_dir) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
