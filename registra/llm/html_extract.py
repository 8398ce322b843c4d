"""Main text of web pages by consensus of the pages of a host.

Each page scores its containers by the text they hold and votes for the generalised tag-class path
of the best one. Spark counts the votes by host. Then each page is read again with the paths that
won on its host, and its own best container only where none of them occurs in it.

A container named like a menu, a notice or the like is no article where the page has another text.
Where what else it has is next to nothing, the page votes for its largest such part, and the host
decides: pages also tell what text stands in each such part, and a part that wins votes and whose text
differs from page to page is an article there; one whose text is repeated is not. Nothing depends on a length.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, materialize, release

#: A path wins on a host with this share of the pages at least, so a host has few winners.
MIN_VOTES = 0.1
#: Where the text under no such name is less than this share of the page's, the host's votes decide
#: about named parts.
ELSEWHERE = 0.05
#: Different texts for each page of the host that has a named part, at least, if it is an article.
DIFFERENT = 0.5
BROADCAST_ROWS = 50_000

# HTML element names and the usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea select title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
APART = frozenset("nav footer aside form button menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsbox banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie "
    "cookies copyright disclaimer discussion disqus dropdown foot footer form gdpr header legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promos promotion recommended related "
    "replies reply respond responses search share sharing sidebar sidebars signup sitemap skip social sponsor sponsored subscribe subscription "
    "taboola teaser toc toolbar topbar widget widgets".split()
)
#: Parts that stay inside an article, where they hold its own heading.
HEADS = frozenset({"header"})

_tag = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_between = re.compile(r"[\s/]*")
_attribute = re.compile(r"(=?[^\s/>=]*)(\s*=\s*)?")
_bare = re.compile(r"[^\s>]*")
_space = re.compile(r"\s+")
_number = re.compile(r"\d+")
_name = re.compile(r"[a-z]+")


class Scanner:
    """Pieces of a source in order, in time linear in its length, however broken it is."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.odd = False  # a tag whose quotes swallow the rest was met: quotes no longer hide a ">"
        self.missing: set[str] = set()  # quotes that don't occur any more

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        """("text", text, {}), ("open", name, attributes), ("close", name, {}) or ("raw", name, {})."""
        source, at, n = self.source, 0, len(self.source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                yield "text", source[at:lt], {}
            if lt == n:
                return
            tag = _tag.match(source, lt)
            if tag:
                found, at = self._attributes(tag.end())
                if at < 0:  # no tag ends here or later, so this one takes the rest
                    return
                name = tag[1].lower()
                closing = source[lt + 1] == "/"
                if not closing and name in RAW:
                    end = re.compile(f"</{name}", re.I).search(source, at)
                    at = n if end is None else (source.find(">", end.end()) + 1 or n)
                    yield "raw", name, {}
                else:
                    yield ("close", name, {}) if closing else ("open", name, found)
            elif source.startswith(("<!", "<?"), lt):
                close = "-->" if source.startswith("<!--", lt) else "]]>" if source.startswith("<![CDATA[", lt) else ">"
                end = source.find(close, lt + 2)
                at = n if end < 0 else end + len(close)
            elif source.startswith("</", lt):  # an end tag without a name is a comment
                at = source.find(">", lt) + 1 or n
            else:
                yield "text", "<", {}
                at = lt + 1

    def _attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes from here, and the place behind the tag's end, -1 if it has none."""
        source, start, found = self.source, at, {}
        if at > self.last:
            return found, -1
        while not self.odd:
            at = _between.match(source, at).end()
            if at > self.last:
                self.odd = True
                break
            if source[at] == ">":
                return found, at + 1
            m = _attribute.match(source, at)
            at, value = m.end(), ""
            if m[2]:
                quote = source[at : at + 1]
                end = source.find(quote, at + 1) if quote in ("'", '"') and quote not in self.missing else -1
                if end >= 0:
                    value, at = source[at + 1 : end], end + 1
                else:
                    if quote in ("'", '"'):
                        self.missing.add(quote)
                    v = _bare.match(source, at)
                    value, at = v[0], v.end()
            found.setdefault(m[1].lower(), value)
        return {}, source.find(">", start) + 1


class Page:
    """Containers and text blocks of a page, in page order."""

    def __init__(self, source: str, by_names: bool = True):
        #: whether the usual names of page parts set a container apart, besides its element and role
        self.by_names = by_names
        #: of each container: parent, path (as a hash), tag, whether it is set apart from the
        #: article, whether it or one around it is, and whether an article is around it
        self.parent, self.path, self.tag, self.apart, self.outside, self.inside = [-1], [""], ["html"], [False], [False], [False]
        self.part = [-1]  # the outermost container around it that only its name sets apart
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements: name, their container
        opened: Counter[str] = Counter()
        node, text, linked, links = 0, [], 0, 0

        def flush() -> None:
            nonlocal linked
            if text:
                joined = _space.sub(" ", entities.unescape("".join(text))).strip()
                if joined:
                    self.blocks.append((node, joined, linked))
                text.clear()
            linked = 0

        def pop() -> int:
            name, around = stack.pop()
            opened[name] -= 1
            return around

        for kind, name, attributes in Scanner(source):
            if kind == "text":
                text.append(name)
                if links:
                    linked += len(name.strip())
                continue
            if kind == "raw":
                if name in ("title", "textarea", "select"):
                    flush()
                continue
            if name in INLINE:
                if name == "a":
                    links = 0 if kind == "close" else 1
                continue
            flush()
            if kind == "close":
                if opened[name] and (name != "p" or stack[-1][0] == "p"):
                    while stack[-1][0] != name:
                        pop()
                    node = pop()
                links = 0
                continue
            if name in VOID:
                continue
            if name in CLOSES_P and stack and stack[-1][0] == "p":
                node = pop()
            if name in SAME_LEVEL and stack and stack[-1][0] in SAME_LEVEL[name]:
                node = pop()
            stack.append((name, node))
            opened[name] += 1
            if name in ("html", "body") or not (name == "p" or name in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "tbody", "thead", "dt", "dd", "pre")):
                node = self._container(name, attributes, node)
        flush()

    def _container(self, name: str, found: dict[str, str], parent: int) -> int:
        classes = [_number.sub("", c) for c in found.get("class", "").lower().split()]
        inside = self.inside[parent]
        words = set(_name.findall(" ".join([*classes, found.get("id", "").lower()]))) if self.by_names else set()
        parts = words & PARTS - (HEADS if inside else frozenset())
        apart = name in APART or (name == "header" and not inside) or found.get("role", "").lower() in ROLES
        apart |= "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        named = bool(parts) and not apart
        apart |= named
        if name in ("body", "html", "main", "article"):
            apart = named = False
        self.part.append(len(self.parent) if named and not self.outside[parent] else self.part[parent])
        step = ".".join([self.path[parent], name, *sorted(set(filter(None, classes)))])
        self.parent.append(parent)
        self.path.append(hashlib.blake2b(step.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest())
        self.tag.append(name)
        self.apart.append(apart)
        self.outside.append(apart or self.outside[parent])
        self.inside.append(inside or name in ("article", "main"))
        return len(self.parent) - 1

    def _chain(self, node: int) -> Iterator[int]:
        while node >= 0:
            yield node
            node = self.parent[node]

    def best(self) -> tuple[str, float]:
        """Path and score of the container with the most text of its own; ('', 0) if there is none.

        Half of what a container holds counts for its parent. Text in links counts against.
        """
        score: dict[int, float] = {}
        for node, text, linked in self.blocks:
            if self.outside[node]:
                continue
            worth = len(text) - 2.0 * linked
            for n in self._chain(node):
                score[n] = score.get(n, 0.0) + worth
                worth /= 2
                if worth < 1:
                    break
        score.pop(0, None)
        if not score:
            return "", 0.0
        top = max(score, key=lambda n: (score[n], -n))
        for n in self._chain(top):  # a part of an article stands for all of it
            if self.tag[n] in ("article", "main"):
                return self.path[n], score[top]
        return self.path[top], score[top]

    def text(self, paths: list[str]) -> str | None:
        """Text of the blocks under the first of these paths that occurs with text; else None."""
        for path in paths:
            under = [False] * len(self.parent)  # whether a container belongs to one of this path
            for n in range(len(self.parent)):
                under[n] = self.path[n] == path or (n > 0 and not self.apart[n] and under[self.parent[n]])
            found = [text for node, text, _ in self.blocks if under[node]]
            if found:
                return "\n".join(found)
        return None

    def main_text(self, paths: list[str]) -> str:
        found = self.text(paths)
        if found is None:
            found = self.text([self.best()[0]])
        if found is None:
            found = "\n".join(t for node, t, _ in self.blocks if not self.outside[node])
        return found


def page_votes(source: str) -> tuple[str, float]:
    """The path that a page votes for, and its score; parts by their names have no votes here."""
    return Page(source).best()


def named_part(page: Page) -> tuple[str, float]:
    """Path and score of the largest part by its name, if such parts hold nearly all text of the page."""
    inner, whole = 0, 0
    worth: dict[int, float] = {}
    for node, text, linked in page.blocks:
        whole += len(text) - linked
        inner += 0 if page.outside[node] else len(text) - linked
        if page.part[node] >= 0:
            worth[page.part[node]] = worth.get(page.part[node], 0.0) + len(text) - 2.0 * linked
    if not worth or inner >= ELSEWHERE * whole:
        return "", 0.0
    best = max(worth, key=lambda n: (worth[n], -n))
    return (page.path[best], worth[best]) if worth[best] > 0 else ("", 0.0)


def named_texts(page: Page) -> list[tuple[str, bytes]]:
    """Path and hash of the text of each part by its name."""
    found: dict[int, list[str]] = {}
    for node, text, _ in page.blocks:
        if page.part[node] >= 0:
            found.setdefault(page.part[node], []).append(text)
    return [(page.path[n], hashlib.blake2b("\n".join(t).encode("utf-8", "surrogatepass"), digest_size=16).digest()) for n, t in found.items()]


def page_text(source: str, paths: list[str], named: list[str] | None = None) -> str:
    """Main text by the winning paths. ``named``: parts by their names that are articles on the host; if
    None there is no host to ask, and the page's own votes count."""
    page = Page(source)
    own = named_part(page)[0] if named is None or named else ""
    if own and (named is None or own in named):
        found = Page(source, by_names=False).text([own])
        if found is not None:
            return found
    return page.main_text(paths)


#: Kinds of rows by host: votes for containers, votes for parts by their names, texts of such parts.
VOTE, NAMED, SEEN = 0, 1, 2


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[int, int, str, bytes | None, float]] = []
        for i, source in enumerate(batch.column(1).to_pylist()):
            page = Page(source or "")
            for kind, (path, score) in ((NAMED, named_part(page)), (VOTE, page.best())):
                if path:  # a page votes once
                    rows.append((i, kind, path, None, score))
                    break
            rows += [(i, SEEN, path, seen, 0.0) for path, seen in named_texts(page)]
        at = pa.array([r[0] for r in rows], pa.int64())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.binary()), (4, pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns], names=["_host", "kind", "path", "seen", "score"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (2, 3, 4)]
        texts = [page_text(x or "", p or [], n or []) for x, p, n in zip(*columns, strict=True)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["_id", "_url", "text", "n_chars"])


def host(url_col: str) -> Column:
    """Lower-cased host of a URL; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``id_col``, ``url_col``, ``text`` ('' if none) and ``n_chars``.

    Blocks are joined by one line feed in page order; character references are decoded, white space
    in a block becomes one space. Null html counts as empty, null or odd urls as one host; repeated
    rows are read like any others; an empty table gives no rows. No text is capped.
    """
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host(url_col).alias("_host"))
    votes = own.select("_host", "_html").mapInArrow(_votes, "_host string, kind int, path string, seen binary, score double")
    # equal votes meet on the map side, so a host with a third of all pages is dealt out by its paths and texts
    votes = materialize(votes.groupBy("_host", "kind", "path", "seen").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score")), "votes")
    cast = votes.filter(F.col("kind") != SEEN)
    total = cast.groupBy("_host").agg(F.sum("n").alias("of"))
    won = cast.join(total, "_host").filter(F.col("n") >= MIN_VOTES * F.col("of"))
    varied = votes.filter(F.col("kind") == SEEN).groupBy("_host", "path").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("texts"))
    varied = varied.filter(F.col("texts") >= DIFFERENT * F.col("times")).select("_host", "path")
    named = won.filter(F.col("kind") == NAMED).join(varied, ["_host", "path"], "left_semi")
    ranked = lambda df, out: df.groupBy("_host").agg(F.sort_array(F.collect_list(F.struct("n", "score", "path")), asc=False).getField("path").alias(out))
    won = materialize(ranked(won.filter(F.col("kind") == VOTE), "_paths").join(ranked(named, "_named"), "_host", "full"), "paths")
    release(votes)
    won = hinted(won, BROADCAST_ROWS)
    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    out = own.join(won, "_host", "left").select("_id", "_url", "_html", "_paths", "_named").mapInArrow(_texts, f"_id {kind[id_col]}, _url {kind[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
