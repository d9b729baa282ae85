"""Main text of web pages by composite text density.

Every node of a page's tree has a density: its characters for each tag in it, lowered the more of them stand in links.
The node whose children's densities have the largest sum holds the main text. The smallest density on the path from the
body to the densest node is a threshold: other subtrees that are at least so dense are main text too. Elements that are
boilerplate by their name, role or class names take no part.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import in_arrow, text_blocks

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("head nav header footer aside form menu button select input textarea script style noscript iframe template svg math dialog object embed "
                        "applet canvas audio video search".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
# Words that name boilerplate in class and id names, and words of layout that say nothing of what is in it. A
# name counts if it has a word of the former and no other word: related-posts does, related-work does not.
NAMES = frozenset("ad ads adbox adbanner adunit adspace adblock adslot adcontainer adwrapper advert adverts advertisement advertisements advertising adsense banner "
                  "sponsor sponsors sponsored sponsorship promo promos promotion promotions nav navs navbar navigation navigations menu menus menubar breadcrumb breadcrumbs "
                  "sidebar sidebars widget widgets footer footers header headers masthead topbar toolbar comment comments commentlist respond disqus cookie cookies consent gdpr "
                  "notice notices disclaimer disclaimers copyright legal alert alerts newsletter newsletters subscribe subscription subscriptions signup login popup popups modal "
                  "overlay share sharing social socials related recommended recommendations pagination pager skiplink hidden".split())
LAYOUT = frozenset("a area articles bar block body bottom box btn button buttons col column container content div element fluid form global group holder home icon icons id image "
                   "images inner item items left link links list main mobile module outer page panel posts primary region right row rss rail secondary section side site skip slot "
                   "small space sticky tertiary text thread threads title top unit visually web wrap wrapper zone info large desktop policy bars skyscraper leaderboard".split())
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


def boilerplate_name(names: str) -> bool:
    """Whether one of the names of a class or id attribute names boilerplate."""
    for name in names.split():
        words = [w for w in _PARTS.split(name) if w and not w.isdigit()]
        low = [w.lower() for w in words] if len(words) > 1 else [name.strip("-_").lower()]
        if any(w in NAMES for w in low) and all(w in NAMES or w in LAYOUT for w in low) or "".join(low) in NAMES:
            return True
    return False


# an opening tag of these closes an open one of those
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
# ... unless one of these stands between
SCOPE = frozenset("ul ol dl table select div section article main body html td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?", re.I)
_SPACE = re.compile(r"\s+")


class _Tree:
    """Nodes in page order, as columns: parent, name, whether boilerplate or inside an article, and text pieces with the node they stand in."""

    def __init__(self, page: str):
        self.parent, self.name, self.skip, self.article = [-1], [""], [False], [False]
        self.pieces: list[tuple[int, str]] = []  # text, or "" for the start or end of a block
        self._read(page)

    def _open(self, parent: int, name: str, attributes: str) -> int:
        # the heading of an article stands in a header of its own
        inside = self.article[parent] or name == "article"
        skip = self.skip[parent] or name in BOILERPLATE and not (name == "header" and inside)
        if not skip and attributes and name not in ("html", "body", "main", "article"):
            for m in _ATTRIBUTE.finditer(attributes):
                kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
                if (kind == "hidden" or kind == "role" and value.lower() in ROLES or kind == "aria-hidden" and value.lower() == "true"
                        or kind in ("class", "id") and boilerplate_name(value)):
                    skip = True
                    break
        self.parent.append(parent)
        self.name.append(name)
        self.skip.append(skip)
        self.article.append(inside)
        return len(self.name) - 1

    def _read(self, page: str) -> None:
        stack, at = [0], 0
        end = len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            stop = m.start() if m else end
            if stop > at:
                self.pieces.append((stack[-1], page[at:stop]))
            if not m:
                break
            at = m.end()
            name = m[2].lower() if m[2] else ""
            if not name:
                if m[0].startswith("<![CDATA["):
                    self.pieces.append((stack[-1], html.escape(m[0][9:].removesuffix("]]>"), quote=False)))
                continue
            if m[1]:
                if name == "br" or name == "p" and all(self.name[k] != "p" for k in stack):
                    self.pieces.append((stack[-1], ""))
                for depth in range(len(stack) - 1, 0, -1):
                    if self.name[stack[depth]] == name:
                        del stack[depth:]
                        break
                    if name not in BLOCK and self.name[stack[depth]] in BLOCK:
                        break  # an inline end tag does not close a block
                if name in BLOCK:
                    self.pieces.append((stack[-1], ""))
                continue
            if name in BLOCK and name != "br":
                # a block ends an open paragraph, whatever inline elements are still open in it
                for depth in range(len(stack) - 1, 0, -1):
                    open_name = self.name[stack[depth]]
                    if open_name == "p":
                        del stack[depth:]
                        break
                    if open_name in BLOCK:
                        break
            if closes := CLOSES.get(name):
                for depth in range(len(stack) - 1, 0, -1):
                    if (open_name := self.name[stack[depth]]) in closes:
                        del stack[depth:]
                    elif open_name in SCOPE:
                        break
            node = self._open(stack[-1], name, m[3])
            if name in BLOCK:
                self.pieces.append((stack[-1], ""))
            if name in RAW and name not in ("svg", "math"):
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            elif name not in VOID and not m[3].endswith("/"):
                stack.append(node)


def _measures(tree: _Tree, sizes: list[int]) -> tuple[list[float], list[float]]:
    """Composite density of each node, and the sum of its children's densities."""
    n = len(tree.name)
    chars, tags, link_chars, link_tags = sizes[:], [0] * n, [0] * n, [0] * n
    inside = [False] * n
    for k in range(1, n):
        inside[k] = inside[tree.parent[k]] or tree.name[k] == "a"
        if inside[k]:
            link_chars[k] = sizes[k]
            link_tags[k] = tree.name[k] == "a"
    for k in range(n - 1, 0, -1):  # a node comes after its parent
        if not tree.skip[k]:
            p = tree.parent[k]
            chars[p] += chars[k]
            tags[p] += tags[k] + 1
            link_chars[p] += link_chars[k]
            link_tags[p] += link_tags[k]
    ratio = link_chars[0] / max(chars[0], 1)
    density, total = [0.0] * n, [0.0] * n
    for k in range(n - 1, 0, -1):
        if tree.skip[k] or not chars[k]:
            continue
        c, t, lc, lt = chars[k], max(tags[k], 1), max(link_chars[k], 1), max(link_tags[k], 1)
        base = math.log(c / max(c - link_chars[k], 1) * link_chars[k] + ratio * c + math.e)
        density[k] = c / t * math.log(max(c / lc * t / lt, 1.0)) / base
        total[tree.parent[k]] += density[k]
    return density, total


def main_text(page: str) -> str:
    """Main text of one page, a block a line; empty if there is none."""
    tree = _Tree(page)
    n = len(tree.name)
    texts = [(node, piece if not piece else html.unescape(piece)) for node, piece in tree.pieces if not tree.skip[node]]
    sizes = [0] * n
    for node, piece in texts:
        sizes[node] += len(_SPACE.sub(" ", piece).strip())
    density, total = _measures(tree, sizes)
    chosen = [False] * n

    def take(k: int) -> None:
        # up to the article it stands in, so that the heading beside the paragraphs is not lost
        up = k
        while up > 0:
            if tree.name[up] in ("article", "main"):
                k = up
                break
            up = tree.parent[up]
        chosen[k] = True

    best = max(range(n), key=lambda k: (total[k], -k))
    if total[best] <= 0:
        best = max(range(n), key=lambda k: (sizes[k], -k))
        if not sizes[best]:
            return ""
    take(best)
    dense = max(range(n), key=lambda k: (density[k], -k))
    threshold = density[dense]
    while dense > 0:
        threshold = min(threshold, density[dense]) if tree.name[dense] not in ("html", "body") else threshold
        dense = tree.parent[dense]
    for k in range(n - 1, -1, -1):
        # other parents of dense text, next to the best one
        if total[k] > 0 and density[k] >= threshold and not tree.skip[k] and tree.name[k] not in ("html", "body", ""):
            take(k)
    for k in range(1, n):
        chosen[k] = (chosen[k] or chosen[tree.parent[k]]) and not tree.skip[k]
    blocks: list[list[str]] = [[]]
    for node, piece in texts:
        if not piece:
            blocks.append([])
        elif chosen[node]:
            blocks[-1].append(piece)
    lines = (_SPACE.sub(" ", "".join(block)).strip() for block in blocks)
    return "\n".join(line for line in lines if line)


def extract(rows: DataFrame, keep: dict[str, Column], page: str = "html") -> DataFrame:
    """The columns of `keep`, then text, n_chars: one row for each row given.

    A null or empty page, or one without main text, has an empty text. n_chars counts code points. Pages are read whole,
    however long or broken; repeated rows give repeated results.
    """
    chosen = rows.select(*[column.alias(name) for name, column in keep.items()], F.col(page).alias("__page"))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, pages in text_blocks(batches, "__page"):
            texts = [main_text(p) for p in pages]
            yield {n: c for n, c in batch.items() if n != "__page"} | {"text": texts, "n_chars": [len(t) for t in texts]}

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__page"]
    return in_arrow(chosen, work, ", ".join([*fields, "text string", "n_chars bigint"]))
