"""HTML extraction: paragraphs score their ancestors; the best container and its like siblings stay."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
#: What ends a tag, or begins a quoted value in it.
EDGE = re.compile(r"""=\s*["']|>""")
ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content isn't markup, up to their own end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that never hold main text, and those that don't unless the article is in them.
NEVER = RAW | {"nav", "footer", "aside", "head", "button", "select", "option", "datalist", "input", "menu", "dialog", "svg", "object", "embed", "canvas", "audio", "video", "map", "search"}
SELDOM = {"form", "fieldset"}
#: A label in one of these is part of a sentence.
SENTENCE = {"p", "li", "td", "th", "dd", "dt", "blockquote", "figcaption", "span", "em", "strong", "b", "i", "a", "code", "cite", "q", "sub", "sup"} | HEADING
#: Elements of running text.
PROSE = {"p", "blockquote", "pre"}
#: Words in class, id or role that mark what stands beside an article; the weak ones can also be names
#: of an article's own sections, so that inside one they don't count in an id.
_WORDS = r"(?:^|[\s_-])(?:{})(?=$|[\s_-]|\d)"
READERS = re.compile(_WORDS.format(r"comments?|commentlist|comment-\w+|respond|replies|reply|disqus"), re.I)
TOP = re.compile(_WORDS.format(r"header|head|masthead|banner|topbar"), re.I)
BESIDE = re.compile(_WORDS.format(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|outbrain|taboola|popup|modal|overlay|cookies?|consent|gdpr|newsletter|subscri\w*|signup|login|paywall|nav|navbar|navigation|menu|menus|breadcrumbs?|pagination|pager"
    r"|sidebar|sidebars|widgets?|share|sharing|social|footer|foot|copyright|complementary|contentinfo|dialog|toolbar"), re.I)  # fmt: skip
WEAK = re.compile(_WORDS.format(r"notices?|notification|alert|toc|side|aside|rail|related|recommend\w*|popular|trending|more-\w+|see-also|read-next|teasers?|discussion|reviews?|follow|legal|disclaimer|tags|skip|search"), re.I)
#: Classes and roles that mark such things inside an article too, as whole words. Words that only match the
#: patterns above may be a section's name there: that goes if its text is mostly links, or mostly outside
#: paragraphs.
PLAIN = re.compile(
    r"ads?|advert\w*|adsense|ad-(?:slot|unit|box|banner|container|wrapper)|sponsor(?:ed|s)?|promo(?:s|tions?)?|outbrain|taboola|newsletter(?:-(?:signup|form|box))?|subscribe|subscription|sign-?up|login|paywall"
    r"|share|sharing|share-(?:bar|buttons?|links?|tools)|social|social-(?:share|sharing|links?|bar|buttons?|media)|(?:cookies?|consent|gdpr)(?:-\w+)*|popup|modal|dialog|nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager"
    r"|sidebars?|widgets?|toolbar|footer|copyright|complementary|contentinfo|banner|notices?|notification|toc|related(?:-(?:posts?|articles?|links?|stories|content))?|recommended|trending|teasers?|skip-link", re.I)  # fmt: skip
GOOD = re.compile(r"article|post|entry|content|story|main|text|body", re.I)
SPACE = re.compile(r"\s+")
#: A start tag of the left closes an open element of the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Deeper elements become siblings, as in browsers, so that no walk to the top is long.
DEPTH = 512


class Node:
    """why: what speaks against the element itself: "", "never", "hidden", "header" (a page's), "top",
    "readers", "beside" or "perhaps"; skip says whether it or one above is left out."""

    __slots__ = ("tag", "hint", "parent", "kids", "depth", "inside", "why", "skip", "size", "text", "linked", "score")

    def __init__(self, tag: str, hint: str, parent: Node | None, why: str):
        self.tag, self.hint, self.parent, self.why, self.skip = tag, hint, parent, why, False
        self.kids: list = []
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.size = self.text = self.linked = 0
        self.score = 0.0


def _judge(tag: str, attrs: str, parent: Node) -> tuple[str, str]:
    """(class, id and role; what speaks against the element)."""
    named: dict[str, str] = {}
    hide = False
    for m in ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hide = True
        elif key in ("class", "id", "role"):
            named[key] = value
    hint = " ".join(named.values())
    if tag in NEVER or (tag == "label" and parent.tag not in SENTENCE):
        return hint, "never"
    if hide:
        return hint, "hidden"
    if tag == "header" and not parent.inside:
        return hint, "header"
    if tag in SELDOM:
        return hint, "beside"
    if not hint or tag in ("body", "html", "main"):
        return hint, ""
    if tag in HEADING or (tag == "article" and not READERS.search(hint)):
        own = named.get("class", "") if tag in HEADING else ""
        return hint, "beside" if own and BESIDE.search(own) else ""
    if READERS.search(hint):
        return hint, "readers"
    weak = " ".join(v for k, v in named.items() if k != "id") if parent.inside else hint
    if parent.inside and any(map(PLAIN.fullmatch, weak.split())):
        return hint, "beside"
    if BESIDE.search(hint) or WEAK.search(weak):
        return hint, "perhaps" if parent.inside else "beside"
    return hint, "top" if TOP.search(weak) else ""


def parse(page: str) -> list[Node]:
    """A tree of elements and text pieces, as its nodes from the top. Tags may be left open or cross."""
    at = Node("html", "", None, "")
    nodes, pos, open_tags = [at], 0, {}
    gone: set[str] = set()  # what isn't found any more from here on

    def ahead(what: str, start: int) -> int:
        found = -1 if what in gone else page.find(what, start)
        if found < 0:
            gone.add(what)
        return found

    def tag_end(start: int) -> int:
        while m := EDGE.search(page, start):
            if m[0] == ">":
                return m.start()
            close = ahead(m[0][-1], m.end())
            start = close + 1 if close >= 0 else m.end()
        return -1

    def leave(upto: Node) -> Node:
        n = at
        while n is not upto:
            open_tags[n.tag] -= 1
            n = n.parent
        return n

    while True:
        m = MARK.search(page, pos)
        if m is None:
            at.kids.append(page[pos:])
            break
        if m.start() > pos:
            at.kids.append(page[pos : m.start()])
        pos, name = m.end(), m[2]
        if name is None:
            mark = m[0]
            end = ahead({"<!--": "-->", "<![CDATA[": "]]>"}.get(mark, ">"), pos)
            if mark == "<![CDATA[":
                at.kids.append(entities.escape(page[pos : end if end >= 0 else len(page)]))
            pos = len(page) if end < 0 else end + (1 if len(mark) == 2 else 3)
            continue
        stop = -1 if ">" in gone else tag_end(pos)
        if stop < 0 and (stop := ahead(">", pos)) < 0:  # no tag ends from here on
            at.kids.append(page[m.start() :].replace("<", "&lt;"))
            break
        attrs, pos, name = page[pos:stop], stop + 1, name.lower()
        if m[1]:
            if open_tags.get(name):
                n = at
                while n.tag != name:
                    n = n.parent
                at = leave(n)
                open_tags[name] -= 1
                at = at.parent
            continue
        if name in ("html", "body") and open_tags.get(name):
            continue
        if name in RAW:
            end = None if name in gone else re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, pos)
            if end is None:
                gone.add(name)
                if attrs.rstrip().endswith("/") or name not in ("script", "style", "title", "textarea"):
                    continue
                pos = len(page)
            else:
                pos = page.find(">", end.end()) + 1 or len(page)
            continue
        if name in VOID:
            at.kids.append(None if name in ("br", "hr") else "")
            if name == "hr":
                at.kids.append(Node("hr", "", at, "never"))
                nodes.append(at.kids[-1])
            continue
        if name in BLOCK and open_tags.get("p"):  # a block ends an open paragraph
            p = at
            while p.tag != "p" and p.parent and p.tag not in ("td", "th", "li", "blockquote", "div", "section", "article", "button", "aside", "nav", "form"):
                p = p.parent
            if p.tag == "p":
                at = leave(p.parent)
        if name in CLOSES:
            p = at
            while p.parent and p.tag not in CLOSES[name] and p.tag not in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "div", "select") and not (p.tag == "tr" and name in ("td", "th")):
                p = p.parent
            if p.tag in CLOSES[name]:
                at = leave(p.parent)
        if at.depth >= DEPTH:
            at = leave(at.parent)
        hint, why = _judge(name, attrs, at)
        node = Node(name, hint, at, why)
        at.kids.append(node)
        nodes.append(node)
        open_tags[name] = open_tags.get(name, 0) + 1
        at = node
    return nodes


def left_out(nodes: list[Node], strict: bool = True) -> None:
    """Mark what is left out. A wrapper stays if most of the page's text and the article's headline or
    element are in it; a headline's wrapper stays in an article, and so does a section of paragraphs
    whose name only might speak against it. Not strict: only what never counts."""
    never = ("never", "hidden", "header") if strict else ("never", "hidden")
    holds: dict[int, str] = {}
    linked: dict[int, int] = {}
    prose: dict[int, int] = {}
    dull = lambda n: 2 * linked.get(id(n), 0) > n.size or 2 * prose.get(id(n), 0) < n.size
    for n in reversed(nodes):
        n.size += sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        if n.why in never:
            continue
        for sums, own in ((linked, n.tag == "a"), (prose, n.tag in PROSE or n.tag in HEADING)):
            got = n.size if own else sums.get(id(n), 0)
            if got:
                sums[id(n)] = got
                if n.parent:
                    sums[id(n.parent)] = sums.get(id(n.parent), 0) + got
        if n.tag in ("main", "h1") or (n.tag == "article" and not n.why):
            holds[id(n)] = "h1" if n.tag == "h1" else holds.get(id(n), n.tag)
        if n.parent:
            n.parent.size += n.size
            if id(n) in holds:
                holds[id(n.parent)] = holds[id(n)]
    whole = nodes[0].size
    for n in nodes:
        stays = not n.why or (n.why == "perhaps" and not dull(n)) or (n.why not in never and (not strict or (id(n) in holds and n.why != "readers" and (2 * n.size > whole or (n.why == "top" and (n.inside or GOOD.search(n.hint)))))))
        n.skip = not stays or (n.parent is not None and n.parent.skip)


def blocks_of(top: Node) -> list[tuple[Node, str, int]]:
    """(block element, its text, length of its text in links) in page order. Inline elements and
    line breaks don't end a block."""
    out: list = []
    run: list[str] = []
    state = [top, 0]

    def flush() -> None:
        raw = "".join(run)
        run.clear()
        if raw and not raw.isspace():
            text = SPACE.sub(" ", entities.unescape(raw) if "&" in raw else raw).strip()
            if text:
                out.append((state[0], text, min(state[1], len(text))))
        state[1] = 0

    # A stack instead of recursion: pages may nest deeper than Python's own stack allows.
    todo: list = [(top, 0, False)]
    while todo:
        node, i, link = todo.pop()
        kids = node.kids
        while i < len(kids):
            k = kids[i]
            i += 1
            if k is None:
                run.append(" ")
            elif isinstance(k, str):
                run.append(k)
                if link:
                    state[1] += len(k.strip())
            elif k.skip:
                if k.tag in BLOCK:
                    flush()
            else:
                todo.append((node, i, link))
                if k.tag in BLOCK:
                    flush()
                    state[0] = k
                todo.append((k, 0, link or k.tag == "a"))
                break
        else:
            if node.tag in BLOCK:
                flush()
                p = node.parent
                while p is not None and p.tag not in BLOCK:
                    p = p.parent
                state[0] = p or top
    flush()
    return out


def main_text(page: str) -> str:
    """The article of a page: blocks joined by an empty line."""
    if not page:
        return ""
    nodes = parse(page)
    left_out(nodes)
    blocks = blocks_of(nodes[0])
    if not blocks:  # all is in what looks like a wrapper
        for n in nodes:
            n.size = 0
        left_out(nodes, strict=False)
        blocks = blocks_of(nodes[0])
    if not blocks:
        return ""
    holders: dict[int, Node] = {}
    for node, text, linked in blocks:
        node.text += len(text)
        node.linked += linked
        if node.tag in HEADING:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
        points *= 1 - linked / len(text)
        # The block itself is a container where it isn't a paragraph; then parents by halves.
        n, share = (node.parent if node.tag in ("p", "pre", "li", "dd", "dt", "td", "th", "blockquote") and node.parent else node), 1.0
        while n is not None and share > 0.05:
            n.score += points * share
            holders[id(n)] = n
            n, share = n.parent, share / 2
    if not holders:
        return "\n\n".join(t for _, t, _ in blocks)
    headed = {id(node) for node, _, _ in blocks if node.tag == "h1"}
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.linked += n.linked
            if id(n) in headed:
                headed.add(id(n.parent))
    weigh = lambda n: (n.score + (25 if n.tag in ("article", "main") else 10 if n.hint and GOOD.search(n.hint) else 0)) * (1 - n.linked / n.text if n.text else 1)
    ranked = {k: weigh(n) for k, n in holders.items()}
    best = max(holders.values(), key=lambda n: ranked[id(n)])
    n = best
    while n is not None and n.tag != "article":
        n = n.parent
    if n is not None:  # parts of an article go together
        best = n
    while best.parent is not None and best.tag not in ("article", "main", "body", "html") and sum(1 for k in best.parent.kids if isinstance(k, Node) and not k.skip) == 1:
        best = best.parent
    inside = {id(best)}
    n = best.parent
    if n is not None and best.tag not in ("article", "main"):
        bar = 0.05 * ranked.get(id(best), 0)
        for k in n.kids:
            if not isinstance(k, Node) or k is best or k.skip or not k.text:
                continue
            density = k.linked / k.text
            if k.tag in HEADING or (id(k) in headed and density < 0.5) or (density < 0.5 and ranked.get(id(k), 0) + (bar if k.hint and k.hint == best.hint else 0) >= bar) or (k.tag in ("p", "blockquote", "pre", "ul", "ol", "dl", "table") and density < 0.5):
                inside.add(id(k))
    elif best.tag == "article" and n is not None:  # an article in parts, and its headline beside it
        inside |= {id(k) for k in n.kids if isinstance(k, Node) and not k.skip and ((k.tag == "article" and k.hint == best.hint and ranked.get(id(k), 0) >= 0.05 * ranked.get(id(best), 0)) or (k.tag == "h1" and id(best) not in headed))}
    kept: list[str] = []
    known: dict[int, bool] = {}
    for node, text, _ in blocks:
        seen, n = [], node
        while n is not None and id(n) not in known and id(n) not in inside:
            seen.append(id(n))
            n = n.parent
        ok = n is not None and (id(n) in inside or known[id(n)])
        known.update(dict.fromkeys(seen, ok))
        if ok:
            kept.append(text)
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns, text, n_chars (code points) of every row.

    Elements that never hold an article (menus, footers, sidebars, forms, scripts, comments of
    readers, hidden ones, those that class, id or role name so) are left out before scoring; a form or
    a container so named stays where most of the page and the article are in it, and all of these where
    nothing else is left. An article element is kept as a whole. Each
    remaining block passes points (one, one a comma, one a hundred characters up to three, times the
    share outside links) to its container, half to the next and so on; points are discounted by link
    density; the best container and siblings like it are kept, in page order, joined by an empty
    line. White space in a block is one space. A null, empty or text-free page gives an empty text;
    a page without tags gives its text; rows are independent, so repeated rows give repeated rows;
    other columns are ignored.
    """
    names = list(keep)
    picked = pages.select(*names, F.coalesce(F.col(html_col), F.lit("")).alias("_html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(x) for x in b.pop("_html")]
            yield b.assign(text=text, n_chars=[len(x) for x in text])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInPandas(run, f"{kinds}, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
