"""HTML main text by tag-path ratios.

A page becomes blocks in page order, each with its root-to-leaf path of block tags (with classes and
ids) and its text; menus, headers, footers, adverts and the like are blocks as any other.

Path table. Text length, punctuation and characters in links are summed by path over its blocks. Two ratios come
of that: text per block, and punctuation per block weighed by the share of text outside links. Both
are smoothed over the page by a Gaussian along the blocks and fused by their product; a path's score is the
mean of its blocks'. Tags and names are evidence on a path: each element with a tag or a class, id or role word
that speaks of menus, headers, footers, sidebars, notices, adverts, forms or comments is weighed against the
mass (text outside links, less where its ratio is below the deviation) that the page has below it. A score becomes 0 below an element for which that holds:

* nav, header (outside articles), footer, aside, dialog, menu: always;
* a form: fewer than PROSE_A_CONTROL characters outside links for each of its controls, and no article in it;
* readers' comments: not over MOST_COMMENTS of the page's mass; other outside words: not over MOST of it;
* ambiguous words as a whole name: not over MOST of it, and within an article or on a paragraph only if the ratios
  agree (a mass of under half its text, on a paragraph mostly links); as part of a name: mostly links.

What article and main elements hold weighs ARTICLE times in these masses. Where they hold most of what is left, or a
third of it and the page's only headlines, scores outside them are divided by ARTICLE. So these elements, too,
are evidence, and text outside them that the ratios speak for stays. The threshold is the deviation of the fused ratio over the blocks whose score isn't 0: paths that reach it are content.

Nodes. The smallest element that holds most of the content paths' mass is the article's body; its blocks are
the text, short ones too, with those branches beside it and its ancestors that are headings or low in links, or else
their blocks of content paths (which is all that a body within an article takes from outside, and the headline if it lacks one; an
article without a headline that lies beside a body of another kind is a teaser and gives no more either). Paths of score 0, and outside articles paths below
the threshold that are mostly links, are left out everywhere.

Hidden elements (hidden, aria-hidden, display:none, a class `hidden` without classes for widths beside it) are left out, but for those that hold over
MOST of the page's text outside links. Buttons and labels among the words of a sentence are words of it. Where nothing but headings is left, links
count as other text.

Defined cases: null or empty html has an empty text; an empty table gives no rows; a page without tags is one block; text is
whole, never cut; tags may be left open (p, li, td and the like close each other), inline tags are
no part of a path; references are decoded once; repeated rows are read one by one; extra columns
are ignored.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTRS = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp")}

#: Elements whose text is no text of the page, and elements around the article: fixed values.
DROPPED = frozenset("head script style noscript template iframe noframes object embed svg canvas audio video map button select option textarea input label datalist".split())
#: Of these, the elements that are words of a sentence where they stand in one, and the elements that sentences stand in.
_IN_SENTENCE = frozenset("button label map object".split())
_SENTENCES = frozenset("p li dt dd blockquote pre td th figcaption caption h1 h2 h3 h4 h5 h6 div section article main".split())
AROUND = frozenset("nav header footer aside dialog menu menuitem".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr br "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open element of these, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_SCOPES = frozenset("html body table td th article aside section div nav header footer main form blockquote figure li button caption object template".split())
#: Words of a class, id or role that mark an element as outside the article, unless it holds most of the page.
_OUTSIDE = re.compile(
    r"(?:^|[_-])(ad|ads|adv|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|sidenav|header|masthead|topbar|footer|bottombar|"
    r"copyright|cookies?\w*|gdpr|popup|modal|newsletter|comments?|commentlist|disqus\w*|share|sharing|toolbar|pagination|pager|tagcloud|navigation|complementary|contentinfo)(?=$|[_-])",
    re.I,
)
#: Words that do so as whole names, and as parts of names where the element is mostly links.
_AMBIGUOUS = re.compile(
    r"(?:^|[_-])(rail|foot|legal|consent|notices?|notification\w*|alert|overlay|subscri\w*|signup|login|search\w*|respond|replies|reply|discussion|related\w*|recommend\w*|trending|"
    r"popular|social\w*|follow|skip\w*|tags?|dialog|form|widget\w*)(?=$|[_-])",
    re.I,
)
#: The share of the page's mass from which an element is never left out for its names; more for readers' comments.
MOST, MOST_COMMENTS = 0.5, 0.9
#: How much more text within article and main elements weighs.
ARTICLE = 8.0
_COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|disqus\w*|respond|replies|reply|discussion)(?=$|[_-])", re.I)
#: Beginnings of class names that speak of an element's surroundings, and words that make a header part of the article.
_ABOUT = ("has-", "no-", "with-", "without-", "is-", "not-", "js-")
_INSIDE = re.compile(r"(?:^|[_-])(?:article|content|post|entry|story)(?:$|[_-])", re.I)
_CONTROLS = frozenset("input select textarea button".split())
_UNSEEN = re.compile(r"""\btype\s*=\s*["']?hidden""", re.I)
#: Characters outside links for each control that a form has at least if it is part of the text: a fixed value.
PROSE_A_CONTROL = 80
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are paragraphs of their parent, whatever their names say of their looks.
_PARAGRAPHS = _HEADINGS | frozenset("p li dt dd blockquote pre td th tr figcaption caption".split())
_LETTER = re.compile(r"\w")
_WIDTHS = re.compile(r"(?:d|visible|show)-(?:xs|sm|md|lg|xl|xxl|print)\b|visible\b")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


class _Node:
    __slots__ = ("tag", "parent", "path", "outside", "depth", "mass", "controls", "prose", "mark", "size", "links", "inside", "hidden")

    def __init__(self, tag: str, label: str, parent: _Node | None, outside: bool):
        self.tag, self.parent = tag, parent
        self.path = f"{parent.path}/{label}" if parent else label
        self.outside = outside or bool(parent and parent.outside)
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = parent.hidden if parent else ()
        self.mass = 0.0
        self.controls = self.prose = self.size = self.links = 0
        self.mark = ""


def blocks(page: str, linked: bool = True) -> list[tuple[_Node, str, int]]:
    """(element, text, characters in links) of every block with text, in page order; links count as other text if not `linked`."""
    node = root = _Node("", "", None, False)
    out: list[tuple[_Node, str, int]] = []
    parts: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text and not node.outside:
                out.append((node, text, links))
            parts.clear()
        links = 0

    def close(upto: _Node) -> None:
        nonlocal node
        flush()
        node = upto.parent or root

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            links += in_link and m.start() - at
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                parts.append(htmllib.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = name.lower(), bool(m[1])
        if tag in ("annotation", "annotation-xml"):  # a formula's source beside the formula
            stop = None if closing or m[3].endswith("/") else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else at
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = int(linked and not closing)
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in _IN_SENTENCE and (_open(node, tag) is None if closing else _in_sentence(page, at, tag, parts, node)):
            continue
        if closing:
            at_node = node
            while at_node is not root and at_node.tag != tag:
                at_node = at_node.parent
            if at_node is not root and not (tag == "p" and _scoped(node, at_node)):
                close(at_node)
            else:
                flush()
            continue
        if tag in _CONTROLS and not (tag == "input" and _UNSEEN.search(m[3])):
            up = node
            while up is not root and up.tag != "form":
                up = up.parent
            up.controls += 1
        if tag in _RAW_END:
            flush()
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in _CLOSES_P:
            up = node
            while up is not root and up.tag not in _SCOPES:
                if up.tag == "p":
                    close(up)
                    break
                up = up.parent
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            up, last = node, None
            while up is not root and up.tag not in scope:
                if up.tag in ends:
                    last = up
                up = up.parent
            if last:
                close(last)
        if tag == "body" or tag in ("article", "main"):
            up = node
            while up is not root:
                if up.tag == "head":
                    close(up)
                    break
                up = up.parent
        flush()
        if tag in VOID:
            continue
        label, outside, veiled = tag, tag in DROPPED, False
        names = "around" if tag in AROUND and not (tag == "header" and node.inside) else ""
        if m[3].strip():
            named = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRS.findall(m[3])}
            mark = " ".join(filter(None, (named.get("class"), named.get("id"), named.get("role"))))
            if mark:
                label = f"{tag}.{mark}"
                names = names or ("" if tag in ("html", "body", "article", "main") else _mark(mark.split()))
            veiled = _hidden(named, mark)
        node = _Node(tag, label, node, outside)
        node.mark = names
        if veiled:
            node.hidden = (*node.hidden, node)
        in_link = 0
    flush()
    return _unveiled(out)


def _open(node: _Node, tag: str) -> _Node | None:
    """The nearest open element of that tag."""
    up: _Node | None = node
    while up is not None and up.tag != tag:
        up = up.parent
    return up


def _in_sentence(page: str, at: int, tag: str, parts: list[str], node: _Node) -> bool:
    """Whether an element that opens here stands among the words of a sentence: text before or behind it, and no form or toolbar around."""
    up = node
    while up.parent is not None:
        if up.tag in ("form", "nav", "menu", "fieldset") or up.mark:
            return False
        up = up.parent
    if node.outside or node.tag not in _SENTENCES:
        return False
    if any(map(_LETTER.search, parts)):
        return True
    end = page.find(f"</{tag}", at)
    behind = page.find(">", end) if end >= 0 else -1
    return behind >= 0 and bool(_LETTER.match(page[behind + 1 : behind + 40].lstrip()))


def _unveiled(found: list[tuple[_Node, str, int]]) -> list[tuple[_Node, str, int]]:
    """found without the blocks of hidden elements, but for those elements that hold over MOST of the page's text outside links: they are shown by other means."""
    if not any(node.hidden for node, _, _ in found):
        return found
    whole, held = 0, {}
    for node, text, links in found:
        mass = len(text) - min(links, len(text))
        whole += mass
        for x in node.hidden:
            held[x] = held.get(x, 0) + mass
    return [x for x in found if all(held[h] > MOST * whole for h in x[0].hidden)]


def _mark(names: list[str]) -> str:
    """What the names of an element say: `outside`, `comments`, `named` or `partly` (ambiguous words as a whole name or part of one), or nothing."""
    found = ""
    for name in names:
        if name.lower().startswith(_ABOUT):
            continue
        hit = _OUTSIDE.search(name)
        if hit and hit[1].lower() == "header" and _INSIDE.search(name):
            hit = None
        word = _AMBIGUOUS.search(name)
        if (hit or word and word[0] == name) and _COMMENTS.search(name):
            found = "comments"
        elif hit:
            return "outside"
        elif word and found != "comments":
            found = "named" if word[0] == name else found or "partly"
    return found


def _hidden(named: dict[str, str], mark: str) -> bool:
    """Whether an element's attributes hide it. Beside classes for some widths the class `hidden` speaks of others alone."""
    names = mark.lower().split()
    by_class = "hidden" in names and not any(":" in x or _WIDTHS.match(x) for x in names)
    return by_class or "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").lower().replace(" ", "")


def _scoped(node: _Node, upto: _Node) -> bool:
    while node is not upto:
        if node.tag in _SCOPES:
            return True
        node = node.parent
    return False


def _smooth(values: list[float]) -> list[float]:
    """A Gaussian of deviation 1 over five blocks, with the ends weighed anew."""
    kernel = [math.exp(-k * k / 2) for k in range(3)]
    out = []
    for i in range(len(values)):
        top = bottom = 0.0
        for j in range(max(0, i - 2), min(len(values), i + 3)):
            w = kernel[abs(i - j)]
            top, bottom = top + w * values[j], bottom + w
        out.append(top / bottom)
    return out


def path_ratios(found: list[tuple[_Node, str, int]]) -> dict[str, tuple[float, float]]:
    """{path: (mean fused ratio, share of its characters in links)}."""
    total: dict[str, list[float]] = {}
    for node, text, links in found:
        t = total.setdefault(node.path, [0, 0, 0, 0])
        for k, x in enumerate((1, len(text), len(_PUNCTUATION.findall(text)), min(links, len(text)))):
            t[k] += x
    text_ratio = {p: t[1] / t[0] for p, t in total.items()}
    punct_ratio = {p: (1 + t[2] / t[0]) * (1 - t[3] / t[1] + _LEAST) for p, t in total.items()}
    a = _smooth([text_ratio[n.path] for n, _, _ in found])
    b = _smooth([punct_ratio[n.path] for n, _, _ in found])
    fused: dict[str, float] = {}
    for (node, _, _), x, y in zip(found, a, b):
        fused[node.path] = fused.get(node.path, 0.0) + x * y
    return {p: (fused[p] / t[0], t[3] / t[1]) for p, t in total.items()}


#: What a path of links alone keeps of its punctuation ratio, so that 0 stands for paths ruled out by evidence.
_LEAST = 1e-6


def _threshold(values: list[float]) -> float:
    mean = sum(values) / len(values) if values else 0.0
    return min(math.sqrt(sum((x - mean) ** 2 for x in values) / len(values)), max(values)) if values else 0.0


def path_scores(found: list[tuple[_Node, str, int]]) -> tuple[dict[str, float], float]:
    """({path: fused ratio, or 0 where the evidence of tags and names holds}, threshold)."""
    ratios = path_ratios(found)
    first = _threshold([ratios[n.path][0] for n, _, _ in found])
    share = {p: min(1.0, x / first) if first else 1.0 for p, (x, _) in ratios.items()}
    whole = 0.0
    for node, text, links in found:
        links = min(links, len(text))
        mass = share[node.path] * (len(text) - links) * (ARTICLE if node.inside else 1)
        whole += mass
        article, up = False, node
        while up is not None:
            up.size, up.links, up.mass = up.size + len(text), up.links + links, up.mass + mass
            article = article or up.tag in ("article", "main")
            if up.tag == "form":  # what an article or main element in the form holds is text at any length
                up.prose += PROSE_A_CONTROL * (up.controls + 1) if article else len(text) - links
            up = up.parent

    def holds(node: _Node) -> bool:
        if node.mark == "around":
            return True
        if node.tag == "form" and node.prose <= PROSE_A_CONTROL * node.controls and not (node.size and node.size >= whole_size):
            return True
        if node.mark == "partly":
            return 2 * node.links >= node.size
        if node.mark == "named" and (node.inside or node.tag in _PARAGRAPHS):
            whole_share = (ARTICLE if node.inside else 1) * (node.size - node.links)
            return 2 * node.links >= node.size or node.tag not in _PARAGRAPHS and node.mass < whole_share / 2
        return bool(node.mark) and node.mass <= whole * (MOST_COMMENTS if node.mark == "comments" else MOST)

    whole_size = sum(len(text) for _, text, _ in found)
    ruled: dict[int, bool] = {}
    scores: dict[str, float] = {}
    for node, _, _ in found:
        chain, up = [], node
        while up is not None and id(up) not in ruled:
            chain.append(up)
            up = up.parent
        out = up is not None and ruled[id(up)]
        for x in reversed(chain):
            out = ruled[id(x)] = out or holds(x)
        # of elements with one path, some may be ruled out and others not: the path lives if one of them does
        scores[node.path] = max(scores.get(node.path, 0.0), 0.0 if out else ratios[node.path][0])
    if _bounds([x for x in found if scores[x[0].path]], share):
        outside = {n.path for n, _, _ in found if not n.inside}
        scores = {p: x / ARTICLE if p in outside else x for p, x in scores.items()}
    return scores, _threshold([scores[n.path] for n, _, _ in found if scores[n.path]])


def _bounds(found: list[tuple[_Node, str, int]], share: dict[str, float]) -> bool:
    """Whether article and main elements hold most of the mass, or the only headlines and a third of it."""

    def mass(rows: list[tuple[_Node, str, int]]) -> float:
        return sum(share[node.path] * max(0, len(text) - links) for node, text, links in rows)

    inside = [x for x in found if x[0].inside]
    part, whole = mass(inside), mass(found)
    return 2 * part > whole or 0 < _headlines(inside) == _headlines(found) and 3 * part > whole


def _headlines(rows: list[tuple[_Node, str, int]]) -> int:
    return sum(node.tag == "h1" for node, _, _ in rows)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    chosen = _main_blocks(blocks(page))
    if all(node.tag in _HEADINGS for node, _, _ in chosen):  # nothing but links: then these are the text, where no other evidence speaks against them
        chosen = _main_blocks(blocks(page, linked=False)) or chosen
    return "\n".join(text for _, text, _ in chosen)


def _main_blocks(found: list[tuple[_Node, str, int]]) -> list[tuple[_Node, str, int]]:
    """The blocks that are the page's text, in page order."""
    if not found:
        return []
    scores, threshold = path_scores(found)
    links = {p: x for p, (_, x) in path_ratios(found).items()}
    found = [x for x in found if scores[x[0].path] and (x[0].inside or scores[x[0].path] >= threshold or 2 * links[x[0].path] < 1)]
    whole = 0.0
    seen: list[_Node] = []
    held: dict[int, float] = {}
    for node, text, linked in found:
        mass = len(text) - min(linked, len(text)) if scores[node.path] >= threshold else 0
        whole += mass
        up: _Node | None = node
        while up is not None:
            if id(up) not in held:
                seen.append(up)
            held[id(up)] = held.get(id(up), 0.0) + (mass or 1e-9)
            up = up.parent
    if not seen:
        return []
    # the deepest element with nearly all of the content; an article that holds most of it bounds it from above and below
    best = max((n for n in seen if held[id(n)] >= 0.9 * whole), key=lambda n: n.depth)
    marked = [n for n in seen if n.tag in ("article", "main") and held[id(n)] >= 0.5 * whole]
    if marked:
        best = max(marked, key=lambda n: (held[id(n)], n.depth))
    elif best.tag not in ("article", "main", "section", "div", "body", "html", "td", "") and best.parent is not None:
        best = best.parent
    return [found[k] for k in sorted(_kept(found, best, {p for p, x in scores.items() if x >= threshold}))]


def _kept(found: list[tuple[_Node, str, int]], best: _Node, content: set[str]) -> set[int]:
    """Numbers of the blocks below best, and of those elsewhere that belong to it.

    Away from best, branches hanging from its ancestors are taken whole if they are headings or low in
    links, else their blocks of content paths; branches outside best's article, and teasers, only those.
    """
    above, up = set(), best.parent
    while up is not None:
        above.add(up)
        up = up.parent
    out: set[int] = set()
    branches: dict[_Node | int, list[int]] = {}
    for k, (node, _, _) in enumerate(found):
        top, up = None, node  # the branch: the highest element above the block that is not above best
        while up is not best and up not in above:
            top, up = up, up.parent
        if up is best:
            out.add(k)
        else:
            branches.setdefault(k if top is None else top, []).append(k)
    untitled = best.inside and not _headlines([x for x in found if x[0].inside])
    for ks in branches.values():
        text, links = (sum(x) for x in zip(*((len(found[k][1]), min(found[k][2], len(found[k][1]))) for k in ks)))
        if best.inside and not found[ks[0]][0].inside:
            whole = untitled and all(found[k][0].tag == "h1" for k in ks)
        elif not best.inside and all(found[k][0].inside for k in ks) and not _headlines([found[k] for k in ks]):
            whole = False
        else:
            whole = 2 * links < text or all(found[k][0].tag in _HEADINGS for k in ks)
        out |= {k for k in ks if whole or found[k][0].path in content}
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            cols = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.record_batch(cols, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
