"""Block trees of HTML pages, and their alignment by simple tree matching.

A page becomes a tree of its block elements; inline markup leaves only its text.
Siblings with one label (tag, class and id without digits) are one iterated node, as
the rows of a list or the paragraphs of an article are for a wrapper. Elements nested
more than ``MAX_DEPTH`` deep lie in the deepest one that counts. Open tags at the end
of a page are closed there, an unfinished tag is dropped, a comment or script without
its end takes the rest.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

MAX_DEPTH = 256

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
CLOSES_PARAGRAPH = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CLOSES_PARAGRAPH | frozenset("html head body li dt dd tr td th thead tbody tfoot caption colgroup legend optgroup option".split())
#: What a start tag ends if it is open, and the elements beyond which it does not look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}), "thead": ({"tbody"}, {"table"}),
        "tfoot": ({"tbody", "tr"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
SCOPES = frozenset("table td th caption template button object".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())

#: Elements that never hold the article, and words by which class, id or role say the same.
ASIDE_TAGS = frozenset("""nav footer aside form head noscript template button select option dialog menu svg canvas object audio video
    datalist legend optgroup search""".split()) | RAW
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement adverts advertising adsense sponsor sponsored sponsors promo promos promotion
    banner banners cookie cookies consent gdpr notice notices alert popup modal overlay menu menus nav navbar navigation navi
    breadcrumb breadcrumbs topbar footer sidebar sidebars rail widget widgets related recommended recommendations
    comment comments commentlist disqus reply replies respond responses share sharing social subscribe subscription newsletter signup
    login pagination pager toolbar copyright complementary contentinfo navigation dialog search toc""".split())
HEADER_WORDS = frozenset({"header", "masthead"})
#: What is beside the article even around an article element, as comments and teasers often are such elements.
READERS_WORDS = frozenset("""comment comments commentlist disqus reply replies respond responses related recommended
    recommendations sidebar widget promo sponsored""".split())
_NEGATED = frozenset({"has", "no", "with", "without", "not"})
MAIN, ASIDE, HEADER = "M", "B", "H"

_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|["'])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """Nodes in page order: labels, parents and kinds. Node 0 is the page."""
    labels: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    kinds: list[str] = field(default_factory=lambda: [""])

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.labels]
        for node, parent in enumerate(self.parents[1:], 1):
            out[parent].append(node)
        return out

    def encode(self) -> str:
        return "\n".join(f"{p}\t{k}\t{x}" for p, k, x in zip(self.parents, self.kinds, self.labels))

    @classmethod
    def decode(cls, text: str) -> Tree:
        rows = [line.split("\t") for line in text.split("\n")]
        return cls([r[2] for r in rows], [int(r[0]) for r in rows], [r[1] for r in rows])


@dataclass
class Page:
    tree: Tree
    #: (node, text, characters of it inside links) in page order
    blocks: list[tuple[int, str, int]]


def names_of(attributes: str) -> tuple[str, str]:
    """(label part, kind) that class, id, role and itemprop give an element."""
    if "=" not in attributes:
        return "", ""
    parts, kinds = [], set()
    for name, *value in _NAMES.findall(attributes):
        for token in html.unescape(value[0] or value[1] or value[2]).split():
            words = [w.lower() for w in _WORDS.findall(token)]
            if not words:
                continue
            parts.append("-".join(words))
            ends = {words[0], words[-1]}
            if name.lower() in ("role", "itemprop"):
                kinds |= {MAIN} if words in (["main"], ["article", "body"]) else set()
            if not _NEGATED & set(words):
                kinds |= {ASIDE} if ends & ASIDE_WORDS else {HEADER} if ends & HEADER_WORDS else set()
    kind = next((k for k in (MAIN, ASIDE, HEADER) if k in kinds), "")
    return "." + ".".join(sorted(set(parts))) if parts else "", kind


class _Builder:
    def __init__(self):
        self.tree, self.blocks, self.stack = Tree(), [], [("", 0)]
        self.known: dict[tuple[int, str], int] = {}
        self.buffer: list[str] = []
        self.links = self.linked = self.beyond = 0

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.blocks.append((self.stack[-1][1], text, self.linked))
            self.buffer, self.linked = [], 0

    def text(self, raw: str) -> None:
        raw = html.unescape(raw) if "&" in raw else raw
        self.buffer.append(raw)
        if self.links:
            self.linked += len(raw.strip())

    def pop_to(self, depth: int) -> None:
        node = self.stack[-1][1]
        if self.stack[depth - 1][1] != node:
            self.flush()
        for tag, _ in self.stack[depth:]:
            self.links -= tag == "a"
        del self.stack[depth:]

    def find(self, tags, until) -> int:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth][0]
            if tag in tags:
                return depth
            if tag in until:
                return 0
        return 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_PARAGRAPH:
            depth = self.find({"p"}, SCOPES)
            if depth:
                self.pop_to(depth)
            if tag in HEADINGS and self.stack[-1][0] in HEADINGS:
                self.pop_to(len(self.stack) - 1)
        if tag in ENDS:
            depth = self.find(*ENDS[tag])
            if depth:
                self.pop_to(depth)
        elif tag == "a" and self.links:
            depth = self.find({"a"}, SCOPES)
            if depth:
                self.pop_to(depth)
        if tag in VOID:
            if tag in ("br", "hr"):
                self.buffer.append(" ") if tag == "br" else self.flush()
            return
        if len(self.stack) >= MAX_DEPTH:
            self.beyond += 1
            return
        part, kind = names_of(attributes)
        if tag not in BLOCKS and tag not in ASIDE_TAGS and (tag == "a" or kind != ASIDE):
            self.links += tag == "a"
            self.stack.append((tag, self.stack[-1][1]))
            return
        self.flush()
        if tag in ("html", "body"):
            kind = ""
        elif tag in ASIDE_TAGS:
            kind = ASIDE
        elif tag in ("article", "main"):
            kind = kind or MAIN
        elif tag == "header":
            kind = HEADER
        parent, label = self.stack[-1][1], tag + part
        node = self.known.get((parent, label))
        if node is None:
            node = self.known[parent, label] = len(self.tree.labels)
            self.tree.labels.append(label)
            self.tree.parents.append(parent)
            self.tree.kinds.append(kind)
        self.stack.append((tag, node))

    def end(self, tag: str) -> None:
        if tag == "br":
            self.buffer.append(" ")
        elif self.beyond:
            self.beyond -= 1
        else:
            depth = self.find({tag}, () if tag in TABLE_PARTS else SCOPES - {tag})
            if depth:
                self.pop_to(depth)


def parse(source: str) -> Page:
    """The block tree of a page and the texts of its blocks."""
    build, at, size = _Builder(), 0, len(source)
    while at < size:
        token = _TOKEN.search(source, at)
        if token is None:
            build.text(source[at:])
            break
        if token.start() > at:
            build.text(source[at:token.start()])
        at = token.end()
        tag = token[2]
        if tag is None or source[at - 1] != ">":
            continue
        tag = tag.lower()
        if token[1]:
            build.end(tag)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            if end is None:
                break
            close = source.find(">", end.end())
            at = size if close < 0 else close + 1
            continue
        build.start(tag, token[3])
    build.flush()
    _spare_main(build.tree)
    return Page(build.tree, build.blocks)


def _spare_main(tree: Tree) -> None:
    """What holds the article is not beside it, whatever its names say."""
    for node in range(len(tree.labels) - 1, 0, -1):
        if tree.kinds[node] == MAIN:
            above = tree.parents[node]
            while above > 0:
                tag, *names = re.split(r"[.-]", tree.labels[above])
                if tree.kinds[above] == ASIDE and (tag in ASIDE_TAGS - {"form"} or READERS_WORDS & set(names)):
                    break  # an article element in a menu, a sidebar or among comments is not the article
                if tree.kinds[above] in (ASIDE, HEADER):
                    tree.kinds[above] = ""
                above = tree.parents[above]


def match_trees(left: Tree, right: Tree) -> list[int]:
    """For every node of left the node of right that simple tree matching pairs it with, or -1.

    The roots pair; among the children of a pair, the order-preserving pairing of equal
    labels whose subtrees hold the most pairs is taken.
    """
    mine, theirs = left.children(), right.children()
    weights: dict[tuple[int, int], int] = {}
    choice: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def weigh(a: int, b: int) -> int:
        found = weights.get((a, b))
        if found is not None:
            return found
        first, second = mine[a], theirs[b]
        place = {right.labels[y]: j for j, y in enumerate(second)}
        # Labels are unique among siblings: every child has one possible partner.
        options = [(i, place[left.labels[x]]) for i, x in enumerate(first) if left.labels[x] in place]
        pairs: list[tuple[int, int]] = []
        if all(options[k][1] < options[k + 1][1] for k in range(len(options) - 1)):
            total, pairs = sum(weigh(first[i], second[j]) for i, j in options), [(first[i], second[j]) for i, j in options]
        else:
            total, pairs = _heaviest([(j, weigh(first[i], second[j]), (first[i], second[j])) for i, j in options])
        weights[a, b], choice[a, b] = total + 1, pairs
        return total + 1

    weigh(0, 0)
    partner, todo = [-1] * len(left.labels), [(0, 0)]
    while todo:
        a, b = todo.pop()
        partner[a] = b
        todo += choice[a, b]
    return partner


def _heaviest(options: list[tuple[int, int, tuple[int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest chain of options with ascending places: a maximum over prefixes in a Fenwick tree."""
    size = max(j for j, _, _ in options) + 2
    best: list[tuple[int, int]] = [(0, -1)] * size
    back, weight = [-1] * len(options), [0] * len(options)
    for k, (j, w, _) in enumerate(options):
        at, top = j, (0, -1)
        while at > 0:
            top = max(top, best[at])
            at -= at & -at
        weight[k], back[k] = top[0] + w, top[1]
        at = j + 1
        while at < size:
            best[at] = max(best[at], (weight[k], k))
            at += at & -at
    k = max(range(len(options)), key=lambda x: weight[x])
    total, chain = weight[k], []
    while k >= 0:
        chain.append(options[k][2])
        k = back[k]
    return total, chain[::-1]
