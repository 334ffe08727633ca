"""Main text of web pages by wrapper induction.

The pages of a host share a template. Their block trees are aligned with the host's
reference, its most common tree, by simple tree matching; what the aligned nodes hold
is counted over all pages of the host. A node whose pages nearly all say the same is
template, one that varies is a slot. The article is the marked-up main element of the
reference or, without one, the deepest node that holds most of the varying text; its
slots are content, less what the markup names as a menu, notice, advert, form, sidebar
or reader comments.

Pages that share their longest block count once, so copies of a page make no template
of their article. A node speaks for a template from ``MIN_PAGES`` such pages on; pages
of smaller hosts are wrapped by the markup alone. A page without the host's article
node is wrapped on its own.

Only trees and 64-bit hashes of blocks are grouped by host, and every grouping is by
(host, node, value) or combines beforehand, so a host with a third of all pages is
spread. Templates, one row a host, are broadcast if their measured size is at most
``BROADCAST_BYTES``, and pages are not shuffled at all; beyond that both sides meet by
host and salt.

Defined results: a null or empty page has no text; a null url or one without ``://``
belongs to the host ''; rows may repeat and each is answered; null ids are answered
like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.dom import ASIDE, HEADER, MAIN, Page, Tree, match_trees, parse
from tallyframe.llm.words import bound_batches
from tallyframe.session import materialize

MIN_PAGES = 3
CONSTANT_SHARE = 0.9
DOMINANT_SHARE = 0.7
LINK_SHARE = 0.6
BROADCAST_BYTES = 32 << 20
SALTS = 64
#: Elements that may hold an article, and those whose text is a menu if it is all links.
_CONTAINERS = frozenset("html body div section article main center form table tbody tr td".split())
_LISTS = frozenset("ul ol li dl dd dt div section table tr td th tbody span".split())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


_SHAPES = "host string, anchor long, tree string, tree_hash long, nodes array<int>, values array<long>, chars array<int>, links array<int>"


def _shapes(batches) -> Iterator[pa.RecordBatch]:
    """The trees and block hashes of pages; the anchor is the longest block."""
    for part in batches:
        out = []
        for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
            page = parse(source or "")
            tree = page.tree.encode()
            longest = max((b[1] for b in page.blocks), key=len, default="")
            out.append((host, _hash(longest), tree, _hash(tree), [b[0] for b in page.blocks], [_hash(b[1]) for b in page.blocks],
                        [len(b[1]) for b in page.blocks], [b[2] for b in page.blocks]))
        names = ["host", "anchor", "tree", "tree_hash", "nodes", "values", "chars", "links"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()),
                 pa.list_(pa.int32())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


@lru_cache(maxsize=1024)
def _slots(tree: str, reference: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """For each node of tree its partner in reference or -1, and its slot.

    A slot is the partner's number; a node without one is an optional node of the
    template, named by the labels that lead to it from the nearest partner.
    """
    mine = Tree.decode(tree)
    partner, names = match_trees(mine, Tree.decode(reference)), []
    for node, slot in enumerate(partner):
        names.append(str(slot) if slot >= 0 else f"{names[mine.parents[node]]}>{mine.labels[node]}")
    return tuple(partner), tuple(names)


def _votes(batches) -> Iterator[pa.RecordBatch]:
    """(host, slot, value, chars, links): what a page's aligned blocks say, each value of a node once."""
    for part in batches:
        rows: dict[str, list] = {"host": [], "slot": [], "value": [], "chars": [], "links": []}
        for row in part.to_pylist():
            _, names = _slots(row["tree"], row["reference"])
            said: dict[tuple[str, int], list[int]] = {}
            for node, value, chars, links in zip(row["nodes"], row["values"], row["chars"], row["links"]):
                total = said.setdefault((names[node], value), [0, 0])
                total[0] += chars
                total[1] += links
            for (slot, value), (chars, links) in said.items():
                for name, x in zip(rows, (row["host"], slot, value, chars, links)):
                    rows[name].append(x)
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.values(), types)], list(rows))


def _beside_host(rows: DataFrame, hosts: DataFrame, body: str) -> DataFrame:
    """rows with the ``body`` text of their host, or null."""
    hosts = materialize(hosts.select("host", body), "hosts")
    size = hosts.agg(F.sum(F.octet_length(body) + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(hosts), "host", "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    copies = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["host", "_salt"], "left").drop("_salt")


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, template): the wrapper of every host as JSON.

    template holds the reference tree and, a slot, how many values its nodes had, how
    many of them said the most common one, their characters and those inside links. Nodes
    that the reference lacks are optional ones, kept where they turn out to be template.
    """
    bound_batches(pages.sparkSession)
    shapes = materialize(pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
                         .mapInArrow(_shapes, _SHAPES), "shapes")
    body = F.struct("tree", "tree_hash", "nodes", "values", "chars", "links")
    voters = shapes.groupBy("host", "anchor").agg(F.min_by(body, F.struct("tree_hash", "values")).alias("page")).select("host", "page.*")
    trees = voters.groupBy("host", "tree_hash").agg(F.min("tree").alias("tree"), F.count("*").alias("n"))
    references = trees.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree_hash")).alias("reference"), F.sum("n").alias("pages"))
    votes = _beside_host(voters, references, "reference").mapInArrow(
        _votes, "host string, slot string, value long, chars long, links long")
    values = votes.groupBy("host", "slot", "value").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    slots = values.groupBy("host", "slot").agg(F.sum("n").alias("said"), F.max("n").alias("same"), F.sum("chars").alias("chars"),
                                               F.sum("links").alias("links"))
    # Optional nodes count only where they are template.
    telling = (F.col("said") >= MIN_PAGES) & ((F.col("same") >= CONSTANT_SHARE * F.col("said")) | (F.col("links") >= LINK_SHARE * F.col("chars")))
    per_host = slots.where(~F.contains("slot", F.lit(">")) | telling).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "said", "same", "chars", "links"))).alias("slots"))
    return references.join(per_host, "host", "left").select(
        "host", "pages", F.to_json(F.struct("reference", "slots")).alias("template"))


class Wrapper:
    """A template made ready: which slots of its tree are the article's content."""

    def __init__(self, tree: Tree, slots: dict[str, tuple[int, int, int, int]]):
        self.tree, self.text = tree, tree.encode()
        self.constant = {s for s, (said, same, _, _) in slots.items() if said >= MIN_PAGES and same >= CONSTANT_SHARE * said}
        self.linked = {s for s, (_, _, chars, links) in slots.items()
                       if links >= LINK_SHARE * chars and self._label(s).split(".")[0] in _LISTS}
        beside = [False] * len(tree.labels)
        for node in range(1, len(beside)):
            beside[node] = beside[tree.parents[node]] or tree.kinds[node] == ASIDE or tree.kinds[node] == HEADER
        chars = [0] * len(beside)
        for s, (_, _, n, _) in slots.items():
            if s not in self.constant and s not in self.linked and ">" not in s:
                chars[int(s)] = n
        self.marked, self.region = self._main(chars, beside)

    def _main(self, own: list[int], beside: list[bool]) -> tuple[bool, frozenset[int]]:
        """Whether the article is marked up, and its topmost nodes."""
        tree = self.tree
        chars = [0 if b else n for n, b in zip(own, beside)]
        inside = list(own)
        for node in range(len(own) - 1, 0, -1):
            chars[tree.parents[node]] += chars[node]
            inside[tree.parents[node]] += inside[node]
        children = tree.children()
        marked = [n for n in range(len(own)) if tree.kinds[n] == MAIN and not beside[n]]
        articles = [n for n in marked if tree.labels[n].split(".")[0] != "main"]
        for some in (articles, marked):
            top = [n for n in some if not any(a in some for a in self._above(n))]
            held, all_held = sum(inside[n] for n in top), sum(inside[n] for n in marked if not any(a in marked for a in self._above(n)))
            if top and (2 * held >= all_held or some is marked):
                return True, frozenset(top)
        node = 0
        while True:
            best = max((c for c in children[node] if not beside[c]), key=lambda c: chars[c], default=None)
            if best is None or not chars[best] or chars[best] < DOMINANT_SHARE * chars[node] \
                    or tree.labels[best].split(".")[0] not in _CONTAINERS:
                return False, frozenset({node})
            node = best

    def _label(self, slot: str) -> str:
        return slot.rsplit(">", 1)[1] if ">" in slot else self.tree.labels[int(slot)]

    def _above(self, node: int) -> Iterator[int]:
        while (node := self.tree.parents[node]) >= 0:
            yield node


def wrapper_of(template: str) -> Wrapper:
    held = json.loads(template)
    return Wrapper(Tree.decode(held["reference"]),
                   {s["slot"]: (s["said"], s["same"], s["chars"], s["links"]) for s in held.get("slots") or []})


_ready = lru_cache(maxsize=256)(wrapper_of)


def own_wrapper(page: Page) -> Wrapper:
    """The wrapper of a page that shares its template with no other."""
    slots: dict[str, list[int]] = {}
    for node, text, links in page.blocks:
        total = slots.setdefault(str(node), [0, 0, 0, 0])
        total[0] += 1
        total[2] += len(text)
        total[3] += links
    return Wrapper(page.tree, {s: tuple(x) for s, x in slots.items()})


def main_text(page: Page, wrapper: Wrapper | None) -> str:
    """The content slots of a page, blocks in page order."""
    partner, slots = _slots(page.tree.encode(), wrapper.text) if wrapper else ((), ())
    if not wrapper or not wrapper.region & set(partner):
        wrapper, partner = own_wrapper(page), range(len(page.tree.labels))
        slots = [str(node) for node in partner]
    tree, silent = page.tree, wrapper.constant if wrapper.marked else wrapper.constant | wrapper.linked
    keep: list[bool] = []
    for node, slot in enumerate(partner):
        parent = tree.parents[node]
        above = node > 0 and keep[parent]
        beside = tree.kinds[node] == ASIDE or tree.kinds[node] == HEADER and not wrapper.marked
        keep.append(slot in wrapper.region or above and not beside)
    return " ".join(text for node, text, _ in page.blocks if keep[node] and slots[node] not in silent)


def _extract(batches) -> Iterator[pa.RecordBatch]:
    for part in batches:
        texts = []
        for source, template in zip(part.column("html").to_pylist(), part.column("template").to_pylist()):
            texts.append(main_text(parse(source), _ready(template) if template else None) if source else "")
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    hosts = templates(pages, url_col, html_col)
    kept = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return (_beside_host(kept.withColumn("host", host_of(F.col("url"))), hosts, "template")
            .select("page_id", "url", "html", "template").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"))
