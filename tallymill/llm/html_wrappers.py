"""Main text of web pages by wrappers inferred from the pages of a host.

A wrapper is a union-free regular expression over a page's tokens, nested as the tags are: elements in order,
each once, optional (?), repeated (+) or both (*), and text slots. It is inferred by alignment: the wrapper
so far is laid beside the next page's tokens; equal tokens are kept, different texts become a slot, what
only one side has becomes optional, and equal neighbours fold into a repeated group. Where the classes and
ids of a tag differ from page to page, a slot stands for them. Wrappers align with each other in the same way,
so tasks infer their own and only these small expressions meet per host, in a tree. The wrapper's text
statistics name the element that holds the article on that host; each page is then read along that path.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import stored, strings, text_udf
from tallymill.plans.skew import lookup_join

# Element names of HTML.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time "
                   "tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
                     "section table ul".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",),
            "option": ("select", "datalist")}
APART_TAGS = frozenset("head nav header footer aside form noscript template svg canvas button select option dialog menu object audio video map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that no class, id or role sets apart.
NEVER_APART = HEADINGS | frozenset(("html", "body", "main", "article"))
# Words of class, id and role that hint at what is not the article.
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
APART_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login search social share sharing related recommended "
    "recommendations pagination pager toolbar".split())
# Words that may stand beside them; any other word (has-sidebar, related-work) takes the hint away.
BESIDE_WORDS = frozenset("site top bottom left right global primary secondary box block area container wrapper wrap inner outer list item items "
                         "link links bar panel region section posts articles stories news post article entry page user reader slot form button buttons".split())
DEEPEST = 200
SHARE = 0.6
#: Items of one signature on a level, and signatures of one tag, beyond which they fold or join a slot.
WIDTH = 8
#: A text slot holds a constant text itself up to this length, a longer one's digest.
SHOWN = 64

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """An element: ``sig`` names it for alignment, ``apart`` says that it is no part of an article, ``hint`` that its
    class, id or role says so ("?", of comments "%"); statistics may overrule a hint."""

    __slots__ = ("tag", "sig", "apart", "hint", "kids")

    def __init__(self, tag: str, sig: str, apart: bool, hint: str = ""):
        self.tag, self.sig, self.apart, self.hint, self.kids = tag, sig, apart, hint, []


def _hint(value: str) -> str:
    """The hint of one class, id or role: all its words are known, one of them as that of a part that is no article."""
    words = {w.lower() for w in _WORDS.findall(value)}
    if words.isdisjoint(APART_WORDS) or not words <= APART_WORDS | BESIDE_WORDS or "header" in words and words & {"article", "post", "entry", "page"}:
        return ""
    return "?" if words.isdisjoint(COMMENT_WORDS) else "%"


def _element(tag: str, raw: str) -> Node:
    sig, apart, hidden, hint = tag, tag in APART_TAGS, False, ""
    if raw and not raw.isspace():
        for name, *values in _ATTRIBUTE.findall(raw):
            name, value = name.lower(), unescape(next((v for v in values if v), ""))
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
            elif name in ("class", "id", "role"):
                if tag not in NEVER_APART:
                    hint = max([hint, *map(_hint, value.split())], key=("", "?", "%").index)
                sig += {"class": ".", "id": "#", "role": "@"}[name] + " ".join(sorted({re.sub(r"\d+", "0", v) for v in value.split()}))
    return Node(tag, sig + ("!" if hidden else ""), apart or hidden, hint)


def parse(html: str) -> Node:
    """The page's block elements as a tree; kids are elements and (text, characters in links).

    Every open element is on the stack, so end tags close their own. Those deeper than DEEPEST are no nodes of
    the tree: their texts go to the one above, or nowhere if they are apart or hinted to be.
    """
    root = Node("", "", False)
    stack, text, link, links = [root], [], 0, 0
    places: dict[str, list[int]] = {}
    at = 0

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(depth: int) -> None:
        for node in reversed(stack[depth:]):
            places[node.tag].pop()
        del stack[depth:]

    def flush() -> None:
        nonlocal links
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            stack[-1].kids.append((joined, min(links, len(joined))))
        text.clear()
        links = 0

    while at < len(html):
        token = _TOKEN.search(html, at)
        chunk = html[at:token.start() if token else len(html)]
        if chunk:
            text.append(chunk)
            links += len(chunk) if link else 0
        if not token:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if token[1] else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush()
        if token[1]:
            if depth := last(tag):
                close(depth)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in SIBLINGS:
            depth = last(*(("dt", "dd", "td", "th") if tag in ("dt", "dd", "td", "th") else (tag,)))
            if depth > last(*SIBLINGS[tag]):
                close(depth)
        node = _element(tag, token[3])
        if len(stack) < DEEPEST:
            stack[-1].kids.append(node)
        elif not (node.apart or node.hint):
            node.kids = stack[-1].kids
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
    flush()
    return root


# --- wrappers -----------------------------------------------------------------------------------
# A wrapper is a dict: s(ignature), n pages, c(haracters), l(ink characters), a(part), h(int), k: items, each [wrapper, at least, at most].
# A text slot has s "#" and t: the text (or its digest) while it is always the same, or None. At most is 1 or 2 (many).

def _shown(text: str) -> str:
    return text if len(text) <= SHOWN else "\0" + hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def wrapper_of(node: Node) -> dict:
    """The wrapper of one page: its tokens with equal neighbours folded."""
    items, chars, links = [], 0, 0
    for kid in node.kids:
        if isinstance(kid, Node):
            inner = wrapper_of(kid)
        else:
            inner = {"s": "#", "t": _shown(kid[0]), "n": 1, "c": len(kid[0]), "l": kid[1]}
        chars, links = chars + inner["c"], links + inner["l"]
        items.append([inner, 1, 1])
    return {"s": node.sig, "n": 1, "c": chars, "l": links, "a": node.apart, "h": node.hint, "k": _bounded(items, 1)}


def _slot(kid: dict) -> str:
    """The signature of the slot for elements of the same tag whose classes and ids differ."""
    return f"{_tag(kid['s'])}*{'!' if kid['a'] else ''}{kid['h']}"


def _joined_slots(items: list, pages: int, width: int = WIDTH) -> list:
    """Tags with over ``width`` signatures keep those that most pages have; the others become one slot."""
    kinds: dict[str, dict[str, int]] = {}
    for kid, _, _ in items:
        if kid["s"] != "#":
            seen = kinds.setdefault(_slot(kid), {})
            seen[kid["s"]] = max(seen.get(kid["s"], 0), kid["n"])
    for slot, seen in kinds.items():
        if len(seen) > width:
            gone = {s for s, n in seen.items() if 2 * n <= pages}
            for kid, _, _ in items:
                if kid["s"] in gone:
                    kid["s"] = slot
    return items


def _grouped(items: list, pages: int) -> list:
    """A signature on over WIDTH places of a level makes one repeated group of all between its first and last."""
    while True:
        places: dict[str, list[int]] = {}
        for i, item in enumerate(items):
            places.setdefault(item[0]["s"], []).append(i)
        crowded = next((p for p in places.values() if len(p) > WIDTH), None)
        if crowded is None:
            return items
        group: dict[str, list] = {}
        for item in items[crowded[0]:crowded[-1] + 1]:
            known = group.setdefault(item[0]["s"], [None, 0, 2])
            known[0] = item[0] if known[0] is None else aligned(known[0], item[0], pages)
        items = items[:crowded[0]] + list(group.values()) + items[crowded[-1] + 1:]


def _bounded(items: list, pages: int) -> list:
    return _grouped(_folded(_joined_slots(items, pages), pages), pages)


def _folded(items: list, pages: int) -> list:
    """Runs of one, two or three elements that repeat become repeated groups."""
    for width in (1, 2, 3):
        out = []
        for item in items:
            out.append(item)
            if len(out) >= 2 * width and [i[0]["s"] for i in out[-2 * width:-width]] == [i[0]["s"] for i in out[-width:]] \
                    and (width == 1 or len({i[0]["s"] for i in out[-width:]}) == width):
                late = [out.pop() for _ in range(width)][::-1]
                for first, again in zip(out[-width:], late):
                    first[0], first[1], first[2] = aligned(first[0], again[0], pages), min(first[1], again[1]), 2
        items = out
    return items


def aligned(one: dict, two: dict, pages: int | None = None) -> dict:
    """The wrapper of both, which are of different pages or, of one level, of at most ``pages`` pages together."""
    n = one["n"] + two["n"] if pages is None else min(one["n"] + two["n"], pages)
    chars, links = one["c"] + two["c"], one["l"] + two["l"]
    if one["s"] == "#":
        return {"s": "#", "t": one["t"] if one["t"] == two["t"] else None, "n": n, "c": chars, "l": links}
    for mine, others in ((one["k"], two["k"]), (two["k"], one["k"])):
        # What the other side has only as part of its slot joins that slot here too.
        known = {kid["s"] for kid, _, _ in others}
        for kid, _, _ in mine:
            if kid["s"] != "#" and kid["s"] not in known and (slot := _slot(kid)) in known:
                kid["s"] = slot
    where: dict[str, list[int]] = {}
    for i, item in enumerate(two["k"]):
        where.setdefault(item[0]["s"], []).append(i)
    items, begin = [], 0
    for left in one["k"]:
        spots = where.get(left[0]["s"], [])
        spot = next((i for i in spots if i >= begin), None)
        if spot is None:
            items.append([left[0], 0, left[2]])
            continue
        items.extend([extra[0], 0, extra[2]] for extra in two["k"][begin:spot])
        right = two["k"][spot]
        items.append([aligned(left[0], right[0], None if pages is None else n), min(left[1], right[1]), max(left[2], right[2])])
        begin = spot + 1
    items.extend([extra[0], 0, extra[2]] for extra in two["k"][begin:])
    return {"s": one["s"], "n": n, "c": chars, "l": links, "a": one["a"], "h": one["h"], "k": _bounded(items, n)}


def expression(wrapper: dict) -> str:
    """The wrapper as text: a(b? c+ #)."""
    if wrapper["s"] == "#":
        return "#" if wrapper["t"] is None else "=" if wrapper["t"].startswith("\0") else json.dumps(wrapper["t"], ensure_ascii=False)
    marks = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}
    return f"{wrapper['s']}({' '.join(expression(k) + marks[low, high] for k, low, high in wrapper['k'])})"


# --- regions ------------------------------------------------------------------------------------

# A region is the part of a wrapper that a page is read by: a tree of dicts with kids by signature, "in" where the article
# begins, "open" where a hint is overruled, "drop" the template's own texts at this place, "not" what a slot does not stand for.

def _tag(signature: str) -> str:
    return re.split(r"[.#@*!]", signature, maxsplit=1)[0]


def _paths(wrapper: dict, tags: tuple[str, ...], path: tuple, hinted: bool) -> Iterator[tuple[tuple, bool]]:
    """Paths to the outermost elements of ``tags`` that are not apart, and whether a hint lies on them."""
    for kid, _, _ in wrapper.get("k", ()):
        if kid["s"] == "#" or kid["a"]:
            continue
        here, doubt = path + (kid,), hinted or bool(kid["h"])
        if _tag(kid["s"]) in tags or "main" in tags and "@main" in kid["s"]:
            yield here, doubt
        else:
            yield from _paths(kid, tags, here, doubt)


def _marked(region: dict, wrapper: dict, path: tuple) -> dict:
    """The region's place for ``path``, hints on it overruled."""
    above = wrapper
    for node in path:
        region = region.setdefault("kids", {}).setdefault(node["s"], {})
        if node["h"]:
            region["open"] = True
        if "*" in node["s"]:
            region["not"] = sorted({k["s"] for k, _, _ in above["k"] if k["s"] != "#" and _slot(k) == node["s"]} - {node["s"]})
        above = node
    return region


def _text(node: dict, hints: bool) -> int:
    """Characters outside links and parts that are apart; ``hints`` counts those in hinted parts (but comments) too."""
    own = node["c"] - node["l"]
    return own - sum(k["c"] - k["l"] if k.get("a") or k.get("h") and (k["h"] == "%" or not hints) else k["c"] - k["l"] - _text(k, hints)
                     for k, _, _ in node.get("k", ()) if k["s"] != "#")


def _overruled(node: dict) -> dict | None:
    """The hinted kid that holds most of the text, so that it cannot be beside the article."""
    whole = _text(node, True)
    return next((k for k, _, _ in node["k"] if k["s"] != "#" and not k["a"] and k["h"] == "?" and whole > 0 and _text(k, True) >= SHARE * whole), None)


def _open_inside(region: dict, wrapper: dict, path: tuple) -> None:
    """Overrules hints at or below the end of ``path`` on parts that hold most of what they stand in."""
    node = path[-1] if path else wrapper
    if kid := _overruled(node):
        _marked(region, wrapper, path + (kid,))
    for k, _, _ in node["k"]:
        if k["s"] != "#" and not k["a"] and (not k["h"] or k is kid):
            _open_inside(region, wrapper, path + (k,))


def _general(wrapper: dict) -> dict:
    """A copy in which all that most pages lack has joined its slot, and each slot of a level stands once."""
    items: list = []
    slots: dict[str, list] = {}
    for kid, low, high in _joined_slots([[dict(k), low, high] for k, low, high in wrapper["k"]], wrapper["n"], 1):
        known = slots.get(kid["s"])
        if known is None:
            items.append([kid, low, high])
            if "*" in kid["s"]:
                slots[kid["s"]] = items[-1]
        else:
            known[0] = aligned(known[0], kid)
            known[2] = max(known[2], high, 1 if known[0]["n"] <= wrapper["n"] else 2)
    return {**wrapper, "k": [[kid if kid["s"] == "#" else _general(kid), low, high] for kid, low, high in items]}


def region_of(wrapper: dict) -> dict:
    """Where a host keeps its articles: its article elements, else main, else the deepest element with most of
    the text outside links and apart elements, without the template's own texts there."""
    region: dict = {}
    if wrapper["n"] > 1:
        wrapper = _general(wrapper)
    for tags in (("article",), ("main",)):
        found = list(_paths(wrapper, tags, (), False))
        for path in [p for p, hinted in found if not hinted] or [p for p, _ in found]:
            _marked(region, wrapper, path)["in"] = True
            _open_inside(region, wrapper, path)
        if found:
            return region
    path, node = (), wrapper
    while True:
        best = _overruled(node)
        if best is None:
            inside = [k for k, _, _ in node["k"] if k["s"] != "#" and not k["a"] and not k["h"]]
            best = max(inside, key=lambda k: _text(k, False), default=None)
            if best is None or not best["k"] or _text(best, False) < SHARE * _text(node, False) or _tag(best["s"]) in HEADINGS or _tag(best["s"]) in ("p", "pre", "blockquote", "li"):
                break
        node = best
        path += (node,)
    _marked(region, wrapper, path)["in"] = True
    _open_inside(region, wrapper, path)
    slots = list(_slots(node, path, True))
    varying = [i for i, (_, slot, _) in enumerate(slots) if slot["t"] is None]
    if varying:
        for where, slot, single in slots[:varying[0]] + slots[varying[-1] + 1:]:
            if single and slot["n"] == wrapper["n"] > 1:
                place = _marked(region, wrapper, where)
                place["drop"] = sorted({*place.get("drop", ()), slot["t"]})
    return region


def _slots(node: dict, path: tuple, single: bool) -> Iterator[tuple[tuple, dict, bool]]:
    """Text slots in order, with their place and whether each stands once, outside headings and quotations."""
    for kid, _, most in node["k"]:
        alone = single and most == 1
        if kid["s"] == "#":
            yield path, kid, alone
        elif not (kid["a"] or kid["h"]):
            yield from _slots(kid, path + (kid,), alone and _tag(kid["s"]) not in HEADINGS and _tag(kid["s"]) != "blockquote")


def main_text(html: str, region: dict | None) -> str:
    """The blocks of the page's article, one per line."""
    root = parse(html)
    for where in (region, region_of(wrapper_of(root))):
        if where is None:
            continue
        out: list[str] = []
        _collect(root, where, bool(where.get("in")), out)
        if out:
            return "\n".join(out)
    return ""


def _collect(node: Node, region: dict | None, inside: bool, out: list) -> None:
    kids, drop = (region or {}).get("kids", {}), (region or {}).get("drop", ())
    for kid in node.kids:
        if not isinstance(kid, Node):
            if inside and not (drop and _shown(kid[0]) in drop):
                out.append(kid[0])
        elif not kid.apart:
            place = kids.get(kid.sig)
            if place is None and (place := kids.get(f"{kid.tag}*{kid.hint}")) and kid.sig in place["not"]:
                place = None
            if kid.hint and not (place and place.get("open")):
                continue
            if inside or place:
                _collect(kid, place, inside or bool(place.get("in")), out)


# --- on Spark -----------------------------------------------------------------------------------

HELD_HOSTS = 2000


def _host_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host and task, or a few where a task meets very many hosts."""
    held: dict[str, dict] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), strings(batch.column("html"))):
            own = wrapper_of(parse(html))
            held[host] = aligned(held[host], own) if host in held else own
            if len(held) >= HELD_HOSTS:
                yield out()
                held.clear()
    if held:
        yield out()


def _aligned_all(table: pa.Table) -> dict:
    wrappers = [json.loads(w) for w in sorted(table.column("wrapper").to_pylist())]
    wrapper = wrappers[0]
    for other in wrappers[1:]:
        wrapper = aligned(wrapper, other)
    return wrapper


def _partly_joined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(_aligned_all(table))], pa.string())})


def _joined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    wrapper = _aligned_all(table)
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "expression": pa.array([expression(wrapper)], pa.string()),
                     "region": pa.array([json.dumps(region_of(wrapper))], pa.string())})


#: Groups of tasks whose wrappers of a host meet first; their wrappers meet next.
BRANCHES = 256


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, expression, region) per host of ``pages`` (url, html).

    A level of a wrapper holds at most WIDTH items of a signature, and of a tag at most WIDTH signatures or those that
    most of its pages have, beside one slot per tag and kind; so wrappers do not grow with the number of pages.
    """
    hosts = pages.select(F.coalesce(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), F.lit("")).alias("host"), "html")
    own = hosts.mapInArrow(_host_wrappers, "host string, wrapper string").withColumn("branch", F.spark_partition_id() % BRANCHES)
    branches = own.groupBy("host", "branch").applyInArrow(_partly_joined, "host string, wrapper string")
    return branches.groupBy("host").applyInArrow(_joined, "host string, expression string, region string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``.

    Text is decoded, its white space single, one block a line; menus, headers, footers, sidebars, notices,
    adverts, forms, scripts and comments are left out. A class, id or role is a hint that wrapper statistics may
    overrule. On hosts without article or main elements, texts that stand at one place of all pages, before or
    after all that differs, belong to the template, but for headings and quotations. A null or empty page, and one
    without an article, gives an empty text; no pages give no rows. Pages whose url is null or has no host share a
    wrapper. A very long page is read whole by its task. Elements nested deeper than DEEPEST are read as part of
    the one above, those apart left out. Repeated rows are rows like any other; other columns are not read. A host
    in a third of all pages is one wrapper of bounded size per task, and its pages are spread by ``lookup_join``.
    """
    rows = pages.select("page_id", "url", "html")
    regions = stored(wrappers(rows), "wrappers").select("host", "region")

    def run(html: pa.Array, region: pa.Array) -> pa.Array:
        known: dict[str | None, dict | None] = {None: None}
        out = []
        for page, where in zip(strings(html), region.to_pylist()):
            if where not in known:
                known[where] = json.loads(where)
            out.append(main_text(page, known[where]))
        return pa.array(out, pa.string())

    placed = rows.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), F.lit("")))
    placed = lookup_join(placed, regions, ["host"], stored=True)
    texts = placed.select("page_id", "url", text_udf(run, "string")(F.col("html"), F.col("region")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
