"""Operator 8, main text of web pages by inferred wrappers.

Pages of one host share a template. Some pages of each host are aligned, one after the other, into a wrapper: a union-free
regular expression over tags and text slots. A page is a sequence of tags and texts inside each element; runs that occur again next to each other, of
one element or of several in turn, are folded into a repeated group. Two sequences are aligned in order; what only one of them has, at a
mismatch, becomes optional, and texts at the same place become one slot. Every page is then read through its host's wrapper:

1. scripts, menus, forms, footers and other elements that never hold main text are left out by their name, and elements that a whole
   class name sets apart (``ad``, ``page-footer``, not ``has-sidebar``): adverts, notices, menus and reader comments inside an article too.
   A class never sets apart an article (but a reader's) or a main element, and a layout word (``banner``) not what holds the page's only one;
2. on pages with an article or main element, text outside it isn't main text;
3. the template's own slots are left out: few texts fill such a slot on most of the host's pages of different content. Repetition alone is
   not enough. Headings of an article stay, and so does what stands in its running text (paragraphs, lists, tables right in it); and
   an element of such slots is only the template's if the texts that differ from page to page, headings aside, hold more than it does. So a report
   that many pages carry is main text on all of them.

Wrappers come from all pages of a host; pages of equal content count once. Every structure that occurs (tags, folded) is merged into the host's expression,
in 64 parts and then as one; then every page is read through it, and what texts stand in which slot is counted page by page. Tasks hand on sums by slot, with at most
``ROTATING`` texts each, so a host of any size is bounded. Neighbours that no order of at most ``LONG`` terms holds are merged by what they are. Only wrappers with slots of
the template's own are handed to the tasks that read pages; where a host has none, its wrapper leaves nothing out.

Tags are taken as nested; stray, missing and crossed end tags are put right as browsers do, roughly.

Defined cases: a null or empty page has empty text; a null url counts as a host of its own; null ids and
repeated rows each give their own row; ties between pages of equal content change nothing; pages of any length and depth are read
whole (under ``DEEP`` levels, or among ``LONG`` neighbours that don't repeat, texts have no slot and stay); an empty table gives an empty
table; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import columns as C
from tessera.session import Scratch

#: Pages at which the two bounds that follow are the same.
SAMPLE = 16
#: The template's own slots have each of their texts on so many of a host's pages, on average, and on this share of them,
CONSTANT_PAGES = 4
CONSTANT_SHARE = CONSTANT_PAGES / SAMPLE
#: hold at most so many different texts,
ROTATING = 8
#: and stand on at least this share of them.
HOST_SHARE = 0.5
#: Structures, or slots' sums, that a task holds before it hands them on.
HANDED_ON = 1024
#: Outlines of which a task remembers what their texts are to the wrapper.
REMEMBERED = 4096
#: Bytes of wrappers that are sent to all tasks; beyond that they are joined by a shuffle.
SENT_BYTES = 16 << 20
#: Neighbours that a repeated group may have; levels of a page that are aligned; neighbours that are aligned without being folded.
GROUP, DEEP, LONG = 8, 100, 512
STEP_BYTES = 4 << 20

# HTML's void elements, raw-text elements, inline elements, and elements that end an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ENDS_P = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table html body article section div main td th blockquote".split())
# What isn't main text, by element and by the words of class, id and role.
APART = set("nav footer aside form script style head template noscript button select textarea dialog menu iframe svg canvas object audio video search fieldset title".split())
APART_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar toolbar footer "
    "sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments respond reply replies disqus "
    "discussion share sharing social related recommended widget pagination pager search skip complementary contentinfo dialog".split()
)
#: Words that a class made of the words above may have besides; with any other word (has-sidebar, category-ad) it says something else.
PLAIN_WORDS = set("site page post global top bottom left right inner outer main primary secondary section area list box block wrap wrapper container content bar item items link links button buttons posts articles stories news reads card cards".split())
MAIN = {"article", "main"}
#: Layout words: an element of such a class isn't apart if it holds the page's only main element.
LAYOUT = set("banner header masthead topbar toolbar overlay modal popup dialog widget search skip share".split())
READERS = {"comment", "comments", "respond", "reply", "replies", "disqus", "discussion"}
#: Running text; inside an article it doesn't go by a layout word.
RUNNING = {"p", "blockquote", "pre", "table", "ul", "ol", "dl"}
#: What running text is made of.
IN_RUNNING = RUNNING | set("li dt dd tr td th tbody thead tfoot caption".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|([^<]+|<)", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@dataclass
class Node:
    """An element; children are nodes and texts (as lists of parts). ``sign`` is what alignment compares."""

    name: str
    sign: str
    apart: bool
    children: list = field(default_factory=list)
    main: bool = False
    layout: bool = False  # apart by layout words only


def says_apart(name: str) -> bool:
    """Whether a whole class, id or role names something that isn't main text."""
    words = {w for w in re.split(r"[^a-z]+", name) if w}
    return not words.isdisjoint(APART_WORDS) and words <= APART_WORDS | PLAIN_WORDS


def element(name: str, attributes: str) -> Node:
    names: list[str] = []
    classes: list[str] = []
    role_main = False
    if attributes and "=" in attributes:
        for kind, a, b, c in ATTRIBUTE.findall(attributes):
            found = (a or b or c).lower().split()
            role_main |= kind.lower() == "role" and "main" in found
            names += filter(says_apart, found)
            if kind.lower() == "class":
                classes += [x for x in found if not any(map(str.isdigit, x))]  # numbered ones are made for a page
    words = {w for n in names for w in re.split(r"[^a-z]+", n)} & APART_WORDS
    main = name in MAIN or role_main
    # A main element is never apart by its class, nor an article but for the readers' own (comments, replies).
    if role_main or name == "main" or name == "article" and not words <= READERS:
        words = set()
    if name == "header":
        words.discard("header")
    apart = name in APART or (name not in {"html", "body"} | HEADINGS and bool(words))
    return Node(name, ".".join([name, *sorted({*words, *classes})]), apart, main=main, layout=apart and name not in APART and words <= LAYOUT)


def holds_main(root: Node) -> None:
    """Elements with a layout class are not apart if all the page's main elements are in such ones."""
    todo, held, free = [(root, ())], [], False
    while todo:
        n, over = todo.pop()  # over: the layout elements that n is in, the innermost first
        if n.apart and not n.layout:
            continue
        if n.apart:
            over = (n, over)
        elif n.main:
            free |= not over
            held.append(over)
        todo += [(c, over) for c in n.children if isinstance(c, Node)]
    for over in [] if free else held:
        while over:
            over[0].apart, over = False, over[1]


def parse(page: str) -> Node:
    """The page's blocks as a tree; plain inline tags are transparent."""
    root = Node("#root", "#root", False)
    stack, open_names = [root], Counter()
    at = 0

    def text(s: str) -> None:
        kids = stack[-1].children
        if kids and isinstance(kids[-1], list):
            kids[-1].append(s)
        else:
            kids.append([s])

    def close(i: int) -> None:
        for n in stack[i:]:
            open_names[n.name] -= 1
        del stack[i:]

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if m[7] is not None:
            text(m[7])
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if open_names[name] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        close(i)
                        break
                    if name in INLINE and stack[i].name not in INLINE:
                        break
            continue
        attributes = m[3] or m[6] or ""
        if name in ("br", "wbr", "img", "hr"):
            text(" " if name != "wbr" else "")
        if name in VOID:
            continue
        node = element(name, attributes)
        if name in INLINE and not node.apart:
            continue
        if name in ENDS_P and open_names["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in SCOPES:
                    break
        ended = SIBLING_ENDS.get(name, ())
        if any(open_names[x] > 0 for x in ended):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ended:
                    close(i)
                    break
                if stack[i].name in SCOPES and not (name == "tr" and stack[i].name in ("td", "th")):
                    break
        if name in ("td", "th"):
            text(" ")
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            body, at = (page[at : end.start()], end.end()) if end else (page[at:], len(page))
            node.children.append([body])
            stack[-1].children.append(node)
            continue
        stack[-1].children.append(node)
        if not attributes.endswith("/"):
            stack.append(node)
            open_names[name] += 1
    holds_main(root)
    return root


def words_of(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


TEXT = "#text"


@dataclass
class Block:
    """A text of a page: its node, and whether it is main text, and stays whatever the template, as far as the page alone can tell."""

    node: list
    text: str
    main: bool
    stays: bool
    heading: bool


def has_main(root: Node) -> bool:
    todo = [root]
    while todo:
        n = todo.pop()
        if n.main and not n.apart:
            return True
        todo += [c for c in n.children if isinstance(c, Node) and not c.apart]
    return False


def blocks(root: Node) -> list[Block]:
    """All texts of a page that aren't left out by an element's name, in page order."""
    only_main = has_main(root)
    out: list[Block] = []
    # (node, inside an article, set apart by a class, in a heading, right in the article's running text), the next one last
    todo: list[tuple] = [(root, False, False, False, False)]
    while todo:
        node, inside, apart, heading, running = todo.pop()
        if isinstance(node, list):
            shown = words_of(node)
            if shown:
                out.append(Block(node, shown, not apart and (inside or not only_main), inside and (heading or running), heading))
            continue
        further = []
        for child in node.children:
            if isinstance(child, list):
                further.append((child, inside, apart, heading, running))
                continue
            by_class = child.apart and child.name not in APART
            if child.apart and not by_class or child.name == "header" and not inside:
                continue
            if by_class and child.layout and inside and child.name in RUNNING:
                by_class = False
            main = child.main and not child.apart
            further.append((child, inside or main, apart or by_class, heading or child.name in HEADINGS, main or running and child.name in IN_RUNNING))
        todo += further[::-1]
    return out


def content_of(found: list[Block]) -> int:
    """A number for what a page says, the same for pages that only differ around it."""
    return xxhash.xxh64_intdigest("\n".join(b.text for b in found if b.main)) - (1 << 63)


@dataclass(eq=False)
class Term:
    """One term of a wrapper: a text slot, an element with terms inside, or a group of neighbours that occurs again (``sign`` "()").

    ``texts`` counts the pages that each of a slot's texts stands on, by the texts' hashes, None for more than ``ROTATING`` texts; ``on`` the slot's pages.
    """

    sign: str
    inside: list[Term] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    texts: dict[int, int] | None = None
    on: int = 0
    chars: int = 0  # of texts that may be the template's or the body's
    stays: bool = False
    heading: bool = False
    blocks: list[int] = field(default_factory=list)  # of the page that is being read
    own: bool = False  # the template's
    number: int = -1

    @property
    def key(self):
        return tuple(t.key for t in self.inside) if self.sign == "()" else self.sign


def outline(root: Node, found: list[Block]) -> list:
    """A page as nested lists: an element is its sign and what is inside, a text the number of its block, main texts only."""
    number = {id(b.node): i for i, b in enumerate(found) if b.main}
    out: list = []
    todo = [(root, out, 0)]
    while todo:
        node, into, depth = todo.pop()
        for child in node.children:
            if isinstance(child, list):
                if id(child) in number:
                    into.append(number[id(child)])
                continue
            if child.apart and child.name in APART or depth > DEEP:
                continue
            held: list = []
            into.append([child.sign, held])
            todo.append((child, held, depth + 1))
    return out


def terms_of(items: list) -> list[Term]:
    """An outline as terms, folded."""
    return folded([Term(TEXT, blocks=[x]) if isinstance(x, int) else Term(x[0], terms_of(x[1])) for x in items])


def skeleton(terms: list[Term]) -> list:
    """Terms without texts, as nested lists."""
    return [[t.sign, skeleton(t.inside), 2 * t.optional + t.repeated] for t in terms]


def from_skeleton(items: list) -> list[Term]:
    return [Term(sign, from_skeleton(inside), optional=marks > 1, repeated=marks % 2 > 0) for sign, inside, marks in items]


def joined(a: Term, b: Term) -> Term:
    """One term for two with the same key; ``a`` takes it all."""
    a.optional |= b.optional
    a.repeated |= b.repeated
    if a.sign == TEXT:
        a.blocks += b.blocks
    elif a.sign == "()":
        a.inside = [joined(x, y) for x, y in zip(a.inside, b.inside, strict=True)]
    else:
        a.inside = merged(a.inside, b.inside)
    return a


def gathered(runs: list[list[Term]]) -> Term:
    """A repeated term for runs of neighbours with the same keys."""
    first = runs[0][0] if len(runs[0]) == 1 else Term("()", runs[0])
    for run in runs[1:]:
        first = joined(first, run[0] if len(run) == 1 else Term("()", run))
    first.repeated = True
    return first


def folded(terms: list[Term]) -> list[Term]:
    """Neighbours that occur again next to each other as one repeated term: first single ones, then longer and longer groups."""
    for width in range(1, GROUP + 1):
        if len(terms) < 2 * width:
            break
        keys, out, at = [t.key for t in terms], [], 0
        while at < len(terms):
            to = at + width
            while keys[to : to + width] == keys[at : at + width] and to + width <= len(terms):
                to += width
            if to > at + width:
                out.append(gathered([terms[i : i + width] for i in range(at, to, width)]))
                at = to
            else:
                out.append(terms[at])
                at += 1
        terms = out
    return terms


def folded_as(terms: list[Term], groups: list[Term]) -> list[Term]:
    """``terms`` with each run that is one of the groups as that group, even where it occurs once."""
    for group in groups:
        width, wanted = len(group.inside), list(group.key)
        keys, out, at = [t.key for t in terms], [], 0
        while at < len(terms):
            if keys[at : at + width] == wanted:
                out.append(Term("()", terms[at : at + width]))
                at += width
            else:
                out.append(terms[at])
                at += 1
        terms = out
    return folded(terms) if groups else terms


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """Places of two sequences of keys that are aligned, in order."""
    n, start = min(len(a), len(b)), 0
    while start < n and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = [(i, i) for i in range(start)]
    middle = a[start : len(a) - end], b[start : len(b) - end]
    if max(map(len, middle)) <= LONG:
        for i, j, size in SequenceMatcher(None, *middle, autojunk=False).get_matching_blocks():
            out += [(start + i + k, start + j + k) for k in range(size)]
    return out + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def sides(a: list[Term], b: list[Term]) -> tuple[list[Term], list[Term]]:
    """Both sequences with each other's groups."""
    of = lambda terms: [t for t in terms if t.sign == "()"]
    return folded_as(a, of(b)), folded_as(b, of(a))


def merged(a: list[Term], b: list[Term]) -> list[Term]:
    """One sequence of terms that matches what either does: mismatches become optional."""
    a, b = sides(a, b)
    out, i, j = [], 0, 0
    for x, y in [*matched([t.key for t in a], [t.key for t in b]), (len(a), len(b))]:
        for t in [*a[i:x], *b[j:y]]:
            t.optional = True
            out.append(t)
        if x < len(a):
            out.append(joined(a[x], b[y]))
        i, j = x + 1, y + 1
    return out if len(out) <= LONG else by_kind(out)


def by_kind(terms: list[Term]) -> list[Term]:
    """One optional term for all with the same key."""
    out: dict = {}
    for t in terms:
        if t.key in out:
            joined(out[t.key], t).repeated = True
        else:
            out[t.key] = t
        out[t.key].optional = True
    return [*out.values()]


def read_through(wrapper: list[Term], page: list[Term]) -> Iterator[tuple[Term, list[int]]]:
    """The slots that a page's texts stand in, with the texts' blocks."""
    todo = [(wrapper, page)]
    while todo:
        a, b = todo.pop()
        a, b = sides(a, b)
        for x, y in matched([t.key for t in a], [t.key for t in b]):
            one, two = a[x], b[y]
            pairs = zip(one.inside, two.inside, strict=True) if one.sign == "()" else [(one, two)]
            for s, t in pairs:
                if s.sign == "()":
                    todo.append(([s], [t]))
                elif s.sign == TEXT:
                    yield s, t.blocks
                else:
                    todo.append((s.inside, t.inside))


def slots(terms: list[Term]) -> Iterator[Term]:
    todo = [*terms]
    while todo:
        t = todo.pop()
        todo += t.inside
        if t.sign == TEXT:
            yield t


def constant_parts(terms: list[Term], few: set[Term]) -> tuple[list[list[Term]], bool]:
    """The largest terms all of whose slots are in ``few``, as their slots; whether that is all there is."""
    parts, whole = [], True
    for t in terms:
        if t.sign == TEXT:
            whole &= t in few
            parts += [[t]] if t in few else []
        else:
            inner, all_few = constant_parts(t.inside, few)
            whole &= all_few
            parts += [sum(inner, [])] if all_few and inner else inner
    return parts, whole


def template(wrapper: list[Term], n: int, constant_pages: int, body: int = 0) -> bool:
    """Mark the template's own slots of a wrapper of ``n`` pages; whether there are any. ``body`` is what stands in no slot."""
    few: set[Term] = set()
    for slot in slots(wrapper):
        least = max(constant_pages, CONSTANT_SHARE * n) * len(slot.texts or ())
        if slot.texts is not None and slot.on >= max(least, HOST_SHARE * n, 1):
            few |= set() if slot.stays else {slot}
        elif not slot.heading:
            body += slot.chars
    for part in constant_parts(wrapper, few)[0]:
        for slot in part if sum(x.chars for x in part) < body else []:
            slot.own = True
    return any(slot.own for slot in few)


def expression(terms: list[Term]) -> str:
    """The wrapper as a union-free regular expression."""

    def one(t: Term) -> str:
        inner = ("#OWN" if t.own else "#PCDATA") if t.sign == TEXT else expression(t.inside)
        shown = inner if t.sign in (TEXT, "()") else f"<{t.sign}>{inner}</>"
        mark = {(True, True): "*", (True, False): "?", (False, True): "+", (False, False): ""}[t.optional, t.repeated]
        return f"({shown}){mark}" if mark else shown

    return " ".join(map(one, terms))


def outlined(page: str) -> tuple[int, str, list[Block]]:
    """A page's content, its outline with hashes and lengths of its texts, and its blocks."""
    root = parse(page)
    found = blocks(root)
    texts = [(xxhash.xxh64_intdigest(b.text) - (1 << 63), len(b.text), b.stays, b.heading) for b in found]
    return content_of(found), json.dumps([outline(root, found), texts], separators=(",", ":")), found


def shown(items: list) -> str:
    return json.dumps(items, separators=(",", ":"))


def structure(skeletons: list[str]) -> str:
    """One expression for all of a host's structures."""
    wrapper: list[Term] | None = None
    for text in sorted(skeletons):
        terms = from_skeleton(json.loads(text))
        wrapper = terms if wrapper is None else merged(wrapper, terms)
    return shown(skeleton(wrapper or []))


def numbered(expression: str) -> list[Term]:
    wrapper = from_skeleton(json.loads(expression))
    for i, slot in enumerate(slots(wrapper)):
        slot.number = i
    return wrapper


class Sums:
    """What stands in each slot of each host's wrapper: ``(host, slot)`` to a count of pages, by text and in all, characters, and marks.

    Slot -1 is for texts in no slot, -2 for the page itself.
    """

    def __init__(self):
        self.held: dict[tuple, list] = {}
        self.known: dict[tuple, dict[int, int]] = {}

    def slots_of(self, host: str, expression: str, items: list) -> dict[int, int]:
        """The slot of each block; the same for all pages with an outline."""
        key = host, shown(items)
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = {b: s.number for s, found in read_through(numbered(expression), terms_of(items)) for b in found}
        return self.known[key]

    def page(self, host: str, expression: str, text: str) -> None:
        items, texts = json.loads(text)
        where, on = self.slots_of(host, expression, items), {-2: {}}
        main = {i for i in numbers(items)}
        for i, (number, chars, stays, heading) in enumerate(texts):
            if i in main:
                slot = where.get(i, -1)
                own = on.setdefault(slot, {})
                own[number] = 1
                sums = self.held.setdefault((host, slot), [{}, 0, 0, False, False])
                sums[2:] = sums[2] + chars * (slot >= 0 or not heading), sums[3] | stays, sums[4] | heading
        for slot, own in on.items():
            self.add(host, slot, own if slot >= 0 else None, 1, 0, False, False)

    def add(self, host: str, slot: int, texts: dict[int, int] | None, on: int, chars: int, stays: bool, heading: bool) -> None:
        sums = self.held.setdefault((host, slot), [{}, 0, 0, False, False])
        if texts is None or sums[0] is None:
            sums[0] = None
        else:
            for number, n in texts.items():
                sums[0][number] = sums[0].get(number, 0) + n
            if len(sums[0]) > ROTATING:
                sums[0] = None
        sums[1:] = sums[1] + on, sums[2] + chars, sums[3] | stays, sums[4] | heading

    def decided(self, host: str, expression: str, constant_pages: int) -> list[Term]:
        """The host's wrapper with the template's own slots marked."""
        wrapper = numbered(expression)
        for slot in slots(wrapper):
            slot.texts, slot.on, slot.chars, slot.stays, slot.heading = self.held.get((host, slot.number), (None, 0, 0, False, False))
        of = lambda slot: self.held.get((host, slot), (None, 0, 0))
        template(wrapper, of(-2)[1], constant_pages, of(-1)[2])
        return wrapper


def numbers(items: list) -> Iterator[int]:
    """The blocks of an outline."""
    todo = [*items]
    while todo:
        x = todo.pop()
        if isinstance(x, int):
            yield x
        else:
            todo += x[1]


def infer(outlines: list[str], constant_pages: int = CONSTANT_PAGES) -> list[Term]:
    """The wrapper of all pages of one host, from their outlines."""
    expression = structure([*{shown(skeleton(terms_of(json.loads(text)[0]))) for text in outlines}])
    sums = Sums()
    for text in outlines:
        sums.page("", expression, text)
    return sums.decided("", expression, constant_pages)


def packed(terms: list[Term]) -> list:
    """What reading needs of a wrapper, as nested lists."""
    return [int(t.own) if t.sign == TEXT else [t.sign, packed(t.inside)] for t in terms]


def unpacked(items: list) -> list[Term]:
    return [Term(TEXT, own=bool(x)) if isinstance(x, int) else Term(x[0], unpacked(x[1])) for x in items]


def host_outlines(rows: DataFrame) -> DataFrame:
    """``(host, content, outline)`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [outlined(page)[:2] for page in C.filled(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["host", "content", "outline"])

    return rows.select("host", "html").mapInArrow(run, "host string, content long, outline string")


def structures(outlines: DataFrame) -> DataFrame:
    """``(host, expression)`` of all structures that occur on a host."""
    most_held = HANDED_ON

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[str, str]] = set()
        known: dict[str, str] = {}

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.string()) for i in (0, 1)], names=["host", "skeleton"])
            held.clear()
            return out

        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items = json.loads(text)[0]
                key = shown(items)
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = shown(skeleton(terms_of(items)))
                held.add((host, known[key]))
                if len(held) >= most_held:
                    yield handed_on()
        yield handed_on()

    def one(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = structure([x for b in batches for x in b.column("skeleton").to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([text], pa.string())], names=["host", "skeleton"])

    found = outlines.select("host", "outline").mapInArrow(seen, "host string, skeleton string").distinct()
    found = found.groupBy("host", F.pmod(F.xxhash64("skeleton"), F.lit(64)).alias("part")).applyInArrow(one, "host string, skeleton string")
    return found.groupBy("host").applyInArrow(one, "host string, skeleton string").withColumnRenamed("skeleton", "expression")


def handed(rows: DataFrame, known: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """``rows`` with their hosts' ``name`` (null for those that are broadcast), and the broadcast, which is empty if it were too large."""
    size = known.agg(F.sum(F.octet_length(name) + F.octet_length("host"))).first()[0] or 0
    sent = rows.sparkSession.sparkContext.broadcast(dict(known.select("host", name).collect()) if size <= SENT_BYTES else {})
    return (rows.join(known, "host", "left") if size > SENT_BYTES else rows.withColumn(name, F.lit(None).cast("string"))), sent


def wrappers(rows: DataFrame) -> DataFrame:
    """``(host, wrapper)`` of hosts whose template has slots of its own."""
    scratch = Scratch(rows.sparkSession, "html-outlines")
    outlines = scratch.table(host_outlines(rows).groupBy("host", "content").agg(F.min("outline").alias("outline")))
    known = scratch.table(structures(outlines))
    pages, sent = handed(outlines.select("host", "outline"), known, "expression")
    most_held, constant_pages = HANDED_ON, CONSTANT_PAGES
    kinds = [("host", pa.string()), ("slot", pa.int64()), ("texts", pa.string()), ("n_on", pa.int64()), ("chars", pa.int64()), ("stays", pa.bool_()), ("heading", pa.bool_())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()

        def handed_on() -> pa.RecordBatch:
            flat = [(*key, None if x[0] is None else json.dumps(list(x[0].items())), *x[1:]) for key, x in sums.held.items()]
            sums.held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

        for batch in batches:
            for host, text, expression in zip(*(batch.column(c).to_pylist() for c in ("host", "outline", "expression"))):
                sums.page(host, expression or sent.value[host], text)
                if len(sums.held) >= most_held:
                    yield handed_on()
        yield handed_on()

    def decide(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, host, expression = Sums(), key[0].as_py(), "[]"
        for batch in batches:
            for r in batch.to_pylist():
                if r["slot"] == -3:
                    expression = r["texts"]
                else:
                    sums.add(host, r["slot"], None if r["texts"] is None else dict(map(tuple, json.loads(r["texts"]))), r["n_on"], r["chars"], r["stays"], r["heading"])
        wrapper = sums.decided(host, expression, constant_pages)
        found = [(host, shown(packed(wrapper)))] if any(s.own for s in slots(wrapper)) else []
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["host", "wrapper"])

    schema = "host string, slot long, texts string, n_on long, chars long, stays boolean, heading boolean"
    counted = pages.select("host", "outline", "expression").mapInArrow(count, schema)
    both = counted.unionByName(known.select("host", F.lit(-3).cast("long").alias("slot"), F.col("expression").alias("texts")), allowMissingColumns=True)
    return both.groupBy("host").applyInArrow(decide, "host string, wrapper string")


def main_text(page: str, wrapper: list[Term] | None) -> str:
    """The main text of one page, read through its host's wrapper if that leaves anything out."""
    root = parse(page)
    found = blocks(root)
    gone: set[int] = set()
    if wrapper is not None:
        gone = {i for slot, there in read_through(wrapper, terms_of(outline(root, found))) if slot.own for i in there if not found[i].stays}
    return "\n\n".join(b.text for i, b in enumerate(found) if b.main and i not in gone)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)`` of every page."""
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), host_of(pages[url_col]).alias("host"), pages[html_col].cast("string").alias("html"))
    scratch = Scratch(spark, "html")
    known = scratch.table(wrappers(rows))
    size = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    sent = spark.sparkContext.broadcast(dict(known.collect()) if size <= SENT_BYTES else {})
    joined_in = size > SENT_BYTES
    if joined_in:
        rows = rows.join(known, "host", "left").select("page_id", "url", "host", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = sent.value
        for batch in batches:
            texts = []
            packs = batch.column(4).to_pylist() if joined_in else [by_host.get(h) for h in batch.column(2).to_pylist()]
            for page, pack in zip(C.filled(batch.column(3)).to_pylist(), packs):
                # Reading folds a wrapper as the page asks, so each page gets one of its own.
                texts.append(main_text(page, unpacked(json.loads(pack)) if pack else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_texts(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
