"""Main text of web pages by wrapper induction.

A page becomes a tree of block elements, in which runs of siblings of the same
shape count as one node. For each host, the trees of all its pages are aligned
by simple tree matching and merged into a wrapper, whose nodes are slots. All
distinct pages of the host are then counted at the slots they fall to: a slot
on ``TEMPLATE_PAGES`` pages or more that says the same on ``TEMPLATE_SHARE`` of
them or more is template; the others vary. The wrapper names the content: its
article or main elements, if they hold a fair share of what varies
(``NAMED_SHARE``; an article that is the same everywhere is none), else the
innermost node with most of the varying text. Each page's tree is then aligned
with its host's wrapper, and what falls to the content is kept, but for

* elements that are menus, headers, footers, sidebars, notices, adverts, forms,
  scripts, styles or reader comments by their tag, role, class or id;
* boxes (``div`` and ``section``) that are template, and template of any kind
  whose class might be a mark of boilerplate, such as ``ad-hoc`` or ``side-effects``,
  on pages where they say what the template says. Where such a class stands on a
  varying slot, it marks nothing.

Headings, paragraphs, lists, tables and quotations of the content stay, even
where all pages share them: the article is wanted whole. If most of the content
is the same on the host's pages, they are copies of each other, and no box is
dropped for it.

Children are matched by dynamic programming over those with equal labels; where
two lists of children differ by more than ``MATCH_CELLS`` pairs, equal subtrees
are matched first, and what is between them in order. All walks are loops, so
pages may be of any depth.

A box goes by its classes and ids if one in twenty of the host's pages
(``LABEL_SHARE``) has a box with the same, else by its tag alone, and so do
elements that HTML doesn't know; so a host of very many pages has few labels,
and its wrapper doesn't grow with names that each page has for itself.

Nothing is sampled. A host's distinct trees are merged ``FAN`` or so at a time, in
rounds, and what its pages say is counted by slot and text as rows, so no task
holds all pages or trees of a host, but only its wrapper. The result doesn't depend on how rows lie: trees are dealt out and put in order
by their hash. Wrappers are broadcast if their measured size is under
``BROADCAST_BYTES``; else they are joined by host, and large hosts are dealt out.

Defined cases: a null or blank html has an empty text; a null url belongs to the
host ''; pages without a wrapper or which don't fit theirs are taken by the same
rules on their own tree; repeated rows are each extracted; an empty table gives an
empty result; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html as references
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import arrow_batches, join_spread, materialise, ship

#: About how many trees of a host are merged in one group.
FAN = 64
#: Pages that a slot needs to be template, and the part of them on which it says the same.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.9
#: Part of a host's pages that must have a label for it to be told from others of its element.
LABEL_SHARE = 0.05
BROADCAST_BYTES = 32 << 20
#: Part of the varying text that named elements need, and that an inner node needs to be gone into.
NAMED_SHARE, INNER_SHARE = 0.2, 0.8
MATCH_CELLS = 40_000

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
BOILER_TAGS = set("aside button dialog footer form head header menu nav select input label".split()) | RAW
BOILER_ROLES = set("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
# Words in classes and ids that mark what isn't main text.
BOILER_WORDS = set(
    "advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer "
    "sidebar related recommended share sharing social cookie cookies consent gdpr popup modal newsletter subscribe subscription "
    "signup login comment comments commentlist replies respond disqus pagination pager copyright".split()
)
# Words that mark it only where nothing else but such words and those of layout stand in the name.
WEAK_WORDS = set("ad ads banner header promotion side aside widget widgets notice notices alert alerts overlay search form reply skip".split())
LAYOUT_WORDS = set("area bar block bottom box col column container first global group holder inner item last left line list outer page panel right section site slot small space text top unit wrap wrapper zone".split())
# Words that say that a page has or lacks something, which is elsewhere.
STATE_WORDS = set("has with no without is not".split())
BOXES = {"div", "section"}
KNOWN = VOID | RAW | INLINE | CLOSES_P | BOILER_TAGS | {*SIBLINGS} | set("audio canvas caption colgroup html legend map meter optgroup output picture progress ruby search slot summary video".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^<]*\Z""", re.S)
_ATTR = re.compile(r"""(?:^|[\s/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "boiler", "weak", "mark", "parts")

    def __init__(self, tag: str, boiler: bool, weak: bool, mark: str):
        self.tag, self.boiler, self.weak, self.mark, self.parts = tag, boiler, weak, mark, []


@lru_cache(maxsize=4096)
def _words_of(attrs: str) -> tuple[bool, bool, str]:
    """Whether attributes mark boilerplate, whether they might, and a label of class, id and role."""
    boiler, weak, label = False, False, []
    for name, *values in _ATTR.findall(attrs):
        for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(values)).lower().split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            label += words
            if name.lower() == "role":
                boiler = boiler or token in BOILER_ROLES
            elif words and words[0] not in STATE_WORDS:
                said = {*words}
                boiler = boiler or bool(BOILER_WORDS & said) or (bool(WEAK_WORDS & said) and said <= WEAK_WORDS | LAYOUT_WORDS)
                weak = weak or bool(WEAK_WORDS & said)
    return boiler, weak and not boiler, " ".join(label)


def parse(text: str) -> Node:
    """The tree of block elements; text parts stand among child nodes."""
    root = Node("html", False, False, "")
    stack = [root]
    where: dict[str, list[int]] = defaultdict(list)  # places of open elements in stack, by tag
    at = 0

    def put(s: str) -> None:
        if s:
            stack[-1].parts.append(s)

    def cut(k: int) -> None:
        while len(stack) > k:
            where[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=0)

    for m in _TAG.finditer(text):
        if m.start() < at:
            continue
        put(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "br":
                put(" ")
            continue
        if tag in ("html", "body"):
            continue
        if closing:
            if where[tag]:
                cut(where[tag][-1])
            continue
        if tag in CLOSES_P and where["p"] and where["p"][-1] > last(("button", "table", "td", "th")):
            cut(where["p"][-1])
        if tag in SIBLINGS:
            scope = last(SCOPES[tag])
            open_ones = [w[k] for t in SIBLINGS[tag] if (w := where[t]) and (k := bisect_right(w, scope)) < len(w)]
            if open_ones:
                cut(min(open_ones))
        boiler, weak, label = _words_of(m[3]) if m[3] else (False, False, "")
        node = Node(tag, boiler or tag in BOILER_TAGS, weak, label)
        stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            at = _ENDS[tag].search(text, at).end()
            continue
        where[tag].append(len(stack))
        stack.append(node)
    put(text[at:])
    return root


def blocks(node: Node, kept=None) -> list[str]:
    """The node's blocks of text in order; ``kept`` says whether a child node is gone into."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        s = " ".join(references.unescape("".join(run)).split())
        if s:
            out.append(s)
        run.clear()

    open_parts = [iter(node.parts)]
    while open_parts:
        for p in open_parts[-1]:
            if isinstance(p, str):
                run.append(p)
            else:
                flush()
                if kept is None or kept(p):
                    open_parts.append(iter(p.parts))
                    break
        else:
            flush()
            open_parts.pop()
    return out


def _none(_: Node) -> bool:
    return False


class Shape:
    """A node of a page's tree with runs of equal siblings made one.

    ``key`` numbers the subtrees' shapes: equal numbers, equal shapes."""

    __slots__ = ("label", "tag", "boiler", "weak", "children", "members", "key", "size", "_text")

    def __init__(self, node: Node):
        self.tag, self.boiler, self.weak, self.members, self.children, self._text = node.tag, node.boiler, node.weak, [node], [], None
        self.label = f"{node.tag} {node.mark}".strip() if node.tag in BOXES else f"{node.tag}{'!' * node.boiler}"

    @classmethod
    def of(cls, page: Node, keys: dict) -> Shape:
        root = cls(page)
        order, todo = [], [root]
        while todo:
            s = todo.pop()
            order.append(s)
            s.children = [cls(p) for p in s.members[0].parts if isinstance(p, Node)]
            todo += s.children
        for s in reversed(order):
            runs: list[Shape] = []
            for c in s.children:
                if runs and runs[-1].key == c.key:
                    runs[-1].absorb(c)
                else:
                    runs.append(c)
            s.children = runs
            s.size = 1 + sum(c.size for c in runs)
            s.key = keys.setdefault((s.label, tuple(c.key for c in runs)), len(keys))
        return root

    def absorb(self, other: Shape) -> None:
        todo = [(self, other)]
        while todo:
            mine, its = todo.pop()
            mine.members += its.members
            todo += zip(mine.children, its.children, strict=True)

    def text(self) -> str:
        """What stands directly in the node."""
        if self._text is None:
            self._text = "\n".join(b for n in self.members for b in blocks(n, _none))
        return self._text


class Slot:
    """A node of a wrapper: the hash of its own text if (nearly) all its pages have the same, how much text they have in all, and their number."""

    __slots__ = ("label", "tag", "boiler", "weak", "children", "key", "size", "text", "chars", "pages")

    def __init__(self, label: str, tag: str, boiler: bool, weak: bool, text: int | None = None, chars: int = 0, pages: int = 0):
        self.label, self.tag, self.boiler, self.weak, self.text, self.chars, self.pages = label, tag, boiler, weak, text, chars, pages
        self.children: list[Slot] = []
        self.key, self.size = None, 1

    def count(self, pages: int, chars: int, most: int, text: int) -> None:
        """Sets what its pages have; ``most`` of them have the same text."""
        self.pages, self.chars = pages, chars
        self.text = text if most >= TEMPLATE_SHARE * pages else None

    def number(self, keys: dict) -> Slot:
        """Sets keys and sizes, by the same numbers as shapes have."""
        return _number(self, keys)

    def dump(self) -> list:
        return [[s.label, s.tag, s.boiler, s.weak, s.text, s.chars, s.pages, len(s.children)] for s in _preorder(self)]

    @classmethod
    def load(cls, rows: list) -> Slot:
        root, open_slots = None, []
        for *own, n in rows:
            slot = cls(*own)
            while open_slots and not open_slots[-1][1]:
                open_slots.pop()
            if open_slots:
                open_slots[-1][0].children.append(slot)
                open_slots[-1][1] -= 1
            root = root or slot
            open_slots.append([slot, n])
        return root


class Keys:
    """Numbers of shapes: those of a wrapper, which stay as they are, and a page's own."""

    def __init__(self, held: dict):
        self.held, self.own = held, {}

    def __len__(self) -> int:
        return len(self.held) + len(self.own)

    def setdefault(self, shape: tuple, number: int) -> int:
        found = self.held.get(shape)
        return self.own.setdefault(shape, number) if found is None else found


def _number(root, keys):
    for s in reversed(_preorder(root)):
        s.size = 1 + sum(c.size for c in s.children)
        s.key = keys.setdefault((s.label, tuple(c.key for c in s.children)), len(keys))
    return root


def _plain(s) -> str:
    """The label of a node if its own is rare."""
    if s.tag in BOXES:
        return s.label if s.label.split(" ")[1:] in ([], ["main"]) else f"{s.tag}{'!' * s.boiler}"
    return s.label if s.tag in KNOWN else f"*{'!' * s.boiler}"


def _special(root) -> set[str]:
    """The labels of a tree that may be rare."""
    return {s.label for s in _preorder(root) if _plain(s) != s.label}


def _relabel(root, labels):
    """Gives nodes whose labels aren't among these their plain ones."""
    for s in _preorder(root):
        if s.label not in labels:
            s.label = _plain(s)
    return root


def _tree(shape) -> list:
    """A page's tree without its texts, as ``Slot.load`` reads it."""
    return [[s.label, s.tag, s.boiler, s.weak, len(s.children)] for s in _preorder(shape)]


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _preorder(root) -> list:
    out, todo = [], [root]
    while todo:
        s = todo.pop()
        out.append(s)
        todo += reversed(s.children)
    return out


def _spans(x: list, y: list) -> list[tuple[list[int], list[int]]]:
    """Stretches of two lists of children to be matched with each other: pairs of one each, or gaps."""
    first = 0
    while first < min(len(x), len(y)) and x[first].key == y[first].key:
        first += 1
    end = 0
    while end < min(len(x), len(y)) - first and x[-1 - end].key == y[-1 - end].key:
        end += 1
    out = [([k], [k]) for k in range(first)]
    a, b = [*range(first, len(x) - end)], [*range(first, len(y) - end)]
    # A child whose label the other side lacks aligns with none.
    shared = {x[i].label for i in a} & {y[j].label for j in b}
    a, b = [i for i in a if x[i].label in shared], [j for j in b if y[j].label in shared]
    if len(a) * len(b) <= MATCH_CELLS:
        out.append((a, b))
    else:
        # Equal subtrees that each list has once, as many as stand in the same order, then what is between in order.
        once_a, once_b = ({k: i[0] for k, i in _places(z, r).items() if len(i) == 1} for z, r in ((x, a), (y, b)))
        anchors = _rising([(i, once_b[k]) for k, i in once_a.items() if k in once_b])
        i, j = first, first
        for p, q in [*anchors, (len(x) - end, len(y) - end)]:
            gap = (a[bisect_left(a, i) : bisect_left(a, p)], b[bisect_left(b, j) : bisect_left(b, q)])
            if len(gap[0]) * len(gap[1]) <= MATCH_CELLS:
                out.append(gap)
            else:
                m = 0
                for k in gap[0]:
                    if m < len(gap[1]) and y[gap[1][m]].label == x[k].label:
                        out.append(([k], [gap[1][m]]))
                        m += 1
            if p < len(x) - end:
                out.append(([p], [q]))
            i, j = p + 1, q + 1
    return out + [([len(x) - k], [len(y) - k]) for k in range(end, 0, -1)]


def _places(nodes: list, among: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i in among:
        out.setdefault(nodes[i].key, []).append(i)
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs in which both numbers rise."""
    pairs.sort()
    tops, ends, before = [], [], {}
    for n, (_, q) in enumerate(pairs):
        k = bisect_left(tops, q)
        tops[k : k + 1], ends[k : k + 1] = [q], [n]
        before[n] = ends[k - 1] if k else None
    out, n = [], ends[-1] if ends else None
    while n is not None:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def tree_match(a, b, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most nodes of two numbered trees that align in order, and the aligned children.

    ``memo`` holds this by the numbers of both shapes."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (x.key, y.key) in memo:
            todo.pop()
        elif x.label != y.label:
            memo[x.key, y.key] = (0, [])
        elif x.key == y.key:
            memo[x.key, y.key] = (x.size, [(k, k) for k in range(len(x.children))])
        else:
            spans = _spans(x.children, y.children)
            kinds = [({(c := x.children[k]).key: c for k in i}.values(), {(c := y.children[k]).key: c for k in j}.values()) for i, j in spans]
            need = [(p, q) for i, j in kinds for p in i for q in j if p.label == q.label and (p.key, q.key) not in memo]
            if need:
                todo += need
            else:
                pairs = [pair for i, j in spans for pair in _align(x.children, y.children, i, j, memo)]
                memo[x.key, y.key] = (1 + sum(memo[x.children[i].key, y.children[j].key][0] for i, j in pairs), pairs)
    return memo[a.key, b.key]


def _align(x: list, y: list, rows: list[int], cols: list[int], memo: dict) -> list[tuple[int, int]]:
    """Pairs of children of a stretch that align in order with the most nodes."""
    weights: dict[int, list[int]] = {}
    for p in (x[i] for i in rows):
        if p.key not in weights:
            weights[p.key] = [memo[p.key, y[j].key][0] if p.label == y[j].label else 0 for j in cols]
    if len(rows) == 1 and len(cols) == 1:
        return [(rows[0], cols[0])] if weights[x[rows[0]].key][0] else []
    best = [[0] * (len(cols) + 1) for _ in range(len(rows) + 1)]
    for i in range(len(rows)):
        above, here, held = best[i], best[i + 1], 0
        for j, w in enumerate(weights[x[rows[i]].key]):
            held = here[j + 1] = max(above[j + 1], held, above[j] + w) if w else max(above[j + 1], held)
    pairs, i, j = [], len(rows), len(cols)
    while i and j:
        w = weights[x[rows[i - 1]].key][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            pairs.append((rows[i - 1], cols[j - 1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _merge(wrapper: Slot, other: Slot) -> None:
    """Puts into a wrapper what another one has beside it; both are numbered."""
    memo: dict = {}
    todo = [(wrapper, other)]
    while todo:
        slot, its = todo.pop()
        pairs = tree_match(slot, its, memo)[1]
        children, i, j = [], 0, 0
        for a, b in [*pairs, (len(slot.children), len(its.children))]:
            children += slot.children[i:a]
            children += its.children[j:b]
            if a < len(slot.children) and b < len(its.children):
                todo.append((slot.children[a], its.children[b]))
                children.append(slot.children[a])
            i, j = a + 1, b + 1
        slot.children = children


class Places:
    """A host's merged tree, ready to say to which of its slots the nodes of a page's tree fall."""

    def __init__(self, root: Slot):
        self.keys: dict = {}
        self.root = root.number(self.keys)
        self.slots = _preorder(root)
        self.place = {id(s): k for k, s in enumerate(self.slots)}

    def of(self, tree: list) -> list[int]:
        """By node in preorder the place of its slot in preorder, or -1 if it has none."""
        page = Slot.load(tree).number(Keys(self.keys))
        found: dict[int, int] = {}
        memo: dict = {}
        todo = [(self.root, page)]
        while todo:
            slot, s = todo.pop()
            found[id(s)] = self.place[id(slot)]
            todo += [(slot.children[i], s.children[j]) for i, j in tree_match(slot, s, memo)[1]]
        return [found.get(id(s), -1) for s in _preorder(page)]


def merged(trees: list[list]) -> Slot:
    """One wrapper of stored trees, of slots to which their nodes fall."""
    keys: dict = {}
    wrapper, *others = [Slot.load(t) for t in trees]
    for t in others:
        _merge(wrapper.number(keys), t.number(keys))
    places = Places(wrapper)
    used = {id(places.slots[k]) for t in trees for k in places.of(t) if k >= 0}
    for s in places.slots:
        s.children = [c for c in s.children if id(c) in used]
    return wrapper


def induce(pages: list[str]) -> Slot:
    """The wrapper of distinct pages of one host, by the steps of ``wrappers`` in one process."""
    shapes = [Shape.of(parse(p), {}) for p in pages]
    having = Counter(label for s in shapes for label in _special(s))
    for s in shapes:
        _relabel(s, {label for label, n in having.items() if n >= LABEL_SHARE * len(pages)})
    places = Places(merged([_tree(s) for s in shapes]))
    said: dict[int, list[str]] = defaultdict(list)
    for s in shapes:
        for k, node in zip(places.of(_tree(s)), _preorder(s), strict=True):
            if k >= 0:
                said[k].append(node.text())
    for k, texts in said.items():
        counts = Counter(map(_digest, texts))
        most, text = max((n, t) for t, n in counts.items())
        places.slots[k].count(len(texts), sum(map(len, texts)), most, text)
    return places.root


def _template(slot: Slot) -> bool:
    return slot.text is not None and slot.pages >= TEMPLATE_PAGES


def _amounts(root, own) -> dict[int, float]:
    """What ``own`` gives for the nodes of each subtree together, without boilerplate."""
    out: dict[int, float] = {}
    for s in reversed(_preorder(root)):
        out[id(s)] = 0 if s.boiler else own(s) + sum(out[id(c)] for c in s.children)
    return out


def _named(root, names: set[str]) -> list:
    """The outermost elements of these names outside boilerplate."""
    out, todo = [], [root]
    while todo:
        s = todo.pop()
        if s.boiler:
            continue
        if s.tag in names or ("main" in names and s.label.split(" ")[1:] == ["main"]):
            out.append(s)
        else:
            todo += reversed(s.children)
    return out


def content_of(root) -> list:
    """The nodes that hold the content of a page's tree or of a wrapper, where only what varies counts, over all pages."""
    own = (lambda s: 0 if _template(s) else s.chars) if isinstance(root, Slot) else (lambda s: len(s.text()))
    amount = _amounts(root, own)
    total = amount[id(root)]
    for names in ({"article"}, {"main"}):
        found = [s for s in _named(root, names) if amount[id(s)]] or [s for s in _named(root, names) if not total]
        if found and sum(amount[id(s)] for s in found) >= NAMED_SHARE * total:
            return found
    at = root
    while True:
        inner = max(at.children, key=lambda s: amount[id(s)], default=None)
        if inner is None or not total or amount[id(inner)] < INNER_SHARE * total or inner.tag in ("p", "li", "td", "tr", "blockquote", "pre"):
            return [at]
        at = inner


class Wrapper:
    """A host's wrapper, ready for pages: its content, and what in it is template."""

    def __init__(self, root: Slot):
        self.keys: dict = {}
        self.root = root.number(self.keys)
        self.labels = {s.label for s in _preorder(root)}
        self.wanted = {id(s) for s in content_of(root)}
        self.template: set[int] = set()
        for content in (s for s in _preorder(root) if id(s) in self.wanted):
            order = _preorder(content)
            fixed: dict[int, bool] = {}
            for s in reversed(order):
                fixed[id(s)] = _template(s) and all(fixed[id(c)] or c.boiler for c in s.children)
            varying = sum(s.chars for s in order if not _template(s))
            if varying < sum(s.chars for s in order if _template(s)):
                continue  # copies of each other
            self.template |= {id(s) for s in order if s is not content and fixed[id(s)] and (s.tag in BOXES or s.weak)}


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    shape = Shape.of(parse(page), {})
    roots: list[Shape] = []
    template: set[int] = set()
    if wrapper is not None:
        _number(_relabel(shape, wrapper.labels), Keys(wrapper.keys))
        memo: dict = {}
        other: set[int] = set()
        todo = [(wrapper.root, shape)]
        while todo:
            slot, s = todo.pop()
            if id(slot) in wrapper.wanted:
                roots.append(s)
            else:
                other.add(id(s))
            if id(slot) in wrapper.template and slot.text == _digest(s.text()):
                template.update(id(n) for n in s.members)
            todo += [(slot.children[i], s.children[j]) for i, j in reversed(tree_match(slot, s, memo)[1])]
        if roots and all(r.tag == "article" for r in roots):
            # An article that falls to no slot is content like those that do.
            aligned = {id(r) for r in roots}
            roots = [s for s in _named(shape, {"article"}) if id(s) in aligned or id(s) not in other]
    text = _text_of(roots, template)
    return text or _text_of(content_of(shape), set())


def _text_of(roots: list[Shape], template: set[int]) -> str:
    kept = lambda n: not n.boiler and id(n) not in template
    return "\n".join(b for r in roots for n in r.members for b in blocks(n, kept))


@lru_cache(maxsize=256)
def _loaded(text: str) -> Wrapper:
    return Wrapper(Slot.load(json.loads(text)))


@lru_cache(maxsize=256)
def _places_in(text: str) -> Places:
    return Places(Slot.load(json.loads(text)))


def _host(url):
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.lower(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0))


def _trees(pages: DataFrame) -> DataFrame:
    """Of every page host, page (hash of the html), form (hash of host and tree), and by node in preorder texts (hashes) and chars.

    The form's tree and those of its labels that may be rare are given once in a batch."""

    def run(batches):
        for b in batches:
            rows, seen = [], set()
            for host, page in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
                if page:
                    shape = Shape.of(parse(page), {})
                    tree = json.dumps(_tree(shape))
                    form = xxhash.xxh3_128_hexdigest(f"{host}\n{tree}")
                    said = [s.text() for s in _preorder(shape)]
                    own = (None, None) if form in seen else (tree, sorted(_special(shape)))
                    rows.append((host, xxhash.xxh64_intdigest(page) >> 1, form, *own, [_digest(t) for t in said], [len(t) for t in said]))
                    seen.add(form)
            columns = [*zip(*rows, strict=True)] if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], [*kinds])

    kinds = {"host": pa.string(), "page": pa.int64(), "form": pa.string(), "tree": pa.string(), "labels": pa.list_(pa.string()), "texts": pa.list_(pa.int64()), "chars": pa.list_(pa.int64())}
    return pages.select("host", "html").mapInArrow(run, "host string, page long, form string, tree string, labels array<string>, texts array<long>, chars array<long>")


def _forms(read: DataFrame, distinct: DataFrame) -> DataFrame:
    """form, host, count (its distinct pages) and tree of every form, with plain labels in place of rare ones."""
    least = {"host": F.min("host"), "tree": F.min("tree"), "labels": F.min("labels")}
    forms = read.where(F.col("tree").isNotNull()).groupBy("form").agg(*[c.alias(n) for n, c in least.items()])
    forms = materialise(forms.join(distinct.groupBy("form").count(), "form"), "forms")
    pages = forms.groupBy("host").agg(F.sum("count").alias("pages"))
    having = forms.select("host", "count", F.explode("labels").alias("label")).groupBy("host", "label").agg(F.sum("count").alias("n"))
    common = having.join(pages, "host").where(F.col("n") >= LABEL_SHARE * F.col("pages"))
    # No label has a line break in it.
    labels = materialise(common.groupBy("host").agg(F.array_join(F.collect_list("label"), "\n").alias("common")), "labels")

    def plain(batches):
        for b in batches:
            trees = [json.dumps(_tree(_relabel(Slot.load(json.loads(t)), {*(c or "").split("\n")}))) for t, c in zip(b["tree"].to_pylist(), b["common"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["form"], b["host"], b["count"], pa.array(trees, pa.string())], ["form", "host", "count", "tree"])

    told = _beside(forms.drop("labels"), labels, "common", ["form"]).select("form", "host", "count", "tree", "common")
    return materialise(told.mapInArrow(plain, "form string, host string, count long, tree string"), "forms")


def _beside(rows: DataFrame, trees: DataFrame, column: str, by: list[str]) -> DataFrame:
    """rows with what ``column`` of trees has for their host."""
    size = trees.agg(F.sum(F.octet_length(column) + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(trees), "host", "left")
    hosts = materialise(rows.groupBy("host").count().join(trees, "host", "left"), "hosts")
    return join_spread(rows, hosts, "host", "count", hosts.agg(F.sum("count")).first()[0], by)


def _merged(forms: DataFrame) -> DataFrame:
    """host, tree of every host: all its forms in one, merged in rounds of groups that the trees' hash makes."""

    def build(group):
        trees = [json.loads(t) for _, t in sorted(zip(group["id"].to_pylist(), group["tree"].to_pylist(), strict=True))]
        return pa.table({"host": group["host"][:1], "id": group["part"][:1], "left": group["parts"][:1], "tree": [json.dumps(merged(trees).dump())]})

    trees = materialise(forms.select("host", F.xxhash64("tree").alias("id"), "tree").dropDuplicates(["host", "tree"]), "distinct")
    sizes = trees.groupBy("host").agg(F.count("*").alias("left"))
    left = sizes.agg(F.max("left")).first()[0] or 0
    trees = trees.join(sizes, "host")
    while left:
        parts = F.ceil(F.col("left") / FAN)
        dealt = trees.select("host", "id", "tree", parts.alias("parts"), F.pmod("id", parts).alias("part"))
        trees = dealt.groupBy("host", "part").applyInArrow(build, "host string, id long, left long, tree string")
        left = 0 if left <= FAN else -(-left // FAN)
    return trees.select("host", "tree")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of every host, from all its distinct pages."""
    read = materialise(_trees(pages), "trees")
    distinct = read.drop("tree", "labels").dropDuplicates(["host", "page"])
    forms = _forms(read, distinct)
    trees = materialise(_merged(forms), "merged")

    def place(batches):
        for b in batches:
            slots = [_places_in(t).of(json.loads(f)) for f, t in zip(b["tree"].to_pylist(), b["whole"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["form"], b["count"], pa.array(slots, pa.list_(pa.int64()))], ["form", "count", "slots"])

    whole = trees.withColumnRenamed("tree", "whole")
    placed = _beside(forms, whole, "whole", ["form"]).select("form", "count", "tree", "whole")
    placed = materialise(placed.mapInArrow(place, "form string, count long, slots array<long>"), "slots")
    total = placed.agg(F.sum("count")).first()[0] or 0
    said = join_spread(distinct, placed, "form", "count", total, ["page"])
    said = said.select("host", F.explode(F.arrays_zip("slots", "texts", "chars")).alias("at")).select("host", "at.*").where("slots >= 0")
    texts = said.groupBy("host", "slots", "texts").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    top = F.max(F.struct("n", "texts")).alias("top")
    slots = texts.groupBy("host", "slots").agg(F.sum("n").alias("pages"), F.sum("chars").alias("chars"), top)
    counts = slots.groupBy("host").agg(F.collect_list(F.struct("slots", "pages", "chars", "top.n", "top.texts")).alias("counts"))

    def fill(batches):
        for b in batches:
            made = []
            for tree, rows in zip(b["tree"].to_pylist(), b["counts"].to_pylist(), strict=True):
                root = Slot.load(json.loads(tree))
                order = _preorder(root)
                for r in rows:
                    order[r["slots"]].count(r["pages"], r["chars"], r["n"], r["texts"])
                made.append(json.dumps(root.dump()))
            yield pa.RecordBatch.from_arrays([b["host"], pa.array(made, pa.string())], ["host", "wrapper"])

    return trees.join(counts, "host").select("host", "tree", "counts").mapInArrow(fill, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    ship(spark)
    arrow_batches(spark)
    placed = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    joined = _beside(placed, materialise(wrappers(placed), "wrappers"), "wrapper", ["page_id", "url"])

    def run(batches):
        for b in batches:
            texts = [extract(p, _loaded(w) if w else None) for p, w in zip(b["html"].to_pylist(), b["wrapper"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
