"""Main text of HTML pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block has a vector of its
tag path (tags, classes and ids, hashed), of its words (hashed), of a few
measures and of its place among the page's elements: whether it lies in the
element that directly holds most of the page's unlinked text, how deep, and how
much text its own element holds. A bidirectional LSTM in numpy reads the whole
sequence and labels every block as main text or not; its label is the decision.

It is trained on the driver from at most TRAIN_PAGES pages of the table (by hash
of id and page, none beyond TRAIN_CHARS or nested deeper than TRAIN_DEPTH) that mark their article themselves: blocks
inside <article> or <main>, but in none of the parts that BOILERPLATE names, are
main text. BOILERPLATE labels the training blocks and is no input. Each page is
also shown in other forms: the article's tag renamed or left out, blocks of the
article put into quotes, lists and sections, and menus, headers, sidebars,
notices, adverts, forms and comments inside and outside of the article; in half
of these forms every class name is replaced by a made-up one and elements such as
<nav> and <footer> by <div>, so that names are not all that is learnt.

Cases: a null or empty page, or one of markup only, has an empty text and 0
characters; if no page of the sample marks an article the labels fall back to
blocks outside BOILERPLATE; a page of any length and depth is read whole: elements
are kept once, with a link to their parent, and vectors and LSTM steps of very many
blocks are made in slices; unclosed tags and cut-off pages are read as far as they go; repeated rows give repeated results;
null ids are carried; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches

TRAIN_PAGES, TRAIN_CHARS, TRAIN_DEPTH = 150, 200_000, 200
#: Padded steps that are scored together; blocks of a longer page whose vectors are
#: there at once.
STEPS_AT_ONCE, SLICE = 16_384, 4_096
PATH_DIMS, WORD_DIMS, EXTRA, HIDDEN = 96, 64, 13, 16
EPOCHS, BATCH, RATE, SEED, FORMS = 14, 30, 0.02, 5, 4
#: Elements that don't end a block, that hold no text, and that
#: are closed by the start of a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template textarea title svg math iframe object select option button head".split())
#: Tags that may stand in a head; any other ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Words in tags, classes and ids of parts that aren't main text.
BOILERPLATE = frozenset("nav menu navbar header masthead footer aside sidebar ad ads advert advertisement banner sponsored promo cookie consent notice notices alert popup modal form newsletter subscribe signup login search share social related recommended breadcrumb breadcrumbs comment comments commentlist reply replies disqus widget copyright".split())
MAIN = frozenset("article main".split())
TOKEN = re.compile(r"""(?s)<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|title|iframe)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|$)|<!\w[^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)>|([^<]+|<)""", re.I)
NAMES = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
SPACE = re.compile(r"\s+")
SPLIT = re.compile(r"[^a-z0-9]+")

#: An open element: its number on the page, its tag and the words of its names.
Element = tuple[int, str, tuple[str, ...]]
#: Open elements from the outermost, text, characters inside links.
Block = tuple[tuple[Element, ...], str, int]


class Tree:
    """Elements with a link to their parent (-1 for none), so that a path of any
    depth is kept once. Parents come before their children."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.element: list[Element] = []

    def add(self, parent: int, element: Element) -> int:
        self.parent.append(parent)
        self.element.append(element)
        return len(self.parent) - 1

    def path(self, node: int) -> tuple[Element, ...]:
        out = []
        while node >= 0:
            out.append(self.element[node])
            node = self.parent[node]
        return tuple(out[::-1])


#: Innermost open element, text, characters inside links.
Leaf = tuple[int, str, int]


def parsed(page: str | None) -> tuple[Tree, list[Leaf]]:
    """The leaf blocks in page order, with the tree of their elements."""
    tree, out = Tree(), []
    stack: list[int] = []
    run: list[str] = []
    opened: Counter[str] = Counter()
    linked = link = silent = count = 0

    def close() -> None:
        nonlocal linked
        if run:
            text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                out.append((stack[-1] if stack else -1, text, linked))
            run.clear()
        linked = 0

    def top() -> str:
        return tree.element[stack[-1]][1] if stack else ""

    def pop() -> str:
        nonlocal silent
        tag = tree.element[stack.pop()][1]
        opened[tag] -= 1
        silent -= tag in SILENT
        return tag

    for m in TOKEN.finditer(page or ""):
        _, end, tag, attrs, text = m.groups()
        if text is not None:
            if top() == "head" and text.strip():
                pop()
            if not silent:
                run.append(text)
                linked += len(text) * (link > 0)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link = max(0, link - 1) if end else link + 1
            if tag == "br":
                run.append(" ")
            continue
        close()
        link = 0
        if end:
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if top() == "head" and tag not in HEAD:
            pop()
        if tag in VOID or attrs.endswith("/"):
            continue
        while stack and (top() == "p" or (tag == top() and tag in ("li", "dt", "dd", "tr", "td", "th", "option"))):
            pop()
        if tag == "body" and silent:  # what hides text is over; what is open above it stays open
            above = []
            while silent:
                element = tree.element[stack[-1]]
                if pop() not in SILENT:
                    above.append(element)
            for element in reversed(above):
                opened[element[1]] += 1
                stack.append(tree.add(stack[-1] if stack else -1, element))
        names = {n for g in NAMES.findall(attrs) for x in g if x for n in SPLIT.split(x.lower()) if n}
        count += 1
        stack.append(tree.add(stack[-1] if stack else -1, (count, tag, tuple(sorted(names)))))
        opened[tag] += 1
        silent += tag in SILENT
    close()
    return tree, out


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks in page order, each with its whole path (for training)."""
    tree, leaves = parsed(page)
    return [(tree.path(node), text, linked) for node, text, linked in leaves]


def depth_of(tree: Tree) -> int:
    """How deep elements are nested at most."""
    depth = [0] * len(tree.parent)
    for k, p in enumerate(tree.parent):
        depth[k] = 1 + (depth[p] if p >= 0 else 0)
    return max(depth, default=0)


def as_tree(page: list[Block]) -> tuple[Tree, list[Leaf]]:
    """Blocks with paths as a tree and leaves."""
    tree, known, out = Tree(), {}, []
    for path, text, linked in page:
        node = -1
        for element in path:
            at = known.get((node, element))
            node = known.setdefault((node, element), tree.add(node, element)) if at is None else at
        out.append((node, text, linked))
    return tree, out


def boilerplate(path: tuple[Element, ...]) -> bool:
    return any(tag in BOILERPLATE or not BOILERPLATE.isdisjoint(names) for _, tag, names in path)


def labelled(page: str) -> list[tuple[Block, bool]] | None:
    """The blocks with the labels that the page's own markup gives them, None if
    it marks no article."""
    got = blocks(page)
    inside = [any(tag in MAIN for _, tag, _ in path) for path, _, _ in got]
    if not any(inside):
        return None
    return [(b, i and not boilerplate(b[0])) for b, i in zip(got, inside, strict=True)]


class Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = n = zlib.crc32(word.encode("utf-8")) % WORD_DIMS
        return n


#: Elements that hold one text; their parent is what gathers texts.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre figcaption label legend caption".split())


def holder(path: tuple[Element, ...]) -> int:
    """Place in the path of the element that gathers the block and its likes."""
    i = len(path) - 1
    while i > 0 and path[i][1] in LEAVES:
        i -= 1
    return i


class Vectors:
    """The vectors of a page's blocks, made for one slice of them at a time. All that
    depends on an element's path is found once an element, from its parent's."""

    def __init__(self, tree: Tree, page: list[Leaf], words: Words):
        self.page, self.words = page, words
        n = len(tree.parent)
        self.cells: list[int] = [0] * (n + 1)  # those of the element, as bits; the last entry is that of no element
        self.outer: list[int] = [0] * (n + 1)  # those of all elements around it
        self.depth, self.holder, self.sign, self.at = [-1] * (n + 1), [-1] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        self.number, self.leaf = [0] * (n + 1), [False] * (n + 1)
        bits: dict[str, int] = {}
        signs: dict[tuple[int, str, tuple[str, ...]], int] = {}
        for k, (p, (number, tag, names)) in enumerate(zip(tree.parent, tree.element, strict=True)):
            own = 0
            for name in (tag, *names):
                if name not in bits:
                    bits[name] = 1 << zlib.crc32(name.encode()) % PATH_DIMS
                own |= bits[name]
            self.cells[k], self.outer[k] = own, self.outer[p] | self.cells[p]
            self.number[k], self.depth[k], self.leaf[k] = number, self.depth[p] + 1, tag in LEAVES
            self.holder[k] = self.holder[p] if p >= 0 and tag in LEAVES else k
            self.sign[k] = signs.setdefault((self.sign[p], tag, names), len(signs))
        held: dict[int, int] = {}
        numbers: dict[int, int] = {}
        self.own = [self.number[self.holder[node]] for node, _, _ in page]
        for own, (_, text, linked) in zip(self.own, page, strict=True):
            held[own] = held.get(own, 0) + max(0, len(text) - linked)
            numbers[own] = numbers.get(own, 0) + 1
        self.held, self.numbers, self.total = held, numbers, max(1, sum(held.values()))
        self.top = max(held, key=lambda n: (held[n], -n), default=0)
        self.like = next((self.sign[self.holder[node]] for own, (node, _, _) in zip(self.own, page, strict=True) if own == self.top), -1)
        for k, p in enumerate(tree.parent):  # how deep the element with most text lies around or at this one
            self.at[k] = self.at[p] if p >= 0 and self.at[p] >= 0 else self.depth[k] if self.number[k] == self.top else -1

    def __len__(self) -> int:
        return len(self.page)

    def rows(self, lo: int, hi: int) -> np.ndarray:
        part = self.page[lo:hi]
        x = np.zeros((len(part), PATH_DIMS + WORD_DIMS + EXTRA), np.float32)
        spread = lambda masks: np.unpackbits(np.frombuffer(b"".join(masks[node].to_bytes(PATH_DIMS // 8, "little") for node, _, _ in part), np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        own = spread(self.cells)
        x[:, :PATH_DIMS] = np.where(own, 1.5, spread(self.outer))
        for i, (node, text, linked) in enumerate(part):
            parts = text.split(" ")
            counts = np.bincount(np.fromiter(map(self.words.__getitem__, parts), np.int64, len(parts)), minlength=WORD_DIMS)
            x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts * (0.6 / np.sqrt(counts @ counts))
            holder, at, number = self.holder[node], self.at[node], self.own[lo + i]
            x[i, -EXTRA:] = (
                min(np.log1p(len(text)) / 6, 2), min(linked / len(text), 1), text[-1] in ".!?…:\"'»”", (lo + i) / len(self.page), 1, at >= 0, number == self.top, min(self.depth[holder] - at, 4) / 4 if at >= 0 else 1,
                self.sign[holder] == self.like, self.held[number] / self.total, np.log1p(self.numbers[number]) / 4, len(parts) <= 3, self.leaf[node],
            )
        return x


def vectors(page: list[Block], words: Words) -> np.ndarray:
    return Vectors(*as_tree(page), words).rows(0, len(page))


class Lstm:
    """One direction; gates in the order input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator, size: int):
        self.w = rng.normal(scale=1 / np.sqrt(size), size=(size, 4 * HIDDEN)).astype(np.float32)
        self.u = rng.normal(scale=1 / np.sqrt(HIDDEN), size=(HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1.0

    def params(self) -> list[np.ndarray]:
        return [self.w, self.u, self.b]

    def forward(self, x: np.ndarray, keep: bool = False, state: list[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """x: (steps, pages, size) to (steps, pages, HIDDEN). state: cell and output
        to go on from, which are replaced by those at the end."""
        steps, n, _ = x.shape
        given = x @ self.w + self.b
        c, h = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out, tape = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = given[t] + h @ self.u
            gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            was, before = c, h
            c = f * was + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((i, f, o, g, was, before, tc))
        if state is not None:
            state[:] = c, h
        return out, tape

    def backward(self, x: np.ndarray, tape: list, dh_out: np.ndarray) -> list[np.ndarray]:
        n = x.shape[1]
        dw, du, db = (np.zeros_like(p) for p in self.params())
        dh = np.zeros((n, HIDDEN), np.float32)
        dc = np.zeros((n, HIDDEN), np.float32)
        for t in range(len(tape) - 1, -1, -1):
            i, f, o, g, was, before, tc = tape[t]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * was * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            dw += x[t].T @ dz
            du += before.T @ dz
            db += dz.sum(axis=0)
            dh, dc = dz @ self.u.T, dc * f
        return [dw, du, db]


def turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse order, the padding left behind."""
    steps = np.arange(x.shape[0])[:, None]
    at = np.where(steps < lengths, lengths - 1 - steps, steps)
    return x[at, np.arange(x.shape[1])]


class Labeller:
    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        size = PATH_DIMS + WORD_DIMS + EXTRA
        self.there, self.back = Lstm(rng, size), Lstm(rng, size)
        self.v = rng.normal(scale=0.2, size=2 * HIDDEN + size).astype(np.float32)
        self.v0 = np.zeros(1, np.float32)

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((max(1, lengths.max()), len(pages), PATH_DIMS + WORD_DIMS + EXTRA), np.float32)
        for i, p in enumerate(pages):
            x[: len(p), i] = p
        return x, lengths

    def score(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text of every block of every page."""
        x, lengths = self.padded(pages)
        h = np.concatenate((self.there.forward(x)[0], turned(self.back.forward(turned(x, lengths))[0], lengths), x), axis=2)
        p = 1 / (1 + np.exp(-(h @ self.v + self.v0)))
        return [p[:n, i] for i, n in enumerate(lengths)]

    def score_long(self, page: Vectors) -> np.ndarray:
        """As score for one page, of whose vectors only a slice is there at a time.
        What is kept of a block are the outputs of one direction and its share of
        the decision."""
        n, slices = len(page), range(0, len(page), SLICE)
        start = lambda: [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
        total, state = np.empty(n, np.float32), start()
        for lo in slices:
            x = page.rows(lo, lo + SLICE)
            total[lo : lo + len(x)] = self.there.forward(x[:, None], state=state)[0][:, 0] @ self.v[:HIDDEN] + x @ self.v[2 * HIDDEN :]
        state = start()
        for lo in reversed(slices):
            x = page.rows(lo, lo + SLICE)[::-1]
            total[lo : lo + len(x)] += (self.back.forward(x[:, None], state=state)[0][:, 0] @ self.v[HIDDEN : 2 * HIDDEN])[::-1]
        return 1 / (1 + np.exp(-(total + self.v0)))

    def score_all(self, pages: list[Vectors]) -> list[np.ndarray]:
        """score() of all pages, in batches whose padded steps are bounded; a page
        beyond the bound is scored alone in slices."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        some: list[int] = []

        def flush() -> None:
            for i, p in zip(some, self.score([pages[i].rows(0, len(pages[i])) for i in some]) if some else (), strict=True):
                out[i] = p
            some.clear()

        for i in sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i])):
            if len(pages[i]) > STEPS_AT_ONCE:
                out[i] = self.score_long(pages[i])
                continue
            if len(some) == 64 or (len(some) + 1) * len(pages[i]) > STEPS_AT_ONCE:
                flush()
            some.append(i)
        flush()
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS) -> None:
        params = [*self.there.params(), *self.back.params(), self.v, self.v0]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, step = random.Random(SEED), 0
        for epoch in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i]) // 8, rng.random()))
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            rng.shuffle(batches)
            for batch in batches:
                step += 1
                x, lengths = self.padded([pages[i] for i in batch])
                y = np.zeros(x.shape[:2], np.float32)
                for j, i in enumerate(batch):
                    y[: len(labels[i]), j] = labels[i]
                mask = (np.arange(x.shape[0])[:, None] < lengths).astype(np.float32)
                a, tape_a = self.there.forward(x, True)
                xr = turned(x, lengths)
                b, tape_b = self.back.forward(xr, True)
                h = np.concatenate((a, turned(b, lengths), x), axis=2)
                p = 1 / (1 + np.exp(-(h @ self.v + self.v0)))
                d = (p - y) * mask / mask.sum()
                dh = d[:, :, None] * self.v
                grads = [*self.there.backward(x, tape_a, dh[:, :, :HIDDEN]), *self.back.backward(xr, tape_b, turned(dh[:, :, HIDDEN : 2 * HIDDEN], lengths)), np.tensordot(d, h, axes=((0, 1), (0, 1))), np.array([d.sum()], np.float32)]
                rate = RATE * (1 - epoch / epochs) + 1e-4
                for q, g, m, s in zip(params, grads, first, second, strict=True):
                    np.clip(g, -1, 1, out=g)
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


#: Parts that aren't main text, as (tag, class) from the outermost, and texts that stand in them.
WRAPPERS = [[("nav", "")], [("header", "")], [("header", "site")], [("footer", "")], [("aside", "")], [("aside", "sidebar")], [("form", "")], [("div", "ad")], [("div", "ads")], [("div", "advert")], [("div", "comments")], [("section", "comments")], [("div", "comment")], [("div", "notice")], [("div", "cookie")], [("div", "banner")], [("div", "menu")], [("div", "related")], [("div", "share")], [("div", "sidebar")], [("ul", "nav")], [("div", "promo")], [("div", "newsletter")], [("div", "comments"), ("div", "comment")]]
ARTICLES = [None, ("main", ""), ("div", "content"), ("div", "post"), ("section", ""), ("div", "entry"), ("div", ""), ("div", "text")]
QUOTES = [[("blockquote", "")], [("ul", ""), ("li", "")], [("ol", ""), ("li", "")], [("section", "")], [("figure", ""), ("figcaption", "")], [("pre", "")], [("table", ""), ("tr", ""), ("td", "")]]
PHRASES = [
    "Sign up for our newsletter", "Subscribe now", "Sign in", "Log in or register", "Enter your email address", "Search", "Home", "Menu", "About us", "Contact", "Privacy policy", "Terms of use", "All rights reserved", "We use cookies to improve our site", "Accept all cookies", "Share this", "Follow us",
    "Read more", "Related articles", "You may also like", "Most read", "Advertisement", "Sponsored", "Buy now and save", "Leave a reply", "Post a comment", "Great article, thanks for sharing", "I agree with this, well said", "I think you are wrong about this", "First comment", "Posted by a reader two days ago", "Reply", "Comments", "Tags",
    "Previous", "Next", "Back to top", "Skip to content", "Print this page", "Newsletter abonnieren", "Impressum", "Datenschutz", "Anmelden", "Mentions légales", "Connexion", "Abonnez-vous", "Aviso legal", "Suscríbete", "Iniciar sesión",
]


def made_up(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghklmnprstvwxz") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5)))


def shown_otherwise(page: list[tuple[Block, bool]], others: list[str], rng: random.Random) -> list[tuple[Block, bool]]:
    """Another form of the page: other wrappers and names, and some of its own or
    other texts put in as parts that aren't main text."""
    fresh = 10**6
    foreign = rng.random() < 0.5
    spelt: dict[str, str] = {}

    def made(steps: list[tuple[str, str]]) -> tuple[Element, ...]:
        nonlocal fresh
        out = []
        for tag, name in steps:
            fresh += 1
            out.append((fresh, tag, (name,) if name else ()))
        return tuple(out)

    def renamed(e: Element) -> Element:
        tag = "div" if foreign and e[1] in ("nav", "header", "footer", "aside", "form") else e[1]
        names = tuple(spelt.setdefault(n, made_up(rng)) for n in e[2]) if foreign else e[2]
        return (e[0], tag, names or ((spelt.setdefault(e[1], made_up(rng)),) if tag != e[1] else ()))

    article = rng.choice(ARTICLES)
    instead = made([article]) if article else ()
    out: list[tuple[Block, bool]] = []
    for (path, text, linked), main in page:
        at = next((i for i, e in enumerate(path) if e[1] in MAIN), None)
        out.append(((path if at is None or not main else (*path[:at], *instead, *path[at + 1 :]), text, linked), main))
    mains = [i for i, (_, main) in enumerate(out) if main]
    for _ in range(rng.randrange(3)):  # parts of the article in elements of their own
        if len(mains) > 2:
            lo = rng.randrange(1, len(mains))
            quote = made(rng.choice(QUOTES))
            for i in mains[lo : lo + rng.randrange(1, 4)]:
                (path, text, linked), main = out[i]
                out[i] = (((*path[: holder(path) + 1], *quote), text, linked), main)
    for _ in range(rng.randrange(2, 6)):
        where = rng.randrange(len(out) + 1)
        near = out[min(where, len(out) - 1)][0][0]
        near = near[: holder(near) + 1] if rng.random() < 0.6 else near[:2]
        wrap = made(rng.choice(WRAPPERS))
        leaf = rng.choice([[], [("p", "")], [("p", "")], [("ul", ""), ("li", "")], [("div", ""), ("p", "")]])
        some = []
        for _ in range(rng.randrange(1, 5)):
            text = rng.choice(PHRASES) if rng.random() < 0.5 else rng.choice(others)
            some.append((((*near, *wrap, *made(leaf)), text, len(text) if rng.random() < 0.3 else 0), False))
        out[where:where] = some
    return [((tuple(map(renamed, path)), text, linked), main) for (path, text, linked), main in out]


def fit(rows: list[str]) -> Labeller:
    rows = [r for r in rows if depth_of(parsed(r)[0]) <= TRAIN_DEPTH]
    pages = [p for r in rows if (p := labelled(r)) is not None]
    if not pages:
        pages = [[(b, not boilerplate(b[0])) for b in blocks(r)] for r in rows]
    pages = [p for p in pages if p]
    model = Labeller()
    if not pages:
        return model
    rng, words = random.Random(SEED), Words()
    texts = [b[1] for p in pages for b, _ in p]
    shown = [*pages, *(shown_otherwise(p, texts, rng) for _ in range(FORMS) for p in pages)]
    model.train([vectors([b for b, _ in p], words) for p in shown], [np.array([y for _, y in p], np.float32) for p in shown])
    return model


def sample(pages: DataFrame, id_col: str, html_col: str) -> list[str]:
    """At most TRAIN_PAGES pages. Keys are chosen first, so that no more than
    these pages ever leave their tasks."""
    rows = pages.where(F.col(html_col).isNotNull() & (F.length(html_col) <= TRAIN_CHARS)).select(F.xxhash64(F.col(id_col).cast("string"), html_col).alias("k"), F.col(html_col).alias("page"))
    keys = sorted({r.k for r in rows.select("k").orderBy("k").limit(TRAIN_PAGES).collect()})
    found = {r.k: r.page for r in rows.where(F.col("k").isin(keys)).groupBy("k").agg(F.first("page").alias("page")).collect()} if keys else {}
    return [found[k] for k in keys]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = pages.sparkSession.sparkContext.broadcast(fit(sample(pages, id_col, html_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            pages = [parsed(p) for p in b.column(2).to_pylist()]
            scores = model.value.score_all([Vectors(tree, leaves, words) for tree, leaves in pages])
            texts = ["\n".join(text for (_, text, _), q in zip(leaves, p.tolist(), strict=True) if q >= 0.5) for (_, leaves), p in zip(pages, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), html_col), run, "page_id long, url string, text string, n_chars long")
