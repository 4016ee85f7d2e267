"""HTML main text by a recurrent block labeller.

A page is a sequence of blocks: the text between block-level tags.  Each block is
read as a vector of its tag path (tags, classes and ids, hashed), of its words
(hashed), and of a few measures.  A bidirectional LSTM in numpy reads a page's
whole sequence and labels every block as main text or not.

The labeller learns on the driver, from a bounded sample of pages whose elements
themselves tell main text from the rest, and from invented layouts where names,
places, links and phrases tell it: menus, forms, notices, adverts and readers'
comments stand around articles and inside them.  What elements tell is a label to
learn from and no input; some pages are read with their names, or their names and
telling elements, hidden, so that the labeller learns to do without them.  Scripts,
styles, comments in the markup and what else is never shown are no blocks.

Null or empty html gives the empty text.  Repeated rows stay; equal pages have
equal texts.  A page of any length is read whole.  Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, sampled
from .shingles import word_hashes

#: Pages sampled for training, invented pages, passes, and hidden units of each direction.
SAMPLE, INVENTED, PASSES, HIDDEN = 150, 1500, 14, 24
#: Blocks of a page that training reads, in one run from a place that the page's hash gives; a bound on training data.
TRAINED_BLOCKS = 2000
#: Pages of a training step.
BATCH = 32
#: Dimensions of the path's and the words' hashed vectors, and of the measures.
PATH_DIM, WORD_DIM, MEASURES = 48, 24, 11
DIM = PATH_DIM + WORD_DIM + MEASURES
#: Steps of a sequence whose inputs are weighted at a time.
STEPS = 4096

# Elements that don't end a block, that hold nothing to read (in some of those tags are text), and that have no end tag.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN_TAGS = frozenset("title noscript template svg math canvas iframe object audio video select button textarea datalist map".split())
RAW_TAGS = frozenset("title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that tell what a block is; elements and words of classes that make up a page around its article, and those of
# articles. They label pages to learn from, and are no inputs.
TELLING_TAGS = frozenset("nav header footer aside form menu dialog main article section".split())
AROUND_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog")
AROUND_WORDS = tuple("nav navigation menu navbar breadcrumb breadcrumbs header masthead topbar foot footer copyright legal sidebar aside widget ad ads adv advert advertisement banner promo sponsor sponsored cookie cookies consent gdpr notice notification alert popup modal overlay subscribe subscription newsletter signup signin login form search comment comments reply replies discussion respond disqus related recommended share sharing social tags toolbar pagination pager disclaimer".split())
AROUND_STEMS = ("navig", "breadcrumb", "footer", "copyright", "sidebar", "advert", "sponsor", "cookie", "newsletter", "subscri", "comment", "discuss", "recommend", "paginat", "toolbar", "disclaim", "notific")
AROUND_ENDS = ("nav", "navbar", "menu", "footer", "sidebar", "topbar", "sharebar", "adbox", "banner", "comments")
MAIN_WORDS = tuple("article content main post entry story body text article-body post-content entry-content story-body page-content prose".split())

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<script\b[^>]*>(?:.*?</script\b[^>]*>|.*)|<style\b[^>]*>(?:.*?</style\b[^>]*>|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+|[^<>]*)>""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@functools.cache
def _table(rows: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1, (rows, dim)).astype(np.float32)


@functools.lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[np.ndarray, str]:
    """The hashed vector of a tag and the words of its class, id and role, and what the words say: "around", "main" or ""."""
    names = {w for m in _NAMES.finditer(attributes) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w}
    table = _table(4096, PATH_DIM, 1)
    out = table[zlib.crc32(tag.encode()) % 4096].copy()
    for w in names:
        out += table[zlib.crc32(b"." + w.encode()) % 4096] + table[zlib.crc32(b"^" + w[:4].encode()) % 4096]
    around = any(w in AROUND_WORDS or w.startswith(AROUND_STEMS) or w.endswith(AROUND_ENDS) for w in names)
    return out, "around" if around else "main" if not names.isdisjoint(MAIN_WORDS) else ""


#: What of a page's markup can be read: all, all but classes, ids and roles, or neither those nor which elements tell.
SHOWN, NAMELESS, PLAIN = 0, 1, 2


@dataclass(frozen=True)
class Place:
    """Where a block stands: the path's vector; and for labels to learn from, whether in a form, and the innermost that tells: "main", "around" or ""."""

    path: np.ndarray
    form: bool = False
    inside: str = ""

    def within(self, tag: str, attributes: str, shown: int) -> Place:
        said = _element(tag, attributes)[1]
        own = _element("div" if shown == PLAIN and tag in TELLING_TAGS else tag, "" if shown else attributes)[0]
        inside = self.inside
        if tag in AROUND_TAGS or said == "around":
            inside = "around"
        elif tag == "main" or (tag == "article" and (inside != "around" or self.form)):
            inside = "main"
        return Place(np.float32(0.6) * self.path + own, self.form or tag == "form", inside)


@dataclass
class Block:
    text: str
    place: Place
    linked: int
    opened: int
    closed: int

    @property
    def inside(self) -> str:
        return self.place.inside


def blocks(page: str, shown: int = SHOWN) -> list[Block]:
    """The page's blocks in order, each with its place, and how many elements open and close between it and the one before."""
    out: list[Block] = []
    root = Place(np.zeros(PATH_DIM, np.float32))
    stack: list[tuple[str, Place]] = []
    hidden, link = "", 0
    nested: dict[str, int] = {}
    parts: list[str] = []
    linked = opened = closed = 0

    def close() -> None:
        nonlocal linked, link, opened, closed
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, stack[-1][1] if stack else root, linked, opened, closed))
            opened = closed = 0
        parts.clear()
        linked = link = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not hidden:
            own = page[at : m.start()]
            parts.append(own)
            linked += len(own) if link else 0
        at = m.end()
        if not m[2]:
            continue
        end, tag = bool(m[1]), m[2].lower()
        if hidden:
            if hidden in RAW_TAGS:
                hidden = "" if (end and tag == hidden) or tag == "body" else hidden
                continue
            if not end and tag != "body":
                nested[tag] = nested.get(tag, 0) + (tag not in VOID and not m[3].endswith("/"))
                continue
            if end and nested.get(tag):
                nested[tag] -= 1
                continue
            if tag == hidden:
                hidden = ""
                continue
            if tag != "body" and all(t != tag for t, _ in stack):
                continue
            hidden = ""  # the element around it ends, and so does what was left open
        if tag in HIDDEN_TAGS:
            close()
            nested.clear()
            hidden = "" if end or m[3].endswith("/") else tag
        elif tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            link = (0 if end else 1) if tag == "a" else link
        else:
            close()
            if tag in ("html", "head"):
                continue
            if end:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        closed += len(stack) - k
                        del stack[k:]
                        break
            elif tag not in VOID:
                if tag in ("p", "li", "td", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
                    stack.pop()
                    closed += 1
                stack.append((tag, (stack[-1][1] if stack else root).within(tag, m[3], shown)))
                opened += 1
    if at < len(page) and not hidden:
        parts.append(page[at:])
    close()
    return out


def vectors(pages: Sequence[list[Block]]) -> list[np.ndarray]:
    """For each page a row for each block."""
    flat = [b for p in pages for b in p]
    if not flat:
        return [np.zeros((0, DIM), np.float32) for _ in pages]
    hashes, counts = word_hashes([b.text for b in flat])
    rows = _table(1024, WORD_DIM, 2)[(hashes >> np.uint64(54)).astype(np.int64)]
    sums = np.concatenate((np.zeros((1, WORD_DIM)), np.cumsum(rows, axis=0, dtype=np.float64)))
    ends = np.cumsum(counts)
    words = sums[ends] - sums[ends - counts]
    words /= np.maximum(1, np.sqrt(np.square(words).mean(axis=1)))[:, None]
    chars = np.array([len(b.text) for b in flat], float)
    marks = np.array([b.text.count(".") + b.text.count(",") for b in flat], float)
    linked = np.array([b.linked for b in flat], float)
    place = np.concatenate([np.linspace(0, 1, len(p)) for p in pages if p])
    ended = np.array([b.text[-1] in ".!?" for b in flat], float)
    moves = np.array([(b.opened, b.closed, b.closed > 1) for b in flat], float)
    measures = np.column_stack((np.log1p(chars) / 4, np.log1p(counts) / 3, linked / chars, marks / np.maximum(counts, 1) * 4, place, place == 0, place == 1, ended, np.log1p(moves[:, :2]), moves[:, 2]))
    whole = np.concatenate(([b.place.path for b in flat], words, measures), axis=1).astype(np.float32)
    return np.split(whole, np.cumsum([len(p) for p in pages])[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, DIM**-0.5, (DIM, 4 * HIDDEN)).astype(np.float32)
            w["h" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w["c" + d] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
        w["o"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        w["i"] = np.zeros(DIM, np.float32)
        w["z"] = np.zeros(1, np.float32)
        return cls(w)

    def _pass(self, d: str, x: np.ndarray, here: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        """Hidden states over time of (time, page, dimension) inputs; where `here` is 0, the state is zero.

        Gates are kept for training only.
        """
        time, n, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((time, n, HIDDEN), np.float32), []
        for t in range(time):
            if t % STEPS == 0:
                given = x[t : t + STEPS] @ self.w["x" + d] + self.w["c" + d]
            g = given[t % STEPS] + h @ self.w["h" + d]
            gates = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            before, held = c, h
            c = (f * c + i * u) * here[t]
            tc = np.tanh(c)
            h = o * tc * here[t]
            out[t] = h
            if keep:
                kept.append((i, f, o, u, before, tc, held))
        return out, kept

    def _back(self, d: str, x: np.ndarray, here: np.ndarray, kept: list, dout: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        dh = dc = np.zeros(dout.shape[1:], np.float32)
        dgiven = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        gh = np.zeros_like(self.w["h" + d])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, u, before, tc, held = kept[t]
            dh = (dh + dout[t]) * here[t]
            dc = (dc + dh * o * (1 - tc * tc)) * here[t]
            dgiven[t] = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)), axis=1)
            gh += held.T @ dgiven[t]
            dh, dc = dgiven[t] @ self.w["h" + d].T, dc * f
        grad["h" + d] = gh
        grad["x" + d] = np.einsum("tnd,tng->dg", x, dgiven, optimize=True)
        grad["c" + d] = dgiven.sum((0, 1))

    def scores(self, rows: Sequence[np.ndarray], keep: dict | None = None) -> np.ndarray:
        """(page, time) log-odds, padded; pages are best of similar length."""
        time = max(map(len, rows))
        x = np.zeros((time, len(rows), DIM), np.float32)
        back = np.zeros_like(x)
        here = np.zeros((time, len(rows), 1), np.float32)
        for k, r in enumerate(rows):
            x[: len(r), k], back[: len(r), k], here[: len(r), k] = r, r[::-1], 1
        f, kf = self._pass("f", x, here, keep is not None)
        b, kb = self._pass("b", back, here, keep is not None)
        b = self._turned(b, rows)
        both = np.concatenate((f, b), axis=2)
        out = both @ self.w["o"] + x @ self.w["i"] + self.w["z"]
        if keep is not None:
            keep.update(x=x, back=back, here=here, kf=kf, kb=kb, both=both)
        return out.T

    @staticmethod
    def _turned(x: np.ndarray, rows: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros_like(x)
        for k, r in enumerate(rows):
            out[: len(r), k] = x[: len(r), k][::-1]
        return out

    def gradient(self, rows: Sequence[np.ndarray], labels: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
        kept: dict = {}
        p = _sigmoid(self.scores(rows, kept)).T
        want = np.zeros_like(p)
        for k, y in enumerate(labels):
            want[: len(y), k] = y
        d = ((p - want) * kept["here"][:, :, 0] / kept["here"].sum()).astype(np.float32)
        grad = {"o": np.einsum("tn,tnh->h", d, kept["both"]), "i": np.einsum("tn,tnd->d", d, kept["x"]), "z": d.sum(keepdims=True).ravel()[:1]}
        dboth = d[:, :, None] * self.w["o"]
        self._back("f", kept["x"], kept["here"], kept["kf"], np.ascontiguousarray(dboth[:, :, :HIDDEN]), grad)
        self._back("b", kept["back"], kept["here"], kept["kb"], self._turned(dboth[:, :, HIDDEN:], rows), grad)
        return grad

    def label(self, rows: Sequence[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages of similar length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(rows)
        order = [k for k in sorted(range(len(rows)), key=lambda k: len(rows[k])) if len(rows[k])]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(rows[order[end]]) * (end + 1 - at) <= cells:
                end += 1
            own = order[at:end]
            for k, s in zip(own, self.scores([rows[k] for k in own]), strict=True):
                out[k] = s[: len(rows[k])] > 0
            at = end
        return out


def fit(rows: Sequence[np.ndarray], labels: Sequence[np.ndarray], passes: int = PASSES, rate: float = 0.01) -> Labeller:
    """Adam over batches of pages of similar length; the order is fixed by a seed."""
    rng = np.random.default_rng(7)
    out = Labeller.fresh(rng)
    order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: len(rows[k]))
    batches = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
    m = {k: np.zeros_like(v) for k, v in out.w.items()}
    v = {k: np.zeros_like(x) for k, x in out.w.items()}
    step = 0
    for _ in range(passes):
        for b in rng.permutation(len(batches)):
            grad = out.gradient([rows[k] for k in batches[b]], [labels[k] for k in batches[b]])
            step += 1
            now = rate * (1 - (step - 1) / (passes * len(batches)))  # smaller and smaller steps, so that the last ones settle
            for k, g in grad.items():
                g = g + 1e-4 * out.w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                out.w[k] = (out.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return out


# What menus, feet, notices, forms, adverts and comments say, in the languages of the sample.
SAYS = {
    "foot": "All rights reserved.|© 2024 {}|Copyright 2019 {}|Privacy policy|Terms of use|Imprint|Contact us|Alle Rechte vorbehalten.|Impressum|Tous droits réservés|Mentions légales|Todos los derechos reservados|Powered by {}".split("|"),
    "notice": "We use cookies to improve your experience.|This site uses cookies.|Accept all cookies|By continuing you agree to our terms.|Please enable JavaScript.|Diese Website verwendet Cookies.|Ce site utilise des cookies.|You have 3 free articles left.|Sign in to continue reading.".split("|"),
    "form": "Your name|E-mail address|Password|Search|Send|Subscribe to our newsletter|Sign up for updates|Enter your e-mail address to subscribe.|Required fields are marked|Absenden|Envoyer|Enviar|Remember me".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Shop now and save 20%|Limited offer|Anzeige|Publicité|Promoted content|Learn more about our offers".split("|"),
    "comment": "Comments|3 comments|Leave a comment|Leave a reply|Reply|Posted by {} 2 hours ago|{} says:|{} wrote:|{} schrieb am 3. Mai:|12 likes|Report|Log in to comment|Show more comments".split("|"),
    "more": "Related articles|Read more|You may also like|More from {}|Share this article|Share on Facebook|Tweet|Tags: {}|Most read|Next article|Previous|Back to top|Home|About|Contact|Log in|Sign up".split("|"),
}
PLAIN_NAMES = tuple("box inner wrap row col c1 left right center x block section item area pane container layout group unit".split())
NAMED = {
    "foot": "footer foot copyright legal bottom site-footer page-foot".split(),
    "notice": "notice cookie consent alert popup modal banner cookie-bar gdpr overlay".split(),
    "form": "form signup newsletter subscribe login search respond newsletter-box".split(),
    "ad": "ad ads advert advertisement promo sponsored banner ad-slot adv".split(),
    "comment": "comments comment discussion replies comment-list commentlist responses disqus thread".split(),
    "more": "related share social tags sidebar recommended toolbar widget pagination share-bar".split(),
    "menu": "nav menu navbar navigation breadcrumbs topnav header masthead main-menu".split(),
}


def invented(n: int = INVENTED, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of invented layouts, each with the label of every block."""
    rng = random.Random(seed)
    syllables = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu the an er ing la de und que est con tion ment".split()

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3))))

    def words(low: int, high: int, mark: bool) -> str:
        own = [word() + ("," if mark and rng.random() < 0.08 else "") for _ in range(rng.randint(low, high))]
        return " ".join(own).capitalize() + ("." if mark else "")

    def opened(tag: str, pool: Sequence[str] = ()) -> str:
        if not pool:
            return f"<{tag}>"
        name = rng.choice(pool)
        name += rng.choice(("", "", "", "-" + rng.choice(PLAIN_NAMES), " " + rng.choice(PLAIN_NAMES), " " + word()))
        return f'<{tag} {rng.choice(("class", "class", "id"))}="{name}">'

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def said(kind: str) -> str:
        return rng.choice(SAYS[kind]).format(word().capitalize())

    def around(y: list[int], kind: str, deep: bool = False) -> str:
        """Something that isn't main text; without a telling name or element, its phrases and links tell."""
        tags = {"menu": ("nav", "ul", "div", "header"), "foot": ("footer", "div", "div", "p"), "form": ("form", "form", "div"), "more": ("aside", "div", "ul", "section"), "comment": ("div", "section", "ul", "ol")}.get(kind, ("div", "div", "aside", "section"))
        tag = rng.choice(tags)
        telling = tag in AROUND_TAGS and rng.random() < 0.5
        plain = not telling and rng.random() < (0.2 if kind in ("foot", "menu", "ad", "notice") else 0.1)
        out = [opened(tag, () if telling or (plain and rng.random() < 0.5) else PLAIN_NAMES if plain else NAMED[kind])]

        def add(own: str, text: str) -> None:
            out.append(f"<{own}>{text}</{own}>")
            y.append(0)

        if kind == "menu" and rng.random() < 0.3:
            add(rng.choice(("div", "p", "li")), rng.choice((" ", " | ", "<br>")).join(link(words(1, 2, False)) for _ in range(rng.randint(2, 7))))
        elif kind == "menu":
            for _ in range(rng.randint(2, 9)):
                add("li" if tag in ("ul", "nav") else rng.choice(("div", "li", "p")), link(words(1, 3, False) if rng.random() < 0.8 else said("more")))
        elif kind == "comment":
            if rng.random() < 0.7 or plain:
                add(rng.choice(("h2", "h3", "h4", "p")), said("comment"))
            for _ in range(rng.randint(1, 5)):
                own = "li" if tag in ("ul", "ol") else rng.choice(("div", "div", "article"))
                out.append(opened(own, NAMED["comment"] if rng.random() < 0.6 and not plain else ()))
                if rng.random() < 0.8 or plain:
                    add(rng.choice(("p", "div", "h5", "header")), rng.choice((said("comment"), words(1, 2, False), link(word()))))
                for _ in range(rng.randint(1, 2)):
                    add(rng.choice(("p", "p", "div")), words(*rng.choice(((2, 9), (6, 60))), True))
                out.append(f"</{own}>")
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                add(rng.choice(("p", "div", "p", "h3")), said("form") if rng.random() < 0.6 or plain else words(2, 25, rng.random() < 0.6))
                out.append(rng.choice(("<input type=text>", "<input><br>", "")))
        elif kind == "more":
            if rng.random() < 0.6 or plain:
                add(rng.choice(("h3", "h4", "p")), said("more"))
            for _ in range(rng.randint(1, 6)):
                text = words(2, 10, False) if rng.random() < 0.8 else said("more")
                add("li" if tag == "ul" else rng.choice(("p", "div", "h4")), link(text) if rng.random() < 0.7 or plain else words(3, 30, True))
        else:
            for k in range(rng.randint(1, 3)):
                text = said(kind) if (k == 0 and plain) or rng.random() < 0.6 else words(2, 30, True)
                add(rng.choice(("p", "div", "span", "p")) if tag != "p" else "span", link(text) if rng.random() < 0.25 else text)
                if out[-1].startswith("<span"):
                    out.append("<hr>" if tag != "p" else "")
                    if tag == "p":
                        break
        return "".join(out) + f"</{tag}>"

    def article(y: list[int]) -> str:
        shape = rng.random()
        tag = rng.choice(("article", "main")) if shape < 0.4 else rng.choice(("div", "section", "td", "div"))
        out = [opened(tag, () if shape < 0.3 or 0.4 < shape < 0.5 else MAIN_WORDS if shape < 0.8 else PLAIN_NAMES)]
        wrapped = rng.random() < 0.25
        out.append(opened("div", PLAIN_NAMES if rng.random() < 0.6 else MAIN_WORDS) if wrapped else "")
        if rng.random() < 0.75:
            out.append(f"<h1>{words(2, 10, rng.random() < 0.4)}</h1>")
            y.append(1)
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            low, high = rng.choice(((1, 4), (5, 30), (20, 120)))
            text = words(low, high, True)
            if rng.random() < 0.2:
                text = text.replace(" ", f' <a href="/{word()}">', 1) + "</a>"
            own = "p" if kind < 0.72 else rng.choice(("h2", "h3", "li", "blockquote", "pre", "div", "td", "figcaption", "dd"))
            out.append(f"<{own}>{text}" + ("" if own == "p" and rng.random() < 0.1 else f"</{own}>"))
            y.append(1)
            if rng.random() < 0.12:
                outer, own = rng.choice((("ul", "li"), ("ul", "li"), ("ol", "li"), ("table", "td"), ("dl", "dd"), ("figure", "figcaption")))
                out.append(f"<{outer}>")
                for _ in range(rng.randint(1, 5)):
                    out.append(f"<{own}>{words(*rng.choice(((1, 6), (4, 40))), rng.random() < 0.7)}</{own}>")
                    y.append(1)
                out.append(f"</{outer}>")
            if rng.random() < 0.18:
                out.append(around(y, rng.choice(("ad", "form", "notice", "more", "comment"))))
        if rng.random() < 0.3:
            out.append(around(y, rng.choice(("comment", "comment", "more", "form"))))
        return "".join(out) + "</div>" * wrapped + f"</{tag}>"

    pages = []
    for _ in range(n):
        y: list[int] = []
        body = [around(y, k) for k in rng.choices(("menu", "notice", "ad", "form", "more"), (6, 2, 2, 1, 1), k=rng.randint(0, 3))]
        body.append(article(y))
        body += [around(y, k) for k in rng.choices(("comment", "more", "ad", "form", "notice", "foot"), (3, 2, 1, 1, 1, 1), k=rng.randint(0, 3))]
        body += [around(y, "foot")] if rng.random() < 0.6 else []
        page = "".join(body)
        if rng.random() < 0.4:
            tag = rng.choice(("div", "div", "div", "form"))
            page = opened(tag, PLAIN_NAMES + ("page", "wrapper", "site")) + page + f"</{tag}>"
        pages.append((f"<html><head><title>{words(2, 6, False)}</title></head><body>{page}</body></html>", y))
    return pages


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller from at most `sample` pages whose elements tell, chosen by hash, and from invented layouts; both also with names or elements hidden."""
    chosen = sampled(pages.where(F.col("html").isNotNull()), sample, pages.count(), "page_id", "html").select("html")
    rows, labels = [], []
    for r in chosen.toLocalIterator():  # a page at a time, as pages may be long
        own = blocks(r["html"])
        at = zlib.crc32(r["html"].encode("utf-8", "surrogatepass")) % max(1, len(own) - TRAINED_BLOCKS + 1)
        if any(b.inside == "main" for b in own):
            for shown in (SHOWN, PLAIN):
                rows.append(vectors([blocks(r["html"], shown) if shown else own])[0][at : at + TRAINED_BLOCKS])
                labels.append(np.array([b.inside == "main" for b in own[at : at + TRAINED_BLOCKS]], np.float32))
    for k, (page, y) in enumerate(invented()):
        own = blocks(page, (SHOWN, SHOWN, SHOWN, PLAIN, SHOWN, NAMELESS)[k % 6])
        if len(own) == len(y):
            rows.append(vectors([own])[0])
            labels.append(np.array(y, np.float32))
    return fit(rows, labels)


def main_texts(pages: Sequence[str | None], labeller: Labeller) -> list[str]:
    own = [blocks(p or "") for p in pages]
    keep = labeller.label(vectors(own))
    return [" ".join(b.text for b, k in zip(p, ks, strict=True) if k) for p, ks in zip(own, keep, strict=True)]


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    held = pages.sparkSession.sparkContext.broadcast(labeller)  # a fixed number of weights

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(batch.column("html").to_pylist(), held.value)
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(by_slices(step, 256), "page_id long, url string, text string, n_chars long")
