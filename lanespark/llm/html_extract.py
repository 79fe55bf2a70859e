"""HTML extraction by a recurrent block labeller.

A page is read as its sequence of leaf blocks. Each block is a vector: hashed
tokens of its tag path (tags, classes, ids) and hashed words, both looked up in
learned tables, with a few numbers. A bidirectional LSTM over the page's blocks
gives every block the probability that it belongs to the main text, using the
context of the whole page. Trained in numpy by backpropagation through time on
a bounded sample of pages whose own markup tells main text from the rest, and
on the same blocks set into other page layouts.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags that separate blocks; all others are inline.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav
    ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is never text of the page.
SILENT_TAGS = frozenset("""script style noscript template head title iframe object svg canvas audio video
    select textarea button datalist noembed noframes applet map""".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
# What an open head may hold; anything else ends it, as its closing tag may be left out.
HEAD_TAGS = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
# An opening tag closes an open element of the same kind before it.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = BLOCK_TAGS - {"body", "html"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=|["'])*)(?:>|\Z)|([^<]+|<)""",
    re.S | re.X)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_CSS_OPAQUE = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*"|'[^']*'|\([^()]*\)""", re.S)
_SPACE = re.compile(r"\s+")


def is_hidden(attributes: str) -> bool:
    """Whether a tag's attributes hide it: ``hidden``, ``aria-hidden="true"`` or a style that ends up ``display: none``."""
    if not _MAY_HIDE.search(attributes):
        return False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):   # of repeated attributes the first one counts
        found.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true":
        return True
    display, firm = "", False
    for declaration in _CSS_OPAQUE.sub(" ", found.get("style", "")).lower().split(";"):
        name, _, value = declaration.partition(":")
        value, mark, _ = value.partition("!")
        if name.strip() == "display" and (mark or not firm):
            display, firm = value.strip(), bool(mark)
    return display == "none"


class Path:
    """An element's tag with its class and id words, under its parent's; equal paths of a trie are one object."""

    __slots__ = ("parent", "parts", "leaf", "below")

    def __init__(self, parent: Path | None, parts: tuple[str, ...]):
        self.parent, self.parts, self.below = parent, parts, {}
        kept = [p for p in parts if p[0] != "." and _says(p)]
        self.leaf = kept[-1] if kept else parent.leaf if parent else None     # the last block tag

    def child(self, parts: tuple[str, ...]) -> Path:
        found = self.below.get(parts)
        if found is None:
            global _n_paths
            found = self.below[parts] = Path(self, parts)
            _n_paths += 1
        return found

    def __iter__(self):
        """Parts from the root down."""
        chain, at = [], self
        while at is not None:
            chain.append(at.parts)
            at = at.parent
        return (p for parts in reversed(chain) for p in parts)


def _says(part: str) -> bool:
    """Inline tags and the outermost ones say nothing."""
    return part[0] == "." or part in BLOCK_TAGS and part not in ("html", "body")


_root, _n_paths = Path(None, ()), 0


def _trie() -> Path:
    """The root that all pages share; a new one once it holds too many paths (those in use stay as they are)."""
    global _root, _n_paths
    if _n_paths > 300_000:
        _root, _n_paths = Path(None, ()), 0
    return _root


@dataclass
class Block:
    path: Path | tuple[str, ...]   # tags and class or id words from the root down
    text: str
    linked: int             # characters inside links


class _Open:
    """The open elements of a page. No step looks through all of them, however deep the markup nests.

    An inline element that is closed across blocks leaves its place empty;
    what was opened inside it keeps it in its path.
    """

    def __init__(self):
        self.stack: list[tuple[str, Path, bool] | None] = []    # tag, path, silent
        self.places: dict[str, list[int]] = {}                  # of each tag's open elements
        self.block_places: list[int] = []
        self.n = self.silent = 0
        self.root = _trie()

    def top(self) -> tuple[str, Path, bool] | None:
        while self.stack and self.stack[-1] is None:
            self.stack.pop()
        return self.stack[-1] if self.stack else None

    def path(self) -> Path:
        top = self.top()
        return top[1] if top else self.root

    def last(self, tag: str) -> int | None:
        found = self.places.get(tag)
        return found[-1] if found else None

    def count(self, tag: str) -> int:
        return len(self.places.get(tag, ()))

    def last_block(self) -> str | None:
        return self.stack[self.block_places[-1]][0] if self.block_places else None

    def push(self, tag: str, parts: tuple[str, ...], quiet: bool) -> None:
        path = self.path().child(parts)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS:
            self.block_places.append(len(self.stack))
        self.stack.append((tag, path, quiet))
        self.n += 1
        self.silent += quiet

    def _leave(self, element) -> None:
        tag, _, quiet = element
        self.places[tag].pop()
        self.n -= 1
        self.silent -= quiet

    def close(self, k: int) -> None:
        """Close the element at place k and all inside it."""
        while len(self.stack) > k:
            element = self.stack.pop()
            if element is not None:
                self._leave(element)
        while self.block_places and self.block_places[-1] >= k:
            self.block_places.pop()

    def end(self, tag: str) -> None:
        """A closing tag; one that fits no open element does nothing."""
        k = self.last(tag)
        if k is None:
            return
        if tag not in BLOCK_TAGS and tag != "a" and self.block_places and self.block_places[-1] > k:
            self._leave(self.stack[k])      # an inline tag closed across blocks
            self.stack[k] = None
        else:
            self.close(k)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: text decoded, white space made single spaces, trimmed, none empty.

    Comments, scripts, styles, form controls and hidden elements are no text;
    broken or cut markup is read as far as it goes, in time linear in its length.
    """
    page = page or ""
    out: list[Block] = []
    opened = _Open()
    text: list[str] = []
    linked = 0
    at, end = 0, len(page)

    def flush():
        nonlocal text, linked
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append(Block(opened.path(), joined, linked))
            text = []
        linked = 0

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            if opened.silent and opened.top()[0] == "head" and m[4].strip():
                opened.end("head")
            if not opened.silent:
                text.append(m[4])
                if opened.count("a"):
                    linked += len(m[4])
            continue
        if m[2] is None:
            continue
        if at == end and page[-1] != ">":   # a tag that the page's end cuts
            break
        tag = m[2].lower()
        is_block = tag in BLOCK_TAGS
        if is_block:
            flush()
        elif tag == "br" or tag in ("img", "input"):
            text.append(" ")
        if m[1]:
            opened.end(tag)
            continue
        if tag == "head" and opened.n > opened.count("html"):     # a head inside the page is none
            continue
        top = opened.top()
        if tag == "body":
            if opened.count("head"):
                opened.close(opened.places["head"][0])
        elif top and top[0] == "head" and tag not in HEAD_TAGS:
            opened.end("head")
        if tag in _CLOSES_P or tag in SELF_CLOSING:     # all that they close are blocks
            ends = SELF_CLOSING.get(tag, ()) if tag != "p" else ()
            inner = opened.last_block()
            if inner in ends or inner == "p" and tag in _CLOSES_P:
                opened.end(inner)
        if tag in VOID_TAGS or m[3].rstrip().endswith("/") and not is_block and tag not in RAW_TAGS:
            continue
        names = [next(x for x in c if x is not None) for c in _CLASS.findall(m[3]) if any(c)] if "=" in m[3] else ()
        parts = (tag, *("." + w.lower() for name in names for w in _PARTS.findall(_camel(name))))
        quiet = tag in SILENT_TAGS or bool(m[3] and is_hidden(m[3]))
        if tag == "xmp":        # its markup and references are its text
            stop = re.compile(r"</xmp\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not opened.silent and not quiet:
                flush()
                text.append(page[at:stop.start() if stop else end].replace("&", "&amp;"))
                flush()
            at = stop.end() if stop else end
            continue
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        opened.push(tag, parts, quiet)
    flush()
    return out


def _camel(name: str) -> str:
    return re.sub(r"([a-z])([A-Z])", r"\1 \2", name)


BUCKETS = 1024
_memo: dict[str, int] = {}


def bucket(token: str) -> int:
    found = _memo.get(token)
    if found is None:
        if len(_memo) > 300_000:
            _memo.clear()
        found = _memo[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
    return found


def part_ids(parts) -> list[int]:
    """Hashed path tokens."""
    return [bucket("path " + p) for p in parts if _says(p)]


def path_ids(path: Path | tuple[str, ...]) -> list[int]:
    """Hashed path tokens, then the last block tag's once more."""
    parts = tuple(path)
    last = [p for p in parts if p[0] != "." and _says(p)][-1:]
    return part_ids(parts) + [bucket("leaf " + p) for p in last]


def numbers(b: Block, place: float) -> list[float]:
    n = max(1, len(b.text))
    words = b.text.count(" ") + 1
    return [math.log1p(n) / 8, min(1.0, b.linked / n), math.log1p(words) / 6, float(b.text[-1] in ".!?:\"»”"),
            sum(map(b.text.count, "|©·»")) / words, place, 1.0]


N_NUMBERS = 7


class BlockLabeller:
    """The network: table look-ups, a bidirectional LSTM over blocks and a logistic output."""

    def __init__(self, hidden: int = 16, path_dim: int = 12, word_dim: int = 6, seed: int = 0, w=None):
        self.hidden, self.path_dim, self.word_dim = hidden, path_dim, word_dim
        d, h, rng = path_dim + word_dim + N_NUMBERS, hidden, np.random.default_rng(seed)
        self.w = w or {"path": rng.normal(0, 0.5, (BUCKETS, path_dim)), "word": rng.normal(0, 0.1, (BUCKETS, word_dim)),
                       **{k + s: v for s in "fb" for k, v in (
                           ("x", rng.normal(0, 1 / np.sqrt(d), (d, 4 * h))), ("u", rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))),
                           ("c", np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])))},
                       "o": rng.normal(0, 1 / np.sqrt(h), 2 * h), "direct": np.zeros(d), "p": np.zeros(1)}
        self.w = {k: np.asarray(v, np.float32) for k, v in self.w.items()}

    def block_vectors(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """The vectors of every page's blocks."""
        flat = [b for page in pages for b in page]
        if not flat:
            return [np.zeros((0, self.path_dim + self.word_dim + N_NUMBERS), np.float32) for _ in pages]
        out = np.zeros((len(flat), self.path_dim + self.word_dim + N_NUMBERS), np.float32)
        known: dict = {}
        words, starts = [], []
        for i, b in enumerate(flat):
            out[i, :self.path_dim] = self.path_vector(b.path, known)
            starts.append(len(words))
            words += map(bucket, b.text.lower().split(" "))
        sums = np.add.reduceat(self.w["word"][words], starts)
        out[:, self.path_dim:self.path_dim + self.word_dim] = sums / np.diff([*starts, len(words)])[:, None]
        out[:, -N_NUMBERS:] = [numbers(b, i / max(1, len(page) - 1)) for page in pages for i, b in enumerate(page)]
        return np.split(out, np.cumsum([len(page) for page in pages])[:-1])

    def path_vector(self, path: Path | tuple[str, ...], known: dict) -> np.ndarray:
        """Sum of the path's token vectors. ``known`` holds sums found so far: a path adds to its parent's."""
        table = self.w["path"]
        if isinstance(path, tuple):
            return table[path_ids(path)].sum(axis=0)
        chain, at = [], path
        while at is not None and at not in known:
            chain.append(at)
            at = at.parent
        v = known[at] if at is not None else np.zeros(self.path_dim, np.float32)
        for at in reversed(chain):
            for k in part_ids(at.parts):
                v = v + table[k]
            known[at] = v
        return v + table[bucket("leaf " + path.leaf)] if path.leaf else v

    def _run(self, s, x, mask, keep):
        h, w = self.hidden, self.w
        pre = x @ w["x" + s] + w["c" + s]
        steps, n = mask.shape
        out, saved = np.zeros((steps, n, h), np.float32), [None] * steps
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps) if s == "f" else range(steps - 1, -1, -1):
            a = pre[t] + state @ w["u" + s]
            gates = 0.5 * (np.tanh(0.5 * a[:, :3 * h]) + 1)     # input, forget, output
            new = np.tanh(a[:, 3 * h:])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            m = mask[t][:, None]
            cell_t = m * (f * cell + i * new) + (1 - m) * cell
            squash = np.tanh(cell_t)
            nxt = m * o * squash + (1 - m) * state
            if keep:
                saved[t] = (state, cell, i, f, o, new, squash, m)
            out[t] = state = nxt
            cell = cell_t
        return out, saved

    def probabilities(self, x, mask, keep=False):
        f, sf = self._run("f", x, mask, keep)
        b, sb = self._run("b", x, mask, keep)
        both = np.concatenate([f, b], axis=2)
        logit = both @ self.w["o"] + x @ self.w["direct"] + self.w["p"]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (both, sf, sb)

    def gradients(self, x, mask, y):
        """Mean cross-entropy over blocks, its gradients and that of the block vectors."""
        h = self.hidden
        p, (both, sf, sb) = self.probabilities(x, mask, keep=True)
        n = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n
        d_logit = (p - y) * mask / n
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"], g["p"] = np.einsum("tnh,tn->h", both, d_logit), np.array([d_logit.sum()])
        g["direct"] = np.einsum("tnd,tn->d", x, d_logit)
        d_x = d_logit[..., None] * self.w["direct"]
        d_both = d_logit[..., None] * self.w["o"]
        steps = mask.shape[0]
        for s, saved, d_out in (("f", sf, d_both[..., :h]), ("b", sb, d_both[..., h:])):
            u = self.w["u" + s]
            d_pre = np.zeros((*mask.shape, 4 * h), np.float32)
            d_state = np.zeros((mask.shape[1], h), np.float32)
            d_cell = np.zeros_like(d_state)
            for t in range(steps - 1, -1, -1) if s == "f" else range(steps):
                state, cell, i, f, o, new, squash, m = saved[t]
                total = d_out[t] + d_state
                d_c = total * m * o * (1 - squash * squash) + d_cell
                d_a = np.concatenate([d_c * m * new * i * (1 - i), d_c * m * cell * f * (1 - f),
                                      total * m * squash * o * (1 - o), d_c * m * i * (1 - new * new)], axis=1)
                d_pre[t] = d_a
                g["u" + s] += state.T @ d_a
                d_state = total * (1 - m) + d_a @ u.T
                d_cell = d_c * (m * f + (1 - m))
            g["x" + s] = np.einsum("tnd,tnh->dh", x, d_pre, optimize=True)
            g["c" + s] = d_pre.sum(axis=(0, 1))
            d_x = d_x + d_pre @ self.w["x" + s].T
        return loss, g, d_x

    def label(self, pages: list[list[Block]], at_once: int = 256) -> list[np.ndarray]:
        """Main-text probability of every block of every page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            n = max(1, min(at_once, 200_000 // len(pages[order[min(at_once, len(order)) - 1]])))
            part, order = order[:n], order[n:]
            x, mask = _stack(self.block_vectors([pages[i] for i in part]))
            p, _ = self.probabilities(x, mask)
            for k, i in enumerate(part):
                out[i] = p[:len(pages[i]), k]
        return out


def _stack(vectors):
    steps = max(map(len, vectors))
    x = np.zeros((steps, len(vectors), vectors[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(vectors)), np.float32)
    for k, v in enumerate(vectors):
        x[:len(v), k], mask[:len(v), k] = v, 1
    return x, mask


# Wrappers that pages commonly give their parts, as "tag.class words", used for the training layouts.
MAIN_WRAPS = """article main div.content div.main section.post div.entry.content div.article.body div.story
    div.post.body div.text div.page.content section.article td.content div article.post div.main.content section
    div.article div.body div.single div.markdown div.prose""".split()
OTHER_WRAPS = {
    "menu": """nav div.menu ul.nav div.navigation div.breadcrumbs div.navbar ul.menu div.nav ol.breadcrumb nav.main
        div.topnav div.pagination div.tabs""".split(),
    "header": "header div.header div.top div.masthead div.site.header div.logo header.site div.branding".split(),
    "footer": "footer div.footer div.bottom div.copyright div.site.footer footer.page div.legal div.colophon".split(),
    "sidebar": """aside div.sidebar div.related div.widget div.recommended div.side div.trending aside.sidebar
        div.most.read div.popular section.related div.author.box div.tags div.share div.social""".split(),
    "notice": """div.cookie div.notice div.consent div.alert div.newsletter div.subscribe div.gdpr div.popup
        div.paywall div.banner div.cookie.banner div.modal div.privacy section.notice div.warning p.notice
        div.disclaimer""".split(),
    "advert": """div.ad div.ads div.advert div.sponsored ins.adsbygoogle div.promo div.banner.ad div.advertisement
        aside.ad div.ad.slot section.sponsored div.partner div.commercial p.ad""".split(),
    "form": "form div.search form.login div.form form.newsletter div.contact.form fieldset div.login".split(),
    "comments": """section.comments div.comments ol.comment.list div.comment div.reader.comments div.replies
        div.responses div.discussion ul.comments div.disqus section.user.comments article.comment li.comment""".split(),
}
PHRASES = {
    "menu": ["Home", "About", "Contact", "News", "Login", "Archive", "Next", "Previous"],
    "header": ["Welcome to our site", "Daily News", "Search", "Menu"],
    "footer": ["© 2024 All rights reserved", "Terms of use", "Privacy policy", "Imprint"],
    "sidebar": ["Related articles", "Most read", "Share this", "Follow us", "Tags", "Popular posts"],
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "Subscribe to our newsletter",
               "Please enable JavaScript", "You have 3 free articles left"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Limited offer", "Shop today and save"],
    "form": ["Your email", "Name", "Send", "Password", "Leave a reply", "Message"],
    "comments": ["Reply", "3 comments", "Posted by reader", "Great post, thanks!", "I do not agree.", "Report"],
}


def silver(b: Block) -> bool | None:
    """What a page's own markup says of a block: main text, other, or nothing certain."""
    marks = set(b.path)
    for wraps in OTHER_WRAPS.values():
        for wrap in wraps:
            tag, *words = wrap.split(".")
            if words and any("." + x in marks for x in words) and tag in marks or not words and tag in marks \
                    and tag not in ("header",):
                return False
    if {"article", "main"} & marks:
        return True
    return False if "header" in marks else None


def _wrap(spec: str) -> tuple[str, ...]:
    tag, *words = spec.split(".")
    return (tag, *("." + x for x in words))


def relaid(main: list[Block], other: list[Block], rng) -> tuple[list[Block], list[bool]]:
    """A page of another layout from these texts, with its labels."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    words = " ".join(b.text for b in (other + main)[:12]).split()
    outer = [("html", "body"), ("html", "body", "div"), ("html", "body", "div", ".container"),
             ("html", "body", "div", ".wrapper", "div"), ("html", "body", "div", ".page")]
    root, home = pick(outer), _wrap(pick(MAIN_WRAPS))
    page: list[tuple[Block, bool]] = []

    def filler(kind, inside):
        path = (*root, *(home if inside else ()), *_wrap(pick(OTHER_WRAPS[kind])))
        if rng.random() < 0.3:
            path = (*path, *pick([("div",), ("section",), ("ul",), ("div", ".inner")]))
        for _ in range(int(rng.integers(1, 7 if kind in ("menu", "sidebar", "comments") else 4))):
            long = kind in ("comments", "notice", "advert", "sidebar") and rng.random() < 0.6
            if rng.random() < 0.5 or not words:
                t = pick(PHRASES[kind])
            else:
                k = int(rng.integers(1, 40 if long else 5))
                a = int(rng.integers(0, max(1, len(words) - k)))
                t = " ".join(words[a:a + k])
            leaf = ("ul", "li") if kind == "menu" or rng.random() < 0.3 else pick([("p",), ("div",), (), ("span",)])
            is_link = kind == "menu" or kind in ("sidebar", "footer") and rng.random() < 0.6
            page.append((Block((*path, *leaf, *(("a",) if is_link else ())), t, len(t) if is_link else 0), False))

    def maybe(kind, chance, inside=False):
        if rng.random() < chance:
            filler(kind, inside)

    for kind, chance in (("notice", .4), ("header", .6), ("menu", .7), ("form", .2), ("advert", .4), ("sidebar", .25)):
        maybe(kind, chance)
    cut = int(rng.integers(0, len(main) + 1))
    for k, b in enumerate(main):
        if k == cut and k:
            maybe("advert", .25, True)
            maybe("sidebar", .15, True)
        leaf = [t for t in b.path if t in ("h1", "h2", "h3", "li", "blockquote", "p", "pre", "td")][-1:] or ["p"]
        text = b.text
        if leaf == ["p"] and rng.random() < 0.12:
            leaf = [pick(["h2", "h3", "blockquote", "li", "li", "div", "pre", "figcaption", "td"])]
        if rng.random() < 0.15:     # short blocks belong to the text as well
            text = " ".join(text.split()[:int(rng.integers(1, 6))])
        inner = ("ul",) if leaf == ["li"] else pick([(), (), (), ("div",), ("section",)])
        page.append((Block((*root, *home, *inner, *leaf), text, 0), True))
        if rng.random() < 0.15:     # a list of short items
            items = (*root, *home, pick(["ul", "ol"]), "li")
            page += [(Block(items, " ".join(x.text.split()[:int(rng.integers(1, 5))]), 0), True)
                     for x in main[:int(rng.integers(2, 6))]]
        if rng.random() < 0.04:     # words alone decide nothing
            page.append((Block((*root, *home, "p"), pick(PHRASES[pick(sorted(PHRASES))]), 0), True))
    for kind, chance, inside in (("sidebar", .3, True), ("comments", .3, True), ("comments", .4, False),
                                 ("form", .3, False), ("sidebar", .4, False), ("advert", .3, False),
                                 ("notice", .25, False), ("menu", .2, False), ("footer", .8, False)):
        maybe(kind, chance, inside)
    return [b for b, _ in page], [y for _, y in page]


def fit(pages: list[str], relaid_pages: int = 700, epochs: int = 4, batch: int = 32, rate: float = 0.02,
        longest: int = 80, seed: int = 0) -> BlockLabeller:
    """Train on pages and on their blocks set into other layouts, ``relaid_pages`` of them in all.

    Training pages are cut into runs of at most ``longest`` blocks (labelling reads pages whole).
    """
    rng = np.random.default_rng(seed)
    net = BlockLabeller(seed=seed)
    data: list[tuple[list[Block], list[bool]]] = []
    layouts = -(-relaid_pages // max(1, len(pages)))
    for page in pages:
        bs = blocks(page)
        ys = [silver(b) for b in bs]
        sure = [(b, y) for b, y in zip(bs, ys) if y is not None]
        if any(y for _, y in sure):
            data.append(([b for b, _ in sure], [y for _, y in sure]))
        main = [b for b, y in sure if y] or [Block(("p",), "Text of the page.", 0)]
        for _ in range(layouts):
            data.append(relaid(main[:int(rng.integers(1, 25))], [b for b, y in sure if not y], rng))
    data = [(b[a:a + longest], y[a:a + longest]) for b, y in data for a in range(0, len(b), longest)]
    if not data:
        return net
    path_rows = [[path_ids(b.path) for b in bs] for bs, _ in data]
    word_rows = [[[bucket(x) for x in b.text.lower().split(" ")][:60] for b in bs] for bs, _ in data]
    nums = [np.array([numbers(b, i / max(1, len(bs) - 1)) for i, b in enumerate(bs)], np.float32) for bs, _ in data]
    m1 = {k: np.zeros_like(v) for k, v in net.w.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    total, step = epochs * -(-len(data) // batch), 0
    pd, wd = net.path_dim, net.word_dim
    for _ in range(epochs):
        order = rng.permutation(len(data))
        order = np.concatenate([sorted(order[a:a + 8 * batch], key=lambda i: len(data[i][0]))
                                for a in range(0, len(order), 8 * batch)]).astype(int)
        for a in range(0, len(order), batch):
            part, vectors, bags = order[a:a + batch], [], []
            for i in part:
                v = np.zeros((len(data[i][0]), pd + wd + N_NUMBERS), np.float32)
                rows = [[x for x in r if rng.random() > 0.1] for r in path_rows[i]]     # hashed tokens drop out
                said = rng.random() > 0.3                                               # and so do a page's words
                for k, r in enumerate(rows):
                    if r:
                        v[k, :pd] = net.w["path"][r].sum(axis=0)
                    if said:
                        v[k, pd:pd + wd] = net.w["word"][word_rows[i][k]].mean(axis=0)
                v[:, pd + wd:] = nums[i]
                vectors.append(v)
                bags.append((rows, said))
            x, mask = _stack(vectors)
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(part):
                y[:len(data[i][1]), k] = data[i][1]
            _, g, d_x = net.gradients(x, mask, y)
            for k, i in enumerate(part):
                rows, said = bags[k]
                for t, r in enumerate(rows):
                    if r:
                        np.add.at(g["path"], r, d_x[t, k, :pd])
                    words = word_rows[i][t]
                    if said:
                        np.add.at(g["word"], words, d_x[t, k, pd:pd + wd] / len(words))
            step += 1
            lr = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for k in net.w:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                net.w[k] = (net.w[k] - lr * (m1[k] / (1 - 0.9 ** step))
                            / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


def train(pages: DataFrame, rows: int = 120, html_col: str = "html") -> BlockLabeller:
    """Fit on ``rows`` different pages (all, if there are no more): those whose markup's hash is smallest."""
    hashed = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).cast("string").alias("h")) \
        .withColumn("k", F.xxhash64("h"))
    first = [r["k"] for r in hashed.select("k").distinct().orderBy("k").limit(rows).collect()]
    got = hashed.where(F.col("k").isin(first)).dropDuplicates(["k"]).collect()
    return fit(sorted(r["h"] for r in got))


def extract(pages: DataFrame, net: BlockLabeller, keep: list[str] | None = None, html_col: str = "html",
            threshold: float = 0.5) -> DataFrame:
    """``keep`` of ``pages`` (default: page_id, url) and ``text``: the main blocks in page order, joined by two \\\\n.

    Null or blank markup, or a page without main text, gives the empty string.
    Repeated rows are labelled alike.
    """
    keep = ["page_id", "url"] if keep is None else keep
    weights = net.w

    def run(batches):
        model = BlockLabeller(w=weights)
        for batch in batches:
            sources, n = batch.column(batch.num_columns - 1), batch.num_rows
            texts = []
            for a in range(0, n, 512):
                read = [blocks(sources[i].as_py()) for i in range(a, min(n, a + 512))]
                texts += ["\n\n".join(b.text for b, p in zip(bs, ps) if p >= threshold)
                          for bs, ps in zip(read, model.label(read))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                             names=[*batch.schema.names[:-1], "text"])

    given = pages.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)],
                         F.col(html_col).cast("string").alias("h"))
    types = ", ".join(f"c{k} {given.schema[k].dataType.simpleString()}" for k in range(len(keep)))
    return given.mapInArrow(run, f"{types}, text string").toDF(*keep, "text")
