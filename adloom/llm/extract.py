"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into the blocks of text between block-level tags, in page order. A block is
described by its ancestors (tags, and words of their class and id attributes) and by its
text (length, share of links, punctuation, case). The field scores two labels, main text
and the rest, for each block and for each pair of neighbours; its weights are trained on
labelled pages by gradient ascent on the likelihood, and Viterbi decoding labels the
blocks of a page together.

The labelled pages are made here, from a fixed seed, by filling in many kinds of layouts;
their labels are known because the generator places each block. None of the pages under
extraction is learned from.

Defined results: null and empty html, and pages without text, give an empty text. Broken
markup is read as browsers would roughly: an open paragraph ends at the next block, and an
end tag that opens nothing is skipped. A ``br`` is white space. Head, scripts, styles,
form controls and comments in markup have no blocks; what ``noscript`` and ``object`` hold
are blocks like others. Time and memory are in proportion to a page, however it nests. Repeated rows and missing ids are
extracted each for itself. Other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm import common as C

EXTRACTED = "page_id long, url string, text string, n_chars long"
# How HTML treats its elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript "
    "object ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SILENT_TAGS = frozenset(
    "head script style template textarea select button iframe svg title".split()
)
#: Tags that an opening tag of the same set ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}}
_NAME = re.compile("[a-z]+")
#: Marked sections that the parser of the standard library knows.
_SECTION = re.compile(
    r"<!\[(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])", re.IGNORECASE | re.ASCII
)
#: Elements with names, from the text outwards, whose names are features.
NEAREST = 24
#: Steps of training, step size, and weight of the penalty on large weights.
STEPS, RATE, PENALTY = 150, 0.1, 0.02
LABELLED_PAGES = 600


class Context:
    """Where a text stands: the open elements, of which a block needs only this.

    It is made from the one around it without walking further out, so that pages may nest
    as deeply as they like.
    """

    __slots__ = ("depth", "tag", "tags", "path", "near", "label", "_names")

    def __init__(self) -> None:
        self.depth, self.tag, self.label = 0, "", None
        self.tags: frozenset[str] = frozenset()
        #: A number for the row of block-level tags.
        self.path = 0
        #: Names on the nearest elements that have any.
        self.near: tuple[frozenset[str], ...] = ()
        self._names: frozenset[str] | None = None

    def within(self, tag: str, names: frozenset[str], mark: int | None, paths: dict) -> Context:
        inner = Context()
        block = tag in BLOCK_TAGS
        inner.depth, inner.tag = self.depth + block, tag if block else self.tag
        inner.tags = self.tags if not block or tag in self.tags else self.tags | {tag}
        inner.path = paths.setdefault((self.path, tag), len(paths) + 1) if block else self.path
        inner.near = (*self.near[1 - NEAREST :], names) if names else self.near
        inner.label = self.label if mark is None else mark
        return inner

    @property
    def names(self) -> frozenset[str]:
        if self._names is None:
            self._names = frozenset().union(*self.near)
        return self._names


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    within: Context
    link_chars: int = 0

    @property
    def label(self) -> int | None:
        return self.within.label


class Blocks(HTMLParser):
    """Collects the blocks of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        #: Open elements: tag, and the context within.
        self.stack: list[tuple[str, Context]] = []
        self.outer = Context()
        self.paths: dict[tuple[int, str], int] = {}
        #: For each tag, the places in the stack where it is open.
        self.places: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.silent = self.links = self.link_chars = 0

    @property
    def within(self) -> Context:
        return self.stack[-1][1] if self.stack else self.outer

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.within, self.link_chars))
        self.parts, self.link_chars = [], 0

    def push(self, tag: str, names: frozenset[str], mark: int | None) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, self.within.within(tag, names, mark, self.paths)))
        self.silent += tag in SILENT_TAGS
        self.links += tag == "a"

    def pop(self, place: int) -> None:
        for tag, _ in reversed(self.stack[place:]):
            self.places[tag].pop()
            self.silent -= tag in SILENT_TAGS
            self.links -= tag == "a"
        del self.stack[place:]

    def innermost(self, tags: Iterable[str]) -> int:
        """Place of the innermost open tag of a set, or -1."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def find(self, tags: Iterable[str], stop: Iterable[str] = ()) -> int:
        """The same, but -1 too if a tag of ``stop`` lies further in."""
        place = self.innermost(tags)
        return place if place >= 0 and place >= self.innermost(stop) else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            place = self.find({"p"}, BLOCK_TAGS - {"p"})
            if place >= 0:
                self.pop(place)
            if tag in CLOSES:
                stop = frozenset({"ul", "ol", "dl", "table", "menu"})
                place = self.find(CLOSES[tag], stop)
                if place >= 0:
                    self.pop(place)
            if tag == "body" and self.places.get("head"):  # what an unclosed head would swallow
                self.pop(self.places["head"][0])
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        names, mark = [], None
        for key, value in attrs:
            if value and key in ("class", "id", "role"):
                names += _NAME.findall(re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())
            elif key == MARK and value:
                mark = int(value)
        self.push(tag, frozenset(names), mark)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # Only a picture and what is drawn in it end there.
        if tag != "svg" and self.find({"svg"}) < 0:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        place = self.find({tag}, frozenset() if tag in BLOCK_TAGS | SILENT_TAGS else BLOCK_TAGS)
        if place >= 0:
            self.pop(place)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """An unknown section is a comment up to the next ``>``; the parser would raise."""
        known = _SECTION.match(self.rawdata, i)
        return super().parse_marked_section(i, report) if known else self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data.strip())


def blocks(html: str) -> list[Block]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def features(page: Sequence[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    result = []
    for place, block in enumerate(page):
        text, n = block.text, len(block.text)
        n_words = text.count(" ") + 1
        share = block.link_chars / n
        lengths = sum(n_words >= k for k in (2, 4, 8, 16, 32, 64))
        found = ["bias", f"words:{lengths}", f"links:{(share > 0) + (share > 0.3) + (share > 0.8)}"]
        around = block.within
        found += [f"in:{tag}" for tag in around.tags]
        if around.depth:
            found.append(f"tag:{around.tag}")
        found += [f"name:{name}" for name in around.names]
        found.append(f"depth:{min(around.depth, 8)}")
        stops = sum(text.count(mark) for mark in ".!?")
        found.append(f"stops:{min(stops, 3)}")
        found.append("end:" + ("stop" if text[-1] in ".!?\"”»)" else "word" if text[-1].isalnum() else "mark"))
        if "©" in text or "(c)" in text.lower():
            found.append("copyright")
        if text.count(",") * 8 > n_words:
            found.append("commas")
        if place == 0:
            found.append("first")
        if place == len(page) - 1:
            found.append("last")
        before = page[place - 1].within if place else None
        if before is around or (before and before.path == around.path and before.names == around.names):
            found.append("same")
        result.append(found)
    return result


@dataclass
class Model:
    """Weights by feature for "main" against "rest", and scores of label pairs."""

    weight: dict[str, float] = field(default_factory=dict)
    pair: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def decode(self, page: Sequence[Block]) -> list[int]:
        """The best labels of all blocks together (Viterbi)."""
        get, pair = self.weight.get, self.pair
        back: list[tuple[int, int]] = []
        rest = main = 0.0
        for place, found in enumerate(features(page)):
            score = sum([get(name, 0.0) for name in found])
            if place:
                from_rest = rest + pair[0][0], rest + pair[0][1] + score
                from_main = main + pair[1][0], main + pair[1][1] + score
                back.append((int(from_main[0] > from_rest[0]), int(from_main[1] > from_rest[1])))
                rest, main = max(from_rest[0], from_main[0]), max(from_rest[1], from_main[1])
            else:
                main = score
        label = int(main > rest)
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1] if page else []

    def text(self, html: str) -> str:
        page = blocks(html)
        return "\n".join(b.text for b, label in zip(page, self.decode(page)) if label)


def fit(pages: Sequence[str]) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam over all pages at once.

    A page is a string of html in which the attribute ``data-main`` gives the label, 0 or
    1, of the blocks within.
    """
    cut = [blocks(html) for html in pages]
    cut = sorted((page for page in cut if page), key=len, reverse=True)
    found = [features(page) for page in cut]
    names = sorted({name for page in found for block in page for name in block})
    number = {name: i for i, name in enumerate(names)}
    longest, n_pages = len(cut[0]), len(cut)
    # Cells (page, place) in page order; entries are their features.
    cell = [(i, j) for i, page in enumerate(cut) for j in range(len(page))]
    entry_cell = np.repeat(np.arange(len(cell)), [len(b) for page in found for b in page])
    entry = np.array([number[name] for page in found for b in page for name in b])
    row, place = (np.array(c) for c in zip(*cell))
    truth = np.zeros((n_pages, longest), np.int64)
    truth[row, place] = [block.label or 0 for page in cut for block in page]
    size = np.array([len(page) for page in cut])
    live = np.array([int(np.count_nonzero(size > t)) for t in range(longest)])
    weight, pair = np.zeros(len(names)), np.zeros((2, 2))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (weight, pair)]
    pair_truth = np.zeros((2, 2))
    for t in range(1, longest):
        np.add.at(pair_truth, (truth[: live[t], t - 1], truth[: live[t], t]), 1)
    for step in range(1, STEPS + 1):
        score = np.zeros((n_pages, longest))
        score[row, place] = np.bincount(entry_cell, weight[entry], len(cell))
        both = np.stack([np.zeros_like(score), score], axis=2)
        alpha = np.zeros((longest, n_pages, 2))
        beta = np.zeros((longest, n_pages, 2))
        alpha[0] = both[:, 0]
        for t in range(1, longest):
            n = live[t]
            alpha[t, :n] = both[:n, t] + np.logaddexp.reduce(alpha[t - 1, :n, :, None] + pair, axis=1)
        for t in range(longest - 2, -1, -1):
            n = live[t + 1]
            ahead = both[:n, t + 1] + beta[t + 1, :n]
            beta[t, :n] = np.logaddexp.reduce(pair + ahead[:, None, :], axis=2)
        total = np.logaddexp.reduce(alpha[0] + beta[0], axis=1)
        main = np.exp(alpha[place, row, 1] + beta[place, row, 1] - total[row])
        expected = np.zeros((2, 2))
        for t in range(1, longest):
            n = live[t]
            joint = (alpha[t - 1, :n, :, None] + pair + (both[:n, t] + beta[t, :n])[:, None, :]
                     - total[:n, None, None])
            expected += np.exp(joint).sum(axis=0)
        error = (truth[row, place] - main)[entry_cell]
        slopes = (np.bincount(entry, error, len(names)) - PENALTY * n_pages * weight / 10,
                  pair_truth - expected - PENALTY * n_pages * pair / 10)
        for param, slope, (mean, square) in zip((weight, pair), slopes, state):
            slope = slope / n_pages
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            param += RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(names, weight.tolist())), tuple(map(tuple, pair.tolist())))


def main_texts(pages: DataFrame, model: Model) -> DataFrame:
    """The main text of every page."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.text(html) for html in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(found, pa.string()),
             pa.array(map(len, found), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("text"))
    return C.map_slices(rows, work, EXTRACTED)


#: Attribute by which a labelled page tells its main text.
MARK = "data-main"


def labelled_pages(n: int = LABELLED_PAGES, seed: int = 11) -> list[str]:
    """Pages in many layouts, made from a seed, with their main text marked."""
    return [_Layout(random.Random(f"{seed}/{i}")).page() for i in range(n)]


class _Layout:
    """Makes one page: surroundings in some order around one article."""

    # Names that pages give to parts of a page.
    NAMES = {
        "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar tabs toc".split(),
        "header": "header masthead banner site-header branding top logo".split(),
        "footer": "footer site-footer bottom copyright legal colophon".split(),
        "side": "sidebar side aside widget related recommended popular rail more-stories".split(),
        "notice": "cookie cookie-notice consent notice alert gdpr banner-message popup modal".split(),
        "advert": "ad ads advert advertisement sponsored promo ad-slot banner-ad sponsor".split(),
        "form": "search newsletter subscribe signup login contact-form".split(),
        "comments": "comments comment comment-list discussion replies responses disqus".split(),
        "share": "share social sharing tags meta byline author post-meta".split(),
        "article": "article content post entry story main-content post-body entry-content body-text "
        "article-body text".split(),
    }

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.ends = rng.choice([[""], [""], [""], ["###", "***", "%%%", "&&&"], ["!!"]])
        self.upper = rng.random() < 0.1
        letters = rng.choice(["aeinorst", "aeilnorstu", "aeéèiçnorstu", "aäeinörstüß", "aeíñorstó"])
        self.words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(80)]

    def prose(self, low: int, high: int, noisy: bool = False) -> str:
        rng, words = self.rng, []
        for _ in range(rng.randint(low, high)):
            word = rng.choice(self.words) + rng.choice(["", "", "", "", "", ",", "."])
            if noisy:
                word += rng.choice(self.ends)
                word = word.upper() if self.upper else word
            words.append(word)
        text = " ".join(words)
        return escape(text[:1].upper() + text[1:] + rng.choice([".", ".", ".", ""]), quote=False)

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{self.prose(low, high)}</a>'

    def named(self, tag: str, kind: str, inner: str, always: bool = False) -> str:
        name = ""
        if always or self.rng.random() < 0.75:
            name = f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(self.NAMES[kind])}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def menu(self) -> str:
        items = "".join(f"<li>{self.link(1, 3)}</li>" for _ in range(self.rng.randint(2, 8)))
        if self.rng.random() < 0.5:
            return self.named("nav", "menu", f"<ul>{items}</ul>", False)
        return self.named("div", "menu", f"<ul>{items}</ul>", True)

    def header(self) -> str:
        title = self.rng.choice(["h1", "h2", "div", "p"])
        inner = f"<{title}>{self.prose(1, 5)}</{title}>" + (self.menu() if self.rng.random() < 0.4 else "")
        return self.named(*self.rng.choice([("header", "header", inner), ("div", "header", inner, True)]))

    def footer(self) -> str:
        sign = self.rng.choice(["&copy; ", "&copy; 2024 ", "", "(c) "])
        inner = sign + self.prose(2, 14) + self.rng.choice(["", " &middot; " + self.prose(2, 12), "<br>" + self.link()])
        if self.rng.random() < 0.3:
            inner = f"<p>{inner}</p><ul><li>{self.link()}</li><li>{self.link()}</li></ul>"
        return self.named(*self.rng.choice([("footer", "footer", inner), ("div", "footer", inner, True)]))

    def side(self) -> str:
        inner = f"<h3>{self.prose(1, 4)}</h3>" + "".join(
            self.rng.choice([f"<li>{self.link(2, 9)}</li>", f"<p>{self.prose(4, 20)}</p>"])
            for _ in range(self.rng.randint(1, 5))
        )
        return self.named(*self.rng.choice([("aside", "side", inner), ("div", "side", inner, True)]))

    def notice(self) -> str:
        inner = self.prose(5, 40) + self.rng.choice(["", " " + self.link(), "<button>ok</button>"])
        return self.named(self.rng.choice(["div", "section", "p"]), "notice", inner, True)

    def advert(self) -> str:
        inner = self.rng.choice([self.prose(2, 40), f"<p>{self.prose(2, 25)}</p>", self.link(2, 12)])
        return self.named(self.rng.choice(["div", "div", "aside", "section"]), "advert", inner, True)

    def form(self) -> str:
        inner = f"<label>{self.prose(1, 5)}</label><input name=q><p>{self.prose(2, 15)}</p><button>go</button>"
        return self.named("form", "form", inner)

    def comments(self) -> str:
        inner = f"<h3>{self.prose(1, 3)}</h3>" + "".join(
            self.rng.choice(["<li>{}</li>", "<p>{}</p>", "<div class=comment><b>{}</b><p>{}</p></div>"]).format(
                self.prose(3, 60, True), self.prose(3, 40, True)
            )
            for _ in range(self.rng.randint(1, 5))
        )
        return self.named(self.rng.choice(["section", "div", "ol"]), "comments", inner, True)

    def share(self) -> str:
        return self.named(self.rng.choice(["div", "p", "ul"]), "share", self.prose(1, 5) + " " + self.link(), True)

    def paragraphs(self) -> str:
        rng, parts = self.rng, []
        for number in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            text = self.prose(*rng.choice([(1, 3), (2, 12), (10, 60), (30, 150)]), True)
            if rng.random() < 0.15:
                text += " " + self.link() + " " + self.prose(3, 20, True)
            kind = rng.random()
            if number and kind < 0.08:
                parts.append(f"<h2>{self.prose(1, 8, True)}</h2>")
            if kind < 0.72:
                parts.append(f"<p>{text}</p>")
            elif kind < 0.8:
                parts.append(f"<p><b>{text}<br>" if rng.random() < 0.7 else f"<p>{text}")
            elif kind < 0.86:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.92:
                items = "".join(f"<li>{self.prose(2, 25, True)}</li>" for _ in range(rng.randint(2, 5)))
                parts.append(f"<ul>{items}</ul>")
            elif kind < 0.96:
                parts.append(f"<div>{text}</div>")
            else:
                parts.append(f"<table><tr><td>{self.prose(1, 9, True)}</td><td>{text}</td></tr></table>")
            if rng.random() < 0.05:
                parts.append(self.outside(self.advert()))
        return "".join(parts)

    @staticmethod
    def outside(part: str) -> str:
        return f"<div {MARK}=0>{part}</div>"

    def article(self) -> str:
        rng = self.rng
        head = f"<{rng.choice(['h1', 'h1', 'h2'])}>{self.prose(1, 12, True)}</h1>" if rng.random() < 0.85 else ""
        head = head.replace("</h1>", "</h2>") if head.startswith("<h2") else head
        if rng.random() < 0.2:
            head += self.outside(self.share())
        body = head + self.paragraphs()
        if rng.random() < 0.2:
            body += self.outside(rng.choice([self.share, self.side, self.comments, self.form])())
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        name = ""
        if tag in ("div", "section") or rng.random() < 0.3:
            name = f' {rng.choice(["class", "id"])}="{rng.choice(self.NAMES["article"])}"'
        inner = f"<{tag}{name} {MARK}=1>{body}</{tag}>"
        return f"<main>{inner}</main>" if rng.random() < 0.2 else inner

    def page(self) -> str:
        rng = self.rng
        before = [part() for part in (self.notice, self.header, self.menu, self.advert, self.form, self.side)
                  if rng.random() < 0.4]
        after = [part() for part in (self.advert, self.side, self.comments, self.form, self.share, self.notice)
                 if rng.random() < 0.3]
        rng.shuffle(before)
        rng.shuffle(after)
        if rng.random() < 0.85:
            after.append(self.footer())
        inner = "".join(before) + self.article() + "".join(after)
        if rng.random() < 0.3:
            inner = f"<div id={rng.choice(['page', 'wrapper', 'container'])}>{inner}</div>"
        title = self.prose(1, 9)
        return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head>"
                f"<body {MARK}=0>{inner}</body></html>")  # fmt: skip
