"""HTML extraction: pages to text blocks, and a recurrent labeller that tells article blocks from the rest."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parselab.llm.common import mapped, texts

PATH_SIZE, WORD_SIZE, OTHER = 256, 64, 9
INPUT = PATH_SIZE + WORD_SIZE + OTHER
PATHS_HELD = 50_000  # looked at before each group of pages
GROUP = 100

TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*>)""",
    re.DOTALL,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("head script style noscript template textarea title iframe noframes noembed svg object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
CLOSES = {  # a start tag closes these, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Paths:
    """Tag paths as numbers, each with a vector that counts the hashed names of its tags, classes, ids and roles."""

    def __init__(self):
        self.known: dict[tuple[int, str, str], int] = {}
        self.vectors = [np.zeros(PATH_SIZE, np.float32)]

    def child(self, parent: int, tag: str, attributes: str) -> int:
        named = "" if tag in ("html", "body") else " ".join(
            f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in NAMED.finditer(attributes)
        )
        found = self.known.get((parent, tag, named))
        if found is None:
            vector = self.vectors[parent] * np.float32(0.9)
            vector[_bucket(tag, PATH_SIZE)] += 1
            for value in named.split():
                for part in PARTS.findall(value.partition("=")[2] or value):
                    vector[_bucket("." + part.lower(), PATH_SIZE)] += 1
            found = self.known[parent, tag, named] = len(self.vectors)
            self.vectors.append(vector)
        return found


def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = _bucket(word.lower(), WORD_SIZE)
        return found


@dataclass
class Block:
    path: int
    tag: str
    text: str
    linked: float


@dataclass
class _Open:
    """Elements that are open, and the block that is being read."""

    stack: list[tuple[str, int]] = field(default_factory=lambda: [("", 0)])
    count: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    path: tuple[str, int] = ("", 0)

    def cut(self, to: int) -> None:
        for tag, _ in self.stack[to:]:
            self.count[tag] -= 1
        del self.stack[to:]

    def close(self, tags: set[str], within: set[str] | frozenset[str] = frozenset(), inline: bool = False) -> None:
        """Close the nearest of ``tags``; the search ends at ``within``, or at the nearest block element."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in tags:
                self.cut(i)
                return
            if tag in within or (inline and tag not in INLINE):
                return


def blocks(page: str, paths: Paths) -> list[Block]:
    """The blocks with text, in page order.

    A block is the text between two tags that are not inline. Tags of the head, scripts, styles, templates and the like are
    passed over with what they hold, to the end of the page if they are not closed. Character references are decoded,
    white space (a line break tag counts as such) becomes one space, ends are trimmed.
    """
    out: list[Block] = []
    state = _Open()

    def read(piece: str) -> None:
        if not piece or piece.isspace():
            if state.pieces:
                state.pieces.append(" ")
            return
        if not state.pieces:
            block = next((t for t, _ in reversed(state.stack) if t not in INLINE), "")
            state.path = block, state.stack[-1][1]
        state.pieces.append(html.unescape(piece) if "&" in piece else piece)
        if state.count["a"] > 0:
            state.linked += len(piece)

    def end_block() -> None:
        if state.pieces:
            text = " ".join("".join(state.pieces).split())
            if text:
                out.append(Block(state.path[1], state.path[0], text, min(1.0, state.linked / len(text))))
            state.pieces, state.linked = [], 0

    at = 0
    while m := TAG.search(page, at):
        if m.start() > at:
            read(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or ""
        if not tag:
            continue
        if tag not in INLINE:
            end_block()
        if closing:
            if tag not in VOID:
                state.close({tag}, inline=tag in INLINE)
            continue
        if tag in UNREAD and not attributes.endswith("/"):
            done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.IGNORECASE)
            end = done.search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if state.pieces and tag in ("br", "wbr", "img"):
                state.pieces.append(" " if tag == "br" else "")
            continue
        if tag in CLOSES:
            state.close(*CLOSES[tag])
        elif tag not in INLINE:
            state.close({"p"}, inline=True)
        if attributes.endswith("/") and tag not in INLINE:
            continue
        state.stack.append((tag, paths.child(state.stack[-1][1], tag, attributes)))
        state.count[tag] += 1
    read(page[at:])
    end_block()
    return out


def features(found: list[Block], paths: Paths, buckets: dict[str, int], first: int = 0, whole: int = 0) -> np.ndarray:
    """A row per block: its path, its words by hashed counts, its length, links, punctuation and place.

    ``found`` may be a part of the ``whole`` number of blocks of a page, from the ``first`` on.
    """
    rows = np.zeros((len(found), INPUT), np.float32)
    whole = whole or len(found)
    for i, block in enumerate(found):
        words = block.text.split()
        n = len(words)
        rows[i, :PATH_SIZE] = paths.vectors[block.path]
        counts = np.bincount([buckets[w] for w in words], minlength=WORD_SIZE)
        rows[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / np.sqrt(n)
        text = block.text
        rows[i, PATH_SIZE + WORD_SIZE :] = (
            np.log1p(n) / 3, block.linked, text[-1] in ".!?:;。", min(3, text.count(",")) / 3,
            sum(map(text.count, "0123456789")) / len(text), block.tag[:1] == "h" and block.tag[1:].isdigit(),
            (first + i) / whole, (whole - first - i) / whole, 1.0,
        )
    return rows


# The network. Weights by name: input and recurrent weights of the four gates (in, forget, out, new) in both directions.


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def direction(
    x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, keep: list | None = None, state: list | None = None
) -> np.ndarray:
    """Hidden states (time, page, hidden) of one direction; padded steps leave the state as it is.

    ``keep`` gets what a step needs for its gradient; ``state`` is where the direction begins (empty: zeros) and gets where it ends.
    """
    hidden = u.shape[0]
    steps = x @ w
    h = np.zeros((x.shape[1], hidden), x.dtype)
    c = np.zeros_like(h)
    if state:
        h, c = state
    out = np.zeros((*x.shape[:2], hidden), x.dtype)
    for t in range(x.shape[0]):
        z = steps[t] + h @ u
        gates, new = _sigmoid(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        m = mask[t][:, None]
        c_next = m * (f * c + i * new) + (1 - m) * c
        bent = np.tanh(c_next)
        h_next = m * (o * bent) + (1 - m) * h
        if keep is not None:
            keep.append((h, c, i, f, o, new, bent, m))
        h, c = h_next, c_next
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out


def probabilities(x: np.ndarray, mask: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """(time, page): the probability that a block belongs to the article."""
    ahead = direction(x, mask, weights["w_ahead"], weights["u_ahead"])
    back = direction(x[::-1], mask[::-1], weights["w_back"], weights["u_back"])[::-1]
    return _sigmoid(np.concatenate((ahead, back, x), axis=2) @ weights["out"] + weights["bias"])[:, :, 0]


def long_page(found: list[Block], weights: dict[str, np.ndarray], paths: Paths, buckets: dict[str, int], part: int) -> np.ndarray:
    """The probabilities of one page's blocks, with the features of ``part`` blocks at a time: the states go on from part to part."""
    hidden = weights["u_ahead"].shape[0]
    of_ahead, of_back, of_x = np.split(weights["out"][:, 0], (hidden, 2 * hidden))
    sums = np.full(len(found), weights["bias"][0], np.float32)
    starts = range(0, len(found), part)
    for way, own, order in (("ahead", of_ahead, starts), ("back", of_back, reversed(starts))):
        state: list[np.ndarray] = []
        for at in order:
            x = features(found[at : at + part], paths, buckets, at, len(found))[:, None]
            step = 1 if way == "ahead" else -1
            made = direction(x[::step], np.ones(x.shape[:2], np.float32), weights[f"w_{way}"], weights[f"u_{way}"], state=state)[::step]
            sums[at : at + part] += made[:, 0] @ own + (x[:, 0] @ of_x if way == "ahead" else 0)
    return _sigmoid(sums)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of several pages as (time, page, input), and a mask (time, page)."""
    longest = max(map(len, rows))
    x = np.zeros((longest, len(rows), INPUT), np.float32)
    mask = np.zeros((longest, len(rows)), np.float32)
    for k, row in enumerate(rows):
        x[: len(row), k] = row
        mask[: len(row), k] = 1
    return x, mask


@cache
def trained() -> dict[str, np.ndarray]:
    """The weights that ``html_train`` has made."""
    with resources.files(__package__).joinpath("html_weights.npz").open("rb") as file, np.load(file) as stored:
        return {name: stored[name].astype(np.float32) for name in stored}


def article_texts(pages: list[str], weights: dict[str, np.ndarray], paths: Paths, cells: int = 20_000) -> list[str]:
    """The main text of each page: the blocks labelled as article, joined by line ends.

    Pages go through the network in groups of about equal length and at most ``cells`` blocks; a longer page goes alone, in parts.
    """
    buckets = _Buckets()
    out = [""] * len(pages)
    found: dict[int, list[Block]] = {}

    def label(group: list[int]) -> None:
        x, mask = padded([features(found[k], paths, buckets) for k in group])
        chance = probabilities(x, mask, weights)
        for column, k in enumerate(group):
            out[k] = "\n".join(b.text for t, b in enumerate(found[k]) if chance[t, column] >= 0.5)

    for k, page in enumerate(pages):
        if made := blocks(page, paths):
            found[k] = made
    group: list[int] = []
    for k in sorted(found, key=lambda k: len(found[k])):
        if len(found[k]) > cells:
            chances = long_page(found[k], weights, paths, buckets, cells)
            out[k] = "\n".join(b.text for b, chance in zip(found[k], chances.tolist(), strict=True) if chance >= 0.5)
            continue
        if group and len(found[k]) * (len(group) + 1) > cells:
            label(group)
            group = []
        group.append(k)
    if group:
        label(group)
    return out


_PATHS: list[Paths] = []


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    A null or empty page, and one without article blocks, has an empty text. Pages are read one by one and whole; repeated
    rows give repeated rows, an empty table none; other columns are not read.
    """
    weights = trained()

    def per_batch(part: pa.RecordBatch) -> dict:
        made: list[str] = []
        pages = texts(part, "html")
        for at in range(0, len(pages), GROUP):
            if not _PATHS or len(_PATHS[0].vectors) > PATHS_HELD:
                _PATHS[:] = [Paths()]
            made += article_texts(pages[at : at + GROUP], weights, _PATHS[0])
        return {
            "page_id": part.column("page_id"),
            "url": part.column("url"),
            "text": made,
            "n_chars": [len(t) for t in made],
        }

    read = df.selectExpr(f"cast(`{key}` AS bigint) AS page_id", f"`{url}` AS url", f"`{html}` AS html")
    return mapped(read, per_batch, "page_id bigint, url string, text string, n_chars bigint")
