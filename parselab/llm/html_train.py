"""Trains the block labeller on generated pages: ``python -m parselab.llm.html_train`` writes its weights.

Pages are put together from menus, headers, footers, sidebars, notices, adverts, forms, reader comments and articles, in
changing markup and with invented words, so that the text itself says little and the markup, the lengths and the
neighbours must decide. The number of pages (``PAGES``) bounds the work.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from parselab.llm import html_blocks as net

PAGES = 10000
MARK = ""  # put before article text in generated pages
SYLLABLES = [
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "en er ch ei ie un sch ge be ver au ein lich keit heit ung über ä ö ü ß".split(),
    "ou ai eau eux tion ment qu é è re le la des en on pa vi".split(),
    "ción os as es ar ue el do mente que ó ñ ll rr ez ja bo".split(),
    "ka no shi ta mu ra ro be to ne sa yu".split(),
]
SAID = {
    "menu": "Home About Contact News Sports Login Archive Help Search Products Services Blog".split(),
    "ad": "Advertisement Sponsored Buy now Save today Free offer Shop Deal".split(),
    "notice": "We use cookies Accept privacy policy Subscribe newsletter consent Agree terms".split(),
    "form": "Name Email Password Search Submit Sign up Message Your".split(),
    "footer": "Copyright © All rights reserved Privacy Terms Contact 2024 Inc".split(),
    "comment": "Reply says ago Like Report thanks agree great post Posted by".split(),
    "sidebar": "Related Popular Trending Recent posts Tags Follow us Most read More".split(),
}
NAMES = {
    "menu": "nav menu navigation navbar main-menu topnav breadcrumb breadcrumbs site-nav tabs links".split(),
    "header": "header masthead top site-header banner-top branding logo topbar page-header".split(),
    "footer": "footer site-footer bottom colophon page-footer copyright legal".split(),
    "sidebar": "sidebar aside widget related side rail trending popular recent tags share social widget-area".split(),
    "notice": "cookie-notice cookie notice alert gdpr consent newsletter popup modal banner subscribe message".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot adbox banner-ad google-ad".split(),
    "form": "form search-form login signup contact-form searchbox subscribe-form".split(),
    "comment": "comments comment comment-list responses discussion disqus reply-list reader-comments".split(),
    "article": "content article post entry entry-content article-body story post-content main-content text body-text".split(),
    "plain": "wrapper container row col inner page box section wrap grid block".split(),
}


class Pages:
    """Generated pages; article text starts with ``MARK`` in every block."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(self.tongue) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        made = [self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(made).capitalize()

    def site(self) -> str:
        return self.r.choice((self.word(), f"{self.word()}.example.com", f"{self.word()}.{self.word()}.org"))

    def prose(self, most: int = 6) -> str:
        ends = ".", ".", ".", "!", "?"
        said = [self.words(1, 22).replace(" ", ", ", self.r.random() < 0.4) + self.r.choice(ends) for _ in range(self.r.randint(1, most))]
        return self._dressed(" ".join(said))

    def _dressed(self, text: str) -> str:
        if self.r.random() < 0.15:
            text = text.replace(" ", " &amp; ", 1)
        odd = self.r.random()
        if odd < 0.1:
            text = text.replace(" ", self.r.choice((" ### ", "*** ", "!! ", " | ", "&amp;&amp;&amp; ", "%%% ", "$$$ ")))
        elif odd < 0.15:
            text = text.upper()
        if self.r.random() < 0.15:
            cut = text.split(" ")
            at = self.r.randrange(len(cut))
            cut[at] = f'<a href="/{cut[at]}">{cut[at]}</a>'
            text = " ".join(cut)
        return text

    def short(self, kind: str) -> str:
        r = self.r.random()
        if r < 0.3:
            return self.words(1, 3)
        if r < 0.65:
            return " ".join(self.r.sample(SAID[kind], self.r.randint(1, 4)))
        return self.prose(2)

    def named(self, kind: str) -> str:
        r = self.r.random()
        name = self.r.choice(NAMES[kind])
        if r < 0.2:
            name += "-" + self.word()
        if r > 0.85:
            name = self.r.choice(NAMES["plain"]) + " " + name
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def noise(self) -> str:
        r = self.r.random()
        if r < 0.4:
            return ""
        name = self.r.choice(NAMES["plain"]) if r < 0.75 else self.word()
        return f' class="{name}"'

    def opened(self, kind: str, tags: tuple[str, ...]) -> tuple[str, str]:
        """Start and end tag of a part: a tag that says what it is, or a division that is named."""
        tag = self.r.choice((*tags, "div", "section"))
        says = tag in tags and self.r.random() < 0.6
        return f"<{tag}{self.noise() if says else self.named(kind)}>", f"</{tag}>"

    def listed(self, said, low: int = 2, high: int = 8) -> str:
        link = self.r.random() < 0.8
        rows = "".join(f'<li>{f"<a href=/x>{said()}</a>" if link else said()}</li>' for _ in range(self.r.randint(low, high)))
        return f"<ul{self.noise()}>{rows}</ul>"

    def menu(self) -> str:
        a, z = self.opened("menu", ("nav",))
        return a + self.listed(lambda: self.r.choice((self.words(1, 2), self.r.choice(SAID["menu"])))) + z

    def header(self) -> str:
        a, z = self.opened("header", ("header",))
        inside = [f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 9)}</p>", f"<a href=/>{self.words(1, 3)}</a>", self.menu(), self.form()]
        return a + "".join(self.r.sample(inside, self.r.randint(1, 3))) + z

    def footer(self) -> str:
        a, z = self.opened("footer", ("footer",))
        inside = [self.short("footer"), f"<p>{self.short('footer')}</p>", f"&copy; {self.site()} &middot; {self.prose(1)}", f"&copy; {self.site()} {self.prose(2)}", self.prose(2), self.listed(lambda: self.short("menu"), 1, 5)]
        return a + "".join(self.r.sample(inside, self.r.randint(1, 3))) + z

    def advert(self) -> str:
        a, z = self.opened("ad", ("div",))
        a = f"<div{self.named('ad')}>" if a.startswith("<div") and "ad" not in a else a
        inside = self.r.choice((self.prose(3), f"<p>{self.prose(3)}</p>", f"<a href=/ad>{self.short('ad')}</a>", f"<h3>{self.words(2, 6)}</h3><p>{self.short('ad')}</p>"))
        return f"<!-- ad {self.word()} -->" * (self.r.random() < 0.3) + a + inside + z

    def notice(self) -> str:
        a, z = f"<div{self.named('notice')}>", "</div>"
        return a + f"<p>{self.short('notice')}</p>" + f"<button>{self.words(1, 2)}</button>" * (self.r.random() < 0.5) + z

    def form(self) -> str:
        rows = "".join(
            f'<{t}>{self.r.choice((self.short("form"), self.words(1, 3)))}</{t}>' for t in self.r.choices(("label", "p", "button", "option", "legend", "div"), k=self.r.randint(1, 5))
        )
        return f"<form{self.noise()}>{rows}</form>" if self.r.random() < 0.8 else f"<div{self.named('form')}>{rows}</div>"

    def sidebar(self) -> str:
        a, z = self.opened("sidebar", ("aside",))
        inside = [f"<h3>{self.r.choice((self.short('sidebar'), self.words(1, 4)))}</h3>", f"<p>{self.prose(3)}</p>", self.listed(lambda: self.r.choice((self.words(3, 9), self.short("sidebar")))), self.advert()]
        return a + "".join(self.r.choices(inside, k=self.r.randint(1, 4))) + z

    def comments(self) -> str:
        a, z = self.opened("comment", ())
        tag = self.r.choice(("article", "li", "div", "p"))
        rows = ""
        for _ in range(self.r.randint(1, 6)):
            text = self.prose(3) if self.r.random() < 0.9 else self.short("comment")
            body = text if tag == "p" else f"<p>{text}</p>"
            author = f"<b>{self.words(1, 2)}</b> " if self.r.random() < 0.4 else f"<h4>{self.words(1, 2)}</h4>" * (tag != "p" and self.r.random() < 0.5)
            rows += f'<{tag}{self.r.choice((self.named("comment"), self.noise()))}>{author}{body}</{tag}>'
        return a + f"<h3>{self.short('comment')}</h3>" * (self.r.random() < 0.6) + rows + (self.form() if self.r.random() < 0.4 else "") + z

    def paragraph(self) -> str:
        r, text = self.r.random(), MARK + self.prose(1 if self.r.random() < 0.2 else 9)
        odd = self.r.random()
        if odd < 0.04:
            text = MARK + " ".join([self.word()] * self.r.randint(5, 60))
        elif odd < 0.08:
            text = MARK + self.word().capitalize() + self.r.choice((".", "", ","))
        if r < 0.12:
            return f"<p><b>{text}<br>"  # not closed
        if r < 0.17:
            return f"<h2>{MARK}{self.words(1, 9)}</h2>"
        if r < 0.22:
            return f"<ul>{''.join(f'<li>{MARK}{self.prose(1)}</li>' for _ in range(self.r.randint(2, 5)))}</ul>"
        if r < 0.25:
            return f"<blockquote>{text}</blockquote>"
        if r < 0.28:
            cells = "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.word()}</td></tr>" for _ in range(3))
            return f"<table>{cells}</table>"
        if r < 0.30:
            return f"<figure><img src=x><figcaption>{MARK}{self.words(3, 9)}</figcaption></figure>"
        if r < 0.32:
            return f"<pre>{MARK}{self.words(3, 20)}</pre>"
        if r < 0.36:
            return f"<div>{text}</div>"
        return f"<p{self.noise() if r < 0.45 else ''}>{text}" + "</p>" * (r < 0.97)

    def article(self) -> str:
        says = self.r.random()
        if says < 0.5:
            tag = self.r.choice(("article", "article", "main"))
            a, z = f"<{tag}{self.r.choice((self.noise(), self.named('article')))}>", f"</{tag}>"
        elif says < 0.9:
            a, z = f"<div{self.named('article')}>", "</div>"
        else:
            a, z = f"<div{self.noise()}>", "</div>"
        title = f"<h1>{MARK}{self.words(1, 12)}</h1>"
        if self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [title] if self.r.random() < 0.8 else []
        other = (self.advert, self.sidebar, self.notice, self.form, self.menu, self.comments)
        for _ in range(self.r.choice((1, 2, 4, 8, 14, 22))):
            parts.append(self.paragraph())
            if self.r.random() < 0.05:
                parts.append(self.r.choice(other)())
        return a + "".join(parts) + z

    def wrapped(self, parts: list[str], article: int) -> str:
        """The parts of a page; some pages have a form around all or around the article, or an element that is left open before it."""
        r = self.r.random()
        if r < 0.09:
            return f"<form method=post action={self.word()}.aspx{self.noise()}>{''.join(parts)}</form>"
        if r < 0.18:
            parts[article] = f"<form{self.r.choice((self.noise(), self.named('article')))}>{parts[article]}</form>"
        elif r < 0.22:
            parts.insert(article, f"<{self.r.choice(('nav', 'aside'))}{self.noise()}><a href=/>{self.words(1, 2)}</a>")
        elif r < 0.25:
            cells = "".join(f"<td{self.noise()}>{part}</td>" for part in parts if part)
            return f"<table><tr>{cells}</tr></table>"
        return "".join(parts)

    def page(self) -> str:
        self.tongue = self.r.choice(SYLLABLES)
        before = [p() for p in (self.header, self.menu, self.notice, self.advert, self.sidebar) if self.r.random() < 0.4]
        after = [p() for p in (self.sidebar, self.comments, self.advert, self.notice, self.form) if self.r.random() < 0.35]
        self.r.shuffle(before)
        self.r.shuffle(after)
        parts = [*before, self.article(), *after, self.footer() * (self.r.random() < 0.8)]
        if self.r.random() < 0.12:  # unnamed links to other stories
            parts.insert(-1, f"<div{self.noise()}>{f'<h3>{self.words(1, 4)}</h3>' * (self.r.random() < 0.7)}{self.listed(lambda: self.words(3, 9), 3, 8)}</div>")
        body = self.wrapped(parts, len(before))
        if self.r.random() < 0.4:
            body = f"<div{self.noise()}>{body}</div>"
        end = "</body></html>" * (self.r.random() < 0.8)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{body}{end}"


def labelled(pages: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of each page with blocks."""
    paths, buckets, out = net.Paths(), net._Buckets(), []
    for page in pages:
        found = net.blocks(page, paths)
        labels = np.array([MARK in b.text for b in found], np.float32)
        for block in found:
            block.text = " ".join(block.text.replace(MARK, " ").split()) or "."
        if found:
            out.append((net.features(found, paths, buckets), labels))
    return out


def _back(x, mask, w, u, kept, grad):
    """Gradients of one direction's weights from those of its hidden states."""
    hidden = u.shape[0]
    d_z = np.zeros((*x.shape[:2], 4 * hidden), x.dtype)
    d_u = np.zeros_like(u)
    d_h = np.zeros((x.shape[1], hidden), x.dtype)
    d_c = np.zeros_like(d_h)
    for t in range(x.shape[0] - 1, -1, -1):
        h, c, i, f, o, new, bent, m = kept[t]
        d_h = d_h + grad[t]
        d_now, d_cell = d_h * m, d_c * m
        d_cell = d_cell + d_now * o * (1 - bent**2)
        z = np.concatenate((d_cell * new * i * (1 - i), d_cell * c * f * (1 - f), d_now * bent * o * (1 - o), d_cell * i * (1 - new**2)), axis=1)
        d_z[t] = z
        d_u += h.T @ z
        d_h = z @ u.T + d_h * (1 - m)
        d_c = d_cell * f + d_c * (1 - m)
    return np.tensordot(x, d_z, axes=((0, 1), (0, 1))), d_u


def gradients(x, mask, labels, weights):
    """(loss, gradients) of the mean cross entropy of a batch."""
    kept_a, kept_b = [], []
    ahead = net.direction(x, mask, weights["w_ahead"], weights["u_ahead"], kept_a)
    back = net.direction(x[::-1], mask[::-1], weights["w_back"], weights["u_back"], kept_b)[::-1]
    joined = np.concatenate((ahead, back, x), axis=2)
    chance = net._sigmoid(joined @ weights["out"] + weights["bias"])[:, :, 0]
    n = mask.sum()
    loss = -(mask * (labels * np.log(chance + 1e-7) + (1 - labels) * np.log(1 - chance + 1e-7))).sum() / n
    d_out = (mask * (chance - labels) / n)[:, :, None].astype(x.dtype)
    hidden = weights["u_ahead"].shape[0]
    d_joined = d_out @ weights["out"].T
    w_a, u_a = _back(x, mask, weights["w_ahead"], weights["u_ahead"], kept_a, d_joined[:, :, :hidden])
    w_b, u_b = _back(x[::-1], mask[::-1], weights["w_back"], weights["u_back"], kept_b, d_joined[::-1, :, hidden : 2 * hidden])
    return loss, {
        "w_ahead": w_a, "u_ahead": u_a, "w_back": w_b, "u_back": u_b,
        "out": np.tensordot(joined, d_out, axes=((0, 1), (0, 1))), "bias": d_out.sum(axis=(0, 1)),
    }


def start(hidden: int, seed: int, dtype=np.float32) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)

    def some(*shape):
        return (g.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(dtype)

    return {
        "w_ahead": some(net.INPUT, 4 * hidden), "u_ahead": some(hidden, 4 * hidden),
        "w_back": some(net.INPUT, 4 * hidden), "u_back": some(hidden, 4 * hidden),
        "out": some(2 * hidden + net.INPUT, 1), "bias": np.zeros(1, dtype),
    }


def train(data, hidden: int = 24, rounds: int = 7, batch: int = 48, rate: float = 0.004, seed: int = 3) -> dict[str, np.ndarray]:
    """Adam over batches of pages of about equal length."""
    weights = start(hidden, seed)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    g, step = np.random.default_rng(seed), 0
    order = sorted(range(len(data)), key=lambda k: len(data[k][1]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    total = rounds * len(batches)
    for _ in range(rounds):
        for b in g.permutation(len(batches)):
            rows = [data[k] for k in batches[b]]
            x, mask = net.padded([r for r, _ in rows])
            x[:, g.random(len(rows)) < 0.4, net.PATH_SIZE : net.PATH_SIZE + net.WORD_SIZE] = 0  # words say little
            labels = np.zeros(mask.shape, np.float32)
            for k, (_, own) in enumerate(rows):
                labels[: len(own), k] = own
            _, grads = gradients(x, mask, labels, weights)
            step += 1
            norm = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
            pace = rate * (1 - step / (total + 1))
            for k, v in grads.items():
                v = v * min(1.0, 1 / norm)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                weights[k] = weights[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                weights[k] = weights[k].astype(np.float32)
    return weights


def accuracy(data, weights) -> tuple[float, float]:
    """Share of blocks and of whole pages labelled right."""
    right = total = pages = 0
    for rows, labels in data:
        x, mask = net.padded([rows])
        same = (net.probabilities(x, mask, weights)[:, 0] >= 0.5) == (labels > 0.5)
        right, total, pages = right + int(same.sum()), total + len(labels), pages + bool(same.all())
    return right / total, pages / len(data)


def generated(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    made = Pages(seed)
    return labelled([made.page() for _ in range(n)])


if __name__ == "__main__":
    made = train(generated(PAGES, 1))
    print("held out:", accuracy(generated(1000, 2), made))
    target = Path(net.__file__).with_name("html_weights.npz")
    np.savez_compressed(target, **{k: v.astype(np.float16) for k, v in made.items()})
