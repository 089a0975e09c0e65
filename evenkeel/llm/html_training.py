"""Training of the HTML block labeller: ``python -m evenkeel.llm.html_training`` writes its weights.

Pages are made up: an article in one of many containers, and boilerplate of many kinds around and inside it. Words are
invented in the same way for both, so that structure, names and neighbours have to tell them apart. Content carries a
private-use character while a page is read, which gives each block its label.
"""

from __future__ import annotations

import random

import numpy as np

from evenkeel.llm.html_blocks import INPUT, TAG_SIZE, WEIGHTS, Block, blocks, vectors

MARK = ""
HIDDEN, ROUNDS, BATCH, PAGES, SEED = 24, 9, 64, 7000, 20

SYLLABLES = (
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve",
    "en er ch ei te in ge un nd ie sch be ung lich keit ver ü ä ö ß der zu ein st aus mit",
    "é è ou eau le de re en tion ment ai on qu es eux la ch ier an pa vi oi ê ç aux elle",
    "ó í ñ ción de os as la en el ar do ta ra ue ie mente ll rr es ado co mi bo ja ga ci",
    "а о е и н т с р в л к м д п у",
)
CONTENT_NAMES = ("content", "post", "entry", "entry-content", "post-body", "article-body", "story", "story-body", "main-content", "text", "body", "page-content", "article", "prose", "blog-post", "news-text")
ODD_NAMES = ("wrapper", "container", "row", "col", "inner", "box", "section", "block", "grid", "layout", "c1", "x", "region", "panel")


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.language = self.r.choice(SYLLABLES).split()
        self.common = [self.word() for _ in range(12)]

    def pick(self, *of):
        return self.r.choice(of)

    def word(self) -> str:
        return "".join(self.r.choice(self.language) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.common) if self.r.random() < 0.4 else self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        out = self.words(1, 16).capitalize()
        if self.r.random() < 0.3:
            out = out.replace(" ", ", ", 1)
        return out + self.pick(".", ".", ".", "?", "!")

    def prose(self, low: int = 1, high: int = 6) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.08:
            out = " ".join(w + self.pick("###", "***", "&amp;&amp;&amp;", "$$$", "!!", " |") for w in out.split())
        if self.r.random() < 0.05:
            out = out.upper()
        if self.r.random() < 0.06:
            out = " ".join(w for w in out.split() for _ in range(self.r.randint(3, 14)))
        if self.r.random() < 0.06:
            out += " " + " ".join(self.pick(self.number(), self.word()) for _ in range(self.r.randint(1, 12)))
        if self.r.random() < 0.04:
            out = self.pick("Licensed under ", "Released under ", "Contact: ", "Source: ", "Copyright ") + self.words(1, 5) + self.pick(".", " 2.0.", " " + self.number())
        if self.r.random() < 0.2:
            out = out.replace(" ", self.pick("\n", "  ", "&nbsp;", " <em>", " <b>"), 1)
        if self.r.random() < 0.15:
            out = out.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
        return out

    def number(self) -> str:
        return self.pick(lambda: str(self.r.randint(0, 10**9)), lambda: ".".join(str(self.r.randint(0, 255)) for _ in range(4)), lambda: f"+1 ({self.r.randint(200, 999)}) 555-{self.r.randint(1000, 9999)}", lambda: f"{self.word()}@{self.word()}.example")()

    def name(self, *of: str) -> str:
        value = self.r.choice(of)
        if self.r.random() < 0.3:
            value = self.pick("site-", "page-", "main-", "m-", "js-") + value
        if self.r.random() < 0.3:
            value += self.pick("-wrap", "-box", " clearfix", "-list", "-inner", " " + self.word())
        return f' {self.pick("class", "class", "class", "id", "role")}="{value}"'

    def element(self, tag: str, inside: str, attributes: str = "") -> str:
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        said = [self.pick("Home", "About", "Contact", "Privacy", "Terms", "Login", "RSS", "News") if self.r.random() < 0.2 else self.words(1, 4) for _ in range(self.r.randint(low, high))]
        anchors = [f'<a href="/{self.word()}">{s}</a>' for s in said]
        form = self.r.random()
        if form < 0.6:
            return self.element(self.pick("ul", "ul", "ol"), "".join(f"<li>{a}{self.pick('</li>', '</li>', '')}" for a in anchors))
        return self.pick(" ", " | ", "", " · ").join(anchors) if form < 0.85 else "".join(f"<div>{a}</div>" for a in anchors)

    # boilerplate

    def menu(self) -> str:
        inside = self.links(3, 10)
        return self.element("nav", inside, self.name("menu", "nav") if self.r.random() < 0.4 else "") if self.r.random() < 0.6 else self.element("div", inside, self.name("nav", "menu", "navbar", "navigation", "topbar", "breadcrumb", "breadcrumbs", "tabs"))

    def header(self) -> str:
        inside = self.element(self.pick("div", "p", "h1", "h2", "span"), self.words(1, 5)) + (self.element("p", self.sentence()) if self.r.random() < 0.5 else "") + (self.menu() if self.r.random() < 0.5 else "")
        return self.element("header", inside) if self.r.random() < 0.7 else self.element("div", inside, self.name("header", "masthead", "banner", "branding", "logo", "top"))

    def footer(self) -> str:
        owner = self.pick("&copy; ", "Copyright ", "© 2024 ", "") + self.word() + ".example" + self.pick(" &middot; ", " | ", " - ", ". ")
        inside = self.pick("", self.links(2, 8)) + owner + self.prose(1, 2) + self.pick("", self.element("p", self.prose(1, 2)), self.links(2, 6))
        return self.element("footer", inside) if self.r.random() < 0.7 else self.element("div", inside, self.name("footer", "bottom", "colophon", "copyright", "legal"))

    def sidebar(self) -> str:
        widgets = "".join(self.element("div", self.element(self.pick("h3", "h4", "div"), self.words(1, 4)) + self.pick(self.links(3, 8), self.element("p", self.prose(1, 3)), self.links(2, 5))) for _ in range(self.r.randint(1, 4)))
        return self.element("aside", widgets, self.name("sidebar") if self.r.random() < 0.3 else "") if self.r.random() < 0.6 else self.element(self.pick("div", "td", "section"), widgets, self.name("sidebar", "side", "widget", "widgets", "rail", "secondary", "aside", "complementary"))

    def advert(self) -> str:
        inside = self.pick(self.prose(1, 3), self.sentence(), f'<a href="/x">{self.words(2, 9)}</a>', self.element("p", self.prose(1, 3)))
        return ("<!-- ad 1 -->" if self.r.random() < 0.3 else "") + self.element(self.pick("div", "div", "aside", "section", "p"), inside, self.name("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "banner-ad", "adslot", "promoted", "ad-unit"))

    def notice(self) -> str:
        inside = self.pick(self.prose(1, 3), "We use cookies. " + self.sentence(), self.element("p", self.prose(1, 3)), self.element("p", "This site uses cookies. " + self.sentence()) + "<button>OK</button>")
        return self.element(self.pick("div", "div", "section", "p"), inside, self.name("cookie", "cookies", "cookie-notice", "notice", "gdpr", "consent", "alert", "warning", "banner", "notification", "disclaimer", "paywall", "message", "popup", "modal", "overlay"))

    def form(self) -> str:
        inside = "".join(self.element(self.pick("label", "p", "div"), self.words(1, 6)) + "<input type=text>" for _ in range(self.r.randint(1, 4))) + self.pick("", self.element("p", self.prose(1, 2)))
        return self.element("form", inside, self.name("search", "login", "signup", "subscribe", "contact") if self.r.random() < 0.4 else "") if self.r.random() < 0.8 else self.element("div", self.element("p", self.prose(1, 2)) + "<input>", self.name("newsletter", "subscribe", "signup", "subscription"))

    def comments(self) -> str:
        one = lambda: self.pick(self.element("p", self.prose(1, 5)), self.element("div", self.word()) + self.element("p", self.prose(1, 4)), self.element("b", self.word()) + " " + self.prose(1, 4))
        tag = self.pick("li", "div", "article", "div")
        each = [self.element(tag, one(), self.name("comment", "reply", "comment-body") if self.r.random() < 0.6 else "") for _ in range(self.r.randint(1, 6))]
        head = self.pick("", self.element(self.pick("h2", "h3"), self.pick("Comments", self.words(1, 3), "3 " + self.word())))
        inside = head + (self.element("ol", "".join(each)) if tag == "li" else "".join(each)) + (self.form() if self.r.random() < 0.3 else "")
        return self.element(self.pick("div", "section", "section", "aside"), inside, self.name("comments", "comment-list", "commentlist", "responses", "discussion", "disqus", "replies", "reader-comments", "user-comments", "comments-area"))

    def extra(self) -> str:
        inside = self.pick(self.links(3, 8), self.links(2, 6), self.element("h3", self.words(1, 4)) + self.links(2, 6), self.element("p", self.prose(1, 2)))
        return self.element(self.pick("div", "section", "aside", "ul"), inside, self.name("related", "related-posts", "share", "social", "sharing", "recommended", "more", "tags", "tagcloud", "pagination", "pager", "popular", "trending", "read-more", "toolbar", "meta-links", "author-box", "teaser"))

    # content

    def marked(self, text: str) -> str:
        return MARK + text

    def paragraph(self) -> str:
        kind = self.r.random()
        if kind < 0.74:
            return f"<p>{self.marked(self.prose(1, 7))}" + self.pick("</p>", "</p>", "</p>", "</p>", "")
        if kind < 0.8:
            return f"<p><b>{self.marked(self.words(1, 9).capitalize())}.<br>"
        if kind < 0.86:
            return self.element(self.pick("h2", "h3", "h4"), self.marked(self.words(1, 8).capitalize()))
        if kind < 0.91:
            return self.element(self.pick("ul", "ol"), "".join(f"<li>{self.marked(self.prose(1, 2))}</li>" for _ in range(self.r.randint(2, 5))))
        if kind < 0.94:
            return self.element("blockquote", self.pick(self.marked(self.prose(1, 3)), f"<p>{self.marked(self.prose(1, 3))}</p>"))
        if kind < 0.96:
            return self.element("table", "".join(f"<tr><td>{self.marked(self.words(1, 3))}</td><td>{self.marked(self.words(1, 6))}</td></tr>" for _ in range(self.r.randint(1, 4))))
        if kind < 0.98:
            return self.element("div", self.marked(self.prose(1, 5)))
        return self.element("pre", self.marked(self.prose(1, 3)))

    def article(self) -> str:
        title = self.element("h1", self.marked(self.words(1, 12).capitalize() + self.pick("", "."))) if self.r.random() < 0.85 else ""
        body = []
        for _ in range(self.pick(0, 1, 1, 2, 3, 4, 6, 9, 14)):
            body.append(self.paragraph())
            if self.r.random() < 0.05:
                body.append(self.pick(self.advert, self.extra, self.notice, self.form)())
        if self.r.random() < 0.3:  # a short last paragraph
            body.append(f"<p>{self.marked(self.sentence())}</p>")
        if not title and not body:
            body = [f"<p>{self.marked(self.prose(2, 4))}</p>"]
        inside = title + "".join(body) + "".join(self.pick(self.extra, self.comments, self.advert)() for _ in range(self.pick(0, 0, 0, 0, 1, 2)))
        kind = self.r.random()
        if kind < 0.5:
            return self.element("article", inside, self.name(*CONTENT_NAMES) if self.r.random() < 0.3 else "")
        if kind < 0.62:
            return self.element("main", inside, self.name(*CONTENT_NAMES) if self.r.random() < 0.3 else "")
        if kind < 0.9:
            return self.element(self.pick("div", "section", "div", "td"), inside, self.name(*CONTENT_NAMES))
        return self.element("div", inside, self.name(*ODD_NAMES) if self.r.random() < 0.5 else "")

    def page(self) -> str:
        before = [self.pick(self.menu, self.header, self.menu, self.advert, self.notice, self.extra, self.form)() for _ in range(self.pick(0, 1, 2, 2, 3))]
        after = [self.pick(self.footer, self.sidebar, self.comments, self.extra, self.advert, self.form, self.notice)() for _ in range(self.pick(0, 0, 1, 1, 2, 3))]
        if self.r.random() < 0.7:
            after.append(self.footer())
        inside = "".join(before) + (self.sidebar() if self.r.random() < 0.15 else "") + self.article() + "".join(after)
        for _ in range(self.pick(0, 0, 1, 2)):
            inside = self.element("div", inside, self.name(*ODD_NAMES) if self.r.random() < 0.6 else "")
        head = f"<head><title>{self.words(1, 8)}</title><script>var t='<p>';</script></head>" if self.r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html>{head}<body>{inside}" + self.pick("</body></html>", "</body></html>", "")


def example(seed: int) -> tuple[np.ndarray, np.ndarray]:
    read = blocks(Maker(seed).page())
    labels = np.array([MARK in b.text for b in read], np.float32)
    return vectors([Block(b.path, b.text.replace(MARK, "").strip() or ".", b.linked) for b in read]), labels


def _traced(x: np.ndarray, alive: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """As ``lstm``, keeping what its gradient needs."""
    size = u.shape[0]
    h, c = np.zeros((len(x), size), np.float32), np.zeros((len(x), size), np.float32)
    out, kept = np.zeros((*x.shape[:2], size), np.float32), []
    for t in range(x.shape[1]):
        g = x[:, t] @ w + h @ u + b
        gates = 1 / (1 + np.exp(-np.clip(g[:, : 3 * size], -30, 30)))
        i, f, o, n = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(g[:, 3 * size :])
        new_c = f * c + i * n
        tanh_c = np.tanh(new_c)
        on = alive[:, t, None]
        kept.append((i, f, o, n, c, tanh_c, h, on))
        c, h = np.where(on, new_c, c), np.where(on, o * tanh_c, h)
        out[:, t] = h
    return out, kept


def _gradient(x: np.ndarray, kept: list, u: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = u.shape[0]
    d_gates = np.zeros((*x.shape[:2], 4 * size), np.float32)
    d_u = np.zeros_like(u)
    dh, dc = np.zeros((len(x), size), np.float32), np.zeros((len(x), size), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, o, n, c, tanh_c, h, on = kept[t]
        dh = dh + d_out[:, t]
        step = np.where(on, dh, 0)
        inner = np.where(on, dc, 0) + step * o * (1 - tanh_c**2)
        g = np.concatenate([inner * n * i * (1 - i), inner * c * f * (1 - f), step * tanh_c * o * (1 - o), inner * i * (1 - n**2)], axis=1)
        d_gates[:, t] = g
        d_u += h.T @ g
        dh = np.where(on, g @ u.T, dh)
        dc = np.where(on, inner * f, dc)
    flat = d_gates.reshape(-1, 4 * size)
    return x.reshape(-1, x.shape[2]).T @ flat, d_u, flat.sum(axis=0)


def train(pages: int = PAGES, rounds: int = ROUNDS, seed: int = SEED) -> dict[str, np.ndarray]:
    examples = [e for e in map(example, range(seed * 1_000_000, seed * 1_000_000 + pages)) if len(e[0])]
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    start = np.zeros(4 * HIDDEN, np.float32)
    start[HIDDEN : 2 * HIDDEN] = 1
    p = {"wf": normal(INPUT, 4 * HIDDEN), "uf": normal(HIDDEN, 4 * HIDDEN), "bf": start, "wb": normal(INPUT, 4 * HIDDEN), "ub": normal(HIDDEN, 4 * HIDDEN), "bb": start.copy(), "v": normal(2 * HIDDEN, 1), "skip": np.zeros((INPUT, 1), np.float32), "c": np.zeros(1, np.float32)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(rounds):
        order = rng.permutation(len(examples))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        total, wrong, n = 0.0, 0, 0
        for batch in batches:
            chosen = [examples[i] for i in batch]
            lengths = np.array([len(y) for _, y in chosen])
            steps = int(lengths.max())
            x = np.zeros((len(chosen), steps, INPUT), np.float32)
            back, y = np.zeros_like(x), np.zeros((len(chosen), steps), np.float32)
            for i, (a, b) in enumerate(chosen):
                # some names and words are hidden, so that none decides alone
                a = a * np.where(rng.random(a.shape) < 0.1, 0, 1).astype(np.float32) if rng.random() < 0.5 else a
                if rng.random() < 0.15:
                    a = a.copy()
                    a[:, TAG_SIZE:-10] = 0
                x[i, : len(a)], back[i, : len(a)], y[i, : len(a)] = a, a[::-1], b
            alive = np.arange(steps) < lengths[:, None]
            hf, kf = _traced(x, alive, p["wf"], p["uf"], p["bf"])
            hb, kb = _traced(back, alive, p["wb"], p["ub"], p["bb"])
            turned = np.zeros_like(hb)
            for i, k in enumerate(lengths):
                turned[i, :k] = hb[i, :k][::-1]
            both = np.concatenate([hf, turned], axis=2)
            z = (both @ p["v"] + x @ p["skip"] + p["c"])[:, :, 0]
            prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            error = np.where(alive, prob - y, 0).astype(np.float32) / len(chosen)
            d_both = error[:, :, None] * p["v"][:, 0]
            d_turned = np.zeros_like(hb)
            for i, k in enumerate(lengths):
                d_turned[i, :k] = d_both[i, :k, HIDDEN:][::-1]
            g = {"v": np.einsum("bth,bt->h", both, error)[:, None], "skip": np.einsum("bth,bt->h", x, error)[:, None], "c": np.array([error.sum()], np.float32)}
            g["wf"], g["uf"], g["bf"] = _gradient(x, kf, p["uf"], d_both[:, :, :HIDDEN])
            g["wb"], g["ub"], g["bb"] = _gradient(back, kb, p["ub"], d_turned)
            norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            step += 1
            rate = 6e-3 * (1 - epoch / rounds) + 3e-4
            for k in p:
                d = g[k] * min(1.0, 5 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d**2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            wrong += int((((prob >= 0.5) != (y >= 0.5)) & alive).sum())
            n += int(alive.sum())
        print(f"round {epoch}: {wrong} of {n} blocks wrong", flush=True)
    return p


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: a.astype(np.float16) for k, a in train().items()})
