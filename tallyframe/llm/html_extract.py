"""Main text of web pages by a recurrent block labeller.

A page is its sequence of text blocks.  Each block is a vector of its hashed tag path, its hashed words and a
few measures; a bidirectional LSTM in numpy reads the whole sequence both ways and labels every block main
or not.  It is trained here: on pages laid out by rule, with the texts of a bounded sample of the given pages,
where it is known which blocks are the article's.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, table
from .html_blocks import DIM, blocks, vectors

#: Pages whose texts the training pages are made of (so many characters of each at most), training pages, and the rest of the training.
TRAIN_CHARS = 20_000
#: Pages, and characters of them, that are parsed at once; a longer page goes alone.
AT_ONCE, CHARS_AT_ONCE = 300, 4_000_000
SAMPLE, PAGES, HIDDEN, EPOCHS, BATCH, RATE, SEED = 200, 3000, 24, 7, 30, 0.01, 7

#: Names under which sites keep what is, and what is not, the article.
MAIN = [
    "article", "main", "div.content", "div#content", "div#main-content", "div.post-body", "div.entry-content", "section.article-body", "div.story", "article.post",
    "div.article-text", "div.main", "section", "div", "td", "article.story-body", "div.page-content", "main#main", "section.post", "div.body-text", "article.entry hentry",
    "div.artikel", "div.inhalt", "div.contenu", "div.article-texte", "div.contenido", "div.noticia", "div.contenuto", "div.artigo",
]
ASIDE = {
    "menu": ["nav", "ul.menu", "div.navbar", "div#menu", "nav.main-nav", "div.navigation", "ul.nav", "div.breadcrumb", "div.topbar", "nav.breadcrumbs", "div.pagination", "div.tabs", "ol.breadcrumb", "menu", "div.toc", "div.menue", "ul.menu-principal", "div.navegacion"],
    "header": ["header", "div.header", "div#masthead", "header.site-header", "div.page-header", "div.logo", "div#top", "div.branding", "header.banner", "div.kopf", "div.entete", "div.cabecera"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.legal", "section.footer", "div#bottom", "div.colophon", "div#fuss", "div.pied", "div.pie"],
    "sidebar": ["aside", "div.sidebar", "div#sidebar", "aside.widget-area", "div.widget", "div.related", "div.related-posts", "section.recommended", "div.trending", "div.more-stories", "ul.popular", "div.tags", "div.share", "div.social-links", "div.author-box", "section.read-more", "div#right-column", "div.seitenleiste", "div.colonne", "div.lateral"],
    "notice": ["div.cookie-notice", "div#cookie-banner", "div.gdpr", "div.alert", "div.notice", "section.consent", "div.popup", "div.modal", "div.privacy-banner", "div.paywall", "div.disclaimer", "dialog", "div.banner", "div.warning", "div.cookies", "div.hinweis", "div.avertissement", "div.aviso"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "section.promo", "div.promoted", "aside.ad", "div#ad-top", "div.banner-ad", "div.sponsor", "p.ad", "div.adsbygoogle", "div.commercial", "figure.ad", "div.werbung", "div.publicite", "div.anuncio"],
    "form": ["form", "form.search", "div.newsletter", "form#login", "div.subscribe", "div.signup", "fieldset", "form.contact", "div.login", "div.search-box", "section.newsletter-signup", "form.poll", "form.suche", "form.recherche", "form.buscar"],
    "comments": ["div#comments", "section.comments", "div.comment-list", "ol.commentlist", "div.comment", "div.disqus", "ul.replies", "section#respond", "div.reader-comments", "div.responses", "div.discussion", "section.user-comments", "div.kommentare", "div.commentaires", "div.comentarios"],
}
#: Phrases that such blocks carry in the larger European languages, parted by bars.
SAID = {
    "menu": "home|about us|contact|news|sports|next|previous|back|menu|skip to content|log in|archive|products|blog|links|search|accueil|actualités|retour|startseite|über uns|aktuelles|zurück|kontakt|inicio|noticias|contacto|prima pagina|contatti|voorpagina|nieuws|início|start|nyheter|strona główna|aktualności",
    "header": "welcome to the|the daily|official site|online since|magazine|gazette|journal|zeitung|le journal|el diario|il giornale|willkommen|bienvenue|bienvenidos",
    "footer": "© copyright|all rights reserved|privacy policy|terms of use|imprint|contact us|site map|last updated|webmaster|impressum|datenschutz|alle rechte vorbehalten|mentions légales|tous droits réservés|aviso legal|política de privacidad|todos los derechos reservados|tutti i diritti riservati|alle rechten voorbehouden|todos os direitos reservados|alla rättigheter förbehållna|wszelkie prawa zastrzeżone|kontakt|colofon|accessibility|follow us|powered by",
    "sidebar": "related articles|read more|most popular|most read|trending|share|tweet|print|tags|categories|about the author|latest stories|see also|you may also like|recent posts|archives|mehr zum thema|meistgelesen|lesen sie auch|à lire aussi|les plus lus|lo más leído|te puede interesar|i più letti|leggi anche|lees ook|mais lidas|mest läst|zobacz także|follow us on",
    "notice": "we use cookies|accept all|this site uses cookies|consent to the use|privacy settings|i agree|by continuing you accept|manage your choices|free articles left|wir verwenden cookies|zustimmen|diese website nutzt cookies|nous utilisons des cookies|accepter|ce site utilise des cookies|utilizamos cookies|aceptar|este sitio usa cookies|utilizziamo i cookie|accetta|wij gebruiken cookies|akkoord|usamos cookies|aceitar|vi använder cookies|godkänn|używamy plików cookies|akceptuję",
    "advert": "advertisement|sponsored|buy now|sale|free offer|click here|shop now|best deals|save up to 50%|from 9 euros|discount|order today|anzeige|jetzt kaufen|angebot|publicité|achetez maintenant|offre|meilleur prix|publicidad|compra ahora|oferta|pubblicità|offerta|advertentie|aanbieding|anúncio|annons|köp nu|reklama|promocja",
    "form": "your name|email|subscribe|sign up|search|submit|password|send|newsletter|log in|register|forgot your password?|suchen|anmelden|absenden|passwort|rechercher|s'abonner|envoyer|mot de passe|buscar|enviar|contraseña|cerca|iscriviti|invia|zoeken|versturen|pesquisar|sök|szukaj",
    "comments": "reply|says:|wrote:|posted by|5 hours ago|2 days ago|like|report|yesterday at 10:15|antworten|schrieb|vor 3 stunden|melden|répondre|a écrit|il y a 2 jours|responder|dijo|hace 4 horas|rispondi|ha scritto|2 ore fa|beantwoorden|schreef|svara|skrev|för 2 timmar sedan|odpowiedz|napisał",
    "opening": "comments|3 comments|comments (12)|leave a comment|join the discussion|responses|what readers say|kommentare|leserkommentare|commentaires|vos réactions|comentarios|opiniones|commenti|reacties|comentários|kommentarer|komentarze",
}
#: How pages name their parts: as listed, by made-up names, not at all, by cells of tables, or each part one of these ways.
STYLES, SHARES = ["listed", "made up", "bare", "table", "mixed"], [0.4, 0.2, 0.15, 0.15, 0.1]
_MARK_MAIN, _MARK_REST = "", ""


def _tag(spec: str) -> tuple[str, str]:
    for sep, attr in ((".", "class"), ("#", "id")):
        if sep in spec:
            name, value = spec.split(sep, 1)
            return f'<{name} {attr}="{value}">', f"</{name}>"
    return f"<{spec}>", f"</{spec}>"


def _namer(rng: random.Random):
    """(style, function from a list of the usual names to the tags of a part) of one page."""
    style = rng.choices(STYLES, SHARES)[0]
    prefix, letters = rng.choice(["css-", "sc-", "x", "_", ""]), "abcdefghijklmnopqrstuvwxyz"
    size = rng.choice([1, 4, 6, 10])

    def tags(usual: list[str]) -> tuple[str, str]:
        way = rng.choice(STYLES[:3]) if style == "mixed" else style
        if way == "listed":
            return _tag(rng.choice(usual))
        if way == "made up":
            name = "".join(rng.choice(letters if rng.random() < 0.7 else "0123456789") for _ in range(size))
            return _tag(f"{rng.choice(['div', 'div', 'div', 'section', 'div' if usual is MAIN else 'ul'])}{rng.choice('.#')}{prefix}{name}")
        return _tag(rng.choice(["div", "div", "div", "p", "span", "center"]) if way == "table" else rng.choice(["div", "div", "div", "section"]))

    return style, tags


def training_page(rng: random.Random, texts: list[str]) -> str:
    """A page of random layout; every text starts with a mark of what it is.

    Most pages have their letters exchanged, so that nothing is learnt from the words of articles, only from the
    phrases of what is around them and from the layout.
    """
    style, tags = _namer(rng)
    named = style == "listed"
    letters = "abcdefghijklmnopqrstuvwxyz"
    cipher = str.maketrans(letters, "".join(rng.sample(letters, 26))) if rng.random() < 0.8 else {}

    def words(lo: int, hi: int) -> str:
        t = rng.choice(texts).split()
        a = rng.randrange(len(t))
        got = " ".join((t[a:] + [w for _ in range(4) for w in rng.choice(texts).split()] * 2)[: rng.randint(lo, hi)]) or "text"
        return got.translate(cipher)

    def sentence(lo: int, hi: int) -> str:
        return words(lo, hi) + rng.choice([".", ".", ".", "!", "?", ""])

    def phrase(kind: str) -> str:
        got = rng.choice(SAID[kind].split("|"))
        return rng.choice([got, got.capitalize(), got.capitalize(), got.upper()])

    def link(inner: str) -> str:
        return f'<a href="/{rng.randrange(99)}">{inner}</a>'

    def aside(kind: str) -> str:
        start, end = tags(ASIDE[kind])
        told = lambda: " ".join(rng.choice([phrase(kind), phrase(kind), words(1, 2)]) for _ in range(rng.randint(1, 4)))
        # without names around them, parts are known by what they say only
        some = lambda lo, hi: _MARK_REST + rng.choice([words(lo, hi), sentence(lo, hi), phrase(kind), told()] if named else [phrase(kind), told(), phrase(kind) + " " + sentence(1, 9), words(1, 3) + " " + phrase(kind)])
        way = rng.random()
        if kind == "menu" or (kind in ("sidebar", "footer") and way < 0.5):
            short = lambda: _MARK_REST + (phrase(kind) if rng.random() < 0.4 else words(1, 4 if kind != "sidebar" else 9))
            head = f"<{(h := rng.choice(['h2', 'h3', 'h4', 'p', 'div']))}>{_MARK_REST}{phrase('sidebar')}</{h}>" if kind == "sidebar" and rng.random() < 0.8 else ""
            sep = rng.choice([" ", " ", "", " | ", " · ", " &gt; ", "<br>"])
            items = [link(short()) for _ in range(rng.randint(1, 8))]
            listed = "".join(f"<li>{i}</li>" for i in items)
            inner = head + (listed if start[1:3] in ("ul", "ol") else rng.choice([f"<ul>{listed}</ul>", sep.join(items), sep.join(items), "".join(f"<div>{i}</div>" for i in items)]))
        elif kind == "form":
            inner = "".join(rng.choice(["<label>{}</label><input>", "<p>{}</p>", "<div>{}</div>", "<button>{}</button>"]).format(some(1, 12)) for _ in range(rng.randint(1, 4)))
            inner = f"<form>{inner}</form>" if rng.random() < 0.5 else inner
        elif kind == "comments":
            signed, headed = rng.choice([(True, True), (True, False), (False, True), (False, not named)])
            who = lambda: _MARK_REST + words(1, 2) + (" " + phrase(kind) if signed else "")
            said = lambda: _MARK_REST + " ".join(sentence(2, 25) for _ in range(rng.randint(1, 2)))
            foot = lambda: _MARK_REST + rng.choice([phrase(kind), link(phrase(kind))])
            one = rng.choice(["<div><b>{}</b><p>{}</p>{}</div>", "<li><p>{}</p><p>{}</p><p>{}</p></li>", "<article class='comment-body'><h4>{}</h4><p>{}</p>{}</article>", "<p>{}</p><p>{}</p><p>{}</p>", "<div><div>{}</div><div>{}</div><div>{}</div></div>"])
            if not named:
                one = one.replace(" class='comment-body'", "").replace("article", "div")
            head = f"<h3>{_MARK_REST}{phrase('opening')}</h3>" if headed else ""
            inner = head + "".join(one.format(who(), said(), foot()) for _ in range(rng.randint(1, 6)))
        elif kind == "header":
            name = rng.choice([_MARK_REST + words(1, 4), some(1, 6)])
            inner = rng.choice(["{}", "<b>{}</b>", "<h2>{}</h2>", "<p>{}</p>", "<div>{}</div>"]).format(name if named and rng.random() < 0.5 else link(name))
        else:
            inner = rng.choice(["{}", "<p>{}</p>", "<p>{}</p><p>{}</p>", "<div>{}</div>", "<h3>{}</h3><p>{}</p>", "<h2>{}</h2><div>{}</div><a href='#'>{}</a>", "<span>{}</span>", "<p>{}</p><button>{}</button>", "<a href='#'>{}</a>"])
            for _ in range(inner.count("{}")):
                inner = inner.replace("{}", some(1, 45 if named else 16), 1)
        return f"{start}{inner}{end}"

    def body() -> str:
        parts = []
        para = rng.choice(["p", "p", "p", "p", "div"])
        if rng.random() < 0.85:
            level = rng.choice(["h1", "h1", "h1", "h2"])
            title = f"<{level}>{_MARK_MAIN}{words(1, 14)}</{level}>"
            parts.append(f"<header>{title}</header>" if rng.random() < 0.1 else title)
        longest = rng.choice([30, 30, 120])
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20])):
            kind = rng.random()
            if kind < 0.7:
                linked = f" {link(words(1, 3))} " if rng.random() < 0.1 else ""
                bold = rng.choice(["", "", "", "<b>"]) if named else ""
                end = rng.choice([f"</{para}>"] * 3 + ["<br>"]) if para == "p" else f"</{para}>"
                parts.append(f"<{para}>{bold}{_MARK_MAIN}{sentence(*rng.choice([(1, 8), (6, longest), (6, longest), (6, longest)]))}{linked}{end}")
            elif kind < 0.77:
                level = rng.choice("23")
                parts.append(f"<h{level}>{_MARK_MAIN}{words(1, 9)}</h{level}>")
            elif kind < 0.85:
                lists = rng.choice(["ul", "ol"])
                parts.append(f"<{lists}>" + "".join(f"<li>{_MARK_MAIN}{sentence(1, 20)}</li>" for _ in range(rng.randint(1, 6))) + f"</{lists}>")
            elif kind < 0.92:
                frame = rng.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>", "<dl><dt>{}</dt><dd>{}</dd></dl>", "<table><tr><td>{}</td><td>{}</td></tr></table>"])
                for _ in range(frame.count("{}")):
                    frame = frame.replace("{}", _MARK_MAIN + sentence(1, 20), 1)
                parts.append(frame)
            else:
                parts.append(aside(rng.choice(["advert", "sidebar", "form", "notice", "menu"])))
        return "".join(parts)

    before = [aside(k) for k in ("header", "menu", "notice", "advert", "sidebar", "form", "menu") if rng.random() < 0.45]
    after = [aside(k) for k in ("advert", "sidebar", "comments", "form", "menu", "notice", "footer") if rng.random() < 0.45]
    if rng.random() < 0.5:
        rng.shuffle(before)
    if rng.random() < 0.3:
        rng.shuffle(after)
    if style == "table":
        cell = lambda x: f"<td>{x}</td>"
        row = lambda x: f"<tr>{x}</tr>"
        sides = [*map(cell, before[1:]), cell(body()), *map(cell, after[:1])]
        rows = "".join(row(cell(x)) for x in before[:1]) + (row("".join(sides)) if rng.random() < 0.5 else "".join(map(row, sides)))
        return f"<html><body><table>{rows}{''.join(row(cell(x)) for x in after[1:])}</table></body></html>"
    start, end = tags(MAIN) if rng.random() < 0.9 else ("", "")
    inner = f"{start}{body()}{end}"
    for _ in range(rng.choice([0, 0, 1, 2])):
        a, b = tags(MAIN) if not named else _tag(rng.choice(["div", "div.wrapper", "div.container", "div#page", "main", "div.row", "div.col"]))
        inner = f"{a}{inner}{b}"
        if rng.random() < 0.3 and after:
            inner = inner[: -len(b)] + after.pop(0) + b
    return f"<html><body>{''.join(before)}{inner}{''.join(after)}</body></html>"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Bidirectional LSTM over block vectors, with a logistic output."""

    def __init__(self, dim: int = DIM, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.h = hidden
        draw = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {k: v for d in "fb" for k, v in {"x" + d: draw(dim, 4 * hidden), "h" + d: draw(hidden, 4 * hidden), "c" + d: np.zeros(4 * hidden, np.float32)}.items()}
        for d in "fb":
            self.p["c" + d][hidden : 2 * hidden] = 1  # forget gates start open
        self.p |= {"out": draw(2 * hidden), "bias": np.zeros(1, np.float32)}

    @staticmethod
    def flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence of x(batch, time, ...) turned around within its own length."""
        at = np.arange(x.shape[1])[None]
        at = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
        return x[np.arange(len(x))[:, None], at]

    def _walk(self, pre: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states over pre(batch, time, gates), and with ``keep`` what training needs of each step."""
        n, size, _ = pre.shape
        w, k = self.p["h" + d], self.h
        h = c = np.zeros((n, k), pre.dtype)
        out, kept = np.empty((n, size, k), pre.dtype), []
        for t in range(size):
            z = pre[:, t] + h @ w
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), _sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                kept.append((i, f, o, g, c, h, tanh))
            c, h = new, o * tanh
            out[:, t] = h
        return out, kept

    def _unwalk(self, x: np.ndarray, d: str, kept: list, up: np.ndarray, grads: dict) -> None:
        n, size, _ = x.shape
        k, w = self.h, self.p["h" + d]
        dz = np.empty((n, size, 4 * k), np.float32)
        dh = dc = np.zeros((n, k), np.float32)
        dw = np.zeros_like(w)
        for t in range(size - 1, -1, -1):
            i, f, o, g, c, h, tanh = kept[t]
            dh = dh + up[:, t]
            dc = dc + dh * o * (1 - tanh * tanh)
            z = dz[:, t]
            z[:, :k], z[:, k : 2 * k], z[:, 2 * k : 3 * k], z[:, 3 * k :] = dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)
            dw += h.T @ z
            dh, dc = z @ w.T, dc * f
        grads["h" + d], grads["c" + d] = dw, dz.sum((0, 1))
        grads["x" + d] = x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, 4 * k)

    def scores(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        hf, kf = self._walk(x @ self.p["xf"] + self.p["cf"], "f", keep)
        hb, kb = self._walk(self.flip(x @ self.p["xb"] + self.p["cb"], lengths), "b", keep)
        hidden = np.concatenate([hf, self.flip(hb, lengths)], 2)
        return hidden @ self.p["out"] + self.p["bias"], (hidden, kf, kb)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict:
        z, (hidden, kf, kb) = self.scores(x, lengths, keep=True)
        mask = np.arange(x.shape[1]) < lengths[:, None]
        dz = ((_sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
        grads = {"out": np.einsum("nt,ntk->k", dz, hidden), "bias": dz.sum(keepdims=True).ravel()}
        up = dz[:, :, None] * self.p["out"]
        self._unwalk(x, "f", kf, up[:, :, : self.h], grads)
        self._unwalk(self.flip(x, lengths), "b", kb, self.flip(up[:, :, self.h :], lengths), grads)
        return grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Labeller:
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                x, lengths = pad([pages[i] for i in groups[g]])
                y = np.zeros(x.shape[:2], np.float32)
                for k, i in enumerate(groups[g]):
                    y[k, : len(labels[i])] = labels[i]
                step += 1
                drop = rng.random((len(x), 1, x.shape[2])) < 0.1  # pages without some of the hints
                for k, grad in self.gradients(np.where(drop, 0, x).astype(np.float32), lengths, y).items():
                    grad = np.clip(grad, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.99 * v[k] + 0.01 * grad * grad
                    now = rate * (1 - epoch / (epochs + 1))
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def predict(self, pages: list[np.ndarray], cells: int = 4000) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length together."""
        out = [np.zeros(0, bool)] * len(pages)
        group: list[int] = []
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        for n, i in enumerate(order):
            group.append(i)
            if n + 1 == len(order) or (len(group) + 1) * len(pages[order[n + 1]]) > cells:
                z, _ = self.scores(*pad([pages[j] for j in group]))
                for k, j in enumerate(group):
                    out[j] = z[k, : len(pages[j])] > 0
                group = []
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), lengths.max(), pages[0].shape[1]), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
    return x, lengths


def training_set(texts: list[str], pages: int = PAGES, seed: int = SEED) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        found = blocks(training_page(rng, texts))
        y = np.array([_MARK_MAIN in b.text for b in found], np.float32)
        clean = [replace(b, text=b.text.replace(_MARK_MAIN, "").replace(_MARK_REST, "").strip() or "-") for b in found]
        if clean:
            xs.append(vectors(clean))
            ys.append(y)
    return xs, ys


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """Labeller trained on ``PAGES`` laid-out pages, with texts from the first
    ``TRAIN_CHARS`` characters of ``sample`` of the given ones (least hash first).

    Null pages are left out; a table without text gives a labeller trained on stock words.
    """
    rows = hash_sample(pages.select("page_id", "html").where("html is not null"), ["page_id", "html"], sample).select(F.substring("html", 1, TRAIN_CHARS).alias("html"))
    texts = [b.text for r in rows.collect() for b in blocks(r["html"])] or ["some plain words of text"]
    return Labeller().fit(*training_set(texts))


def _parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = start = 0
    for i, h in enumerate(pdf["html"]):
        n = len(h or "")
        if i > start and (i - start == AT_ONCE or size + n > CHARS_AT_ONCE):
            yield pdf.iloc[start:i]
            size, start = 0, i
        size += n
    if start < len(pdf):
        yield pdf.iloc[start:]


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text and n_blocks (of the page) of every row of ``pages(page_id, url, html)``.

    text: the blocks labelled main, in page order, joined by two newlines; empty if there are none.  Null html
    counts as empty.  Ids and urls may be null or repeated; other columns are ignored; an empty table gives an
    empty one.  A page is read whole, however long.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Labeller()
        model.p = shared.value
        for pdf in batches:
            for part in _parts(pdf):
                found = [blocks(h) for h in part["html"]]
                main = model.predict([vectors(f) for f in found])
                text = ["\n\n".join(b.text for b, m in zip(f, y, strict=True) if m) for f, y in zip(found, main, strict=True)]
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64").array, "url": part["url"].array, "text": text, "n_blocks": [len(f) for f in found]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_blocks long")


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks of all pages, by a labeller trained in the query."""
    pages = table(spark, sf_dir, "pages")
    made = extract(pages, train(pages))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
