"""Made page layouts that teach the block labeller: real texts under varied tags and names."""

from __future__ import annotations

import html as entities

import numpy as np

#: Names that pages give to their parts, and phrases found in them (fixed values).
NAMES = {
    "main": ("content", "post", "entry-content", "article-body", "story", "main-content", "post-body", "text", "page-content", "entry", "articleText", "body-copy", "content-area", "single-post", "prose", "story__body"),
    "menu": ("nav", "navbar", "menu", "main-menu", "topnav", "navigation", "breadcrumbs", "breadcrumb", "links", "primary-nav", "nav-list", "tabs", "toc-menu"),
    "header": ("header", "site-header", "masthead", "top-bar", "branding", "page-header", "banner", "logo", "topbar", "hero-header"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "foot", "page-footer", "colophon", "footer-links", "imprint"),
    "sidebar": ("sidebar", "side", "widget", "aside", "related", "related-posts", "recommended", "right-rail", "trending", "popular", "widget-area", "more-stories", "rail", "secondary"),
    "notice": ("cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "privacy-notice", "cookie-notice", "paywall", "announcement", "message-bar"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "adbox", "sponsor", "promotion", "ad-container", "dfp-ad", "native-ad"),
    "form": ("form", "newsletter", "subscribe", "signup", "search", "login", "search-form", "newsletter-signup", "contact-form", "subscription", "searchbox"),
    "comments": ("comments", "comment", "comment-list", "responses", "discussion", "replies", "disqus", "reader-comments", "comment-body", "user-comments", "comment-section"),
    "share": ("share", "social", "share-buttons", "social-links", "sharing", "tools", "follow-us", "tags", "meta-links"),
}
PHRASES = {
    "menu": ("Home", "News", "About", "Contact", "Sport", "Politics", "Business", "Login", "Archive", "Help", "Shop", "Start", "Kontakt", "Accueil", "Inicio"),
    "header": ("The daily site", "Welcome", "Sign in", "Menu", "Skip to content", "Search", "Latest headlines"),
    "footer": ("© 2024 All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Powered by", "Contact us", "Back to top"),
    "sidebar": ("Related articles", "Most read", "Trending now", "You may also like", "Recent posts", "Read more", "Popular", "More from this section"),
    "notice": ("We use cookies to improve your experience.", "Accept all", "This site uses cookies.", "Please disable your ad blocker.", "By continuing you agree to our terms.", "Subscribe to continue reading."),
    "advert": ("Advertisement", "Sponsored", "Buy now", "Special offer, today only!", "Save 50%", "Promoted content", "Shop the sale"),
    "form": ("Subscribe to our newsletter", "Your email address", "Sign up", "Search", "Submit", "Enter your name", "Log in", "Password"),
    "comments": ("Leave a comment", "Reply", "3 comments", "Great article, thanks!", "says:", "Post a comment", "I do not agree with this.", "Posted by a reader"),
    "share": ("Share this", "Tweet", "Facebook", "Share on social media", "Print", "Email this"),
}
MARK = "§main§"


def _pick(rng: np.random.Generator, values):
    return values[int(rng.integers(len(values)))]


def _named(rng: np.random.Generator, kind: str, tag: str) -> str:
    name = _pick(rng, NAMES[kind])
    style = rng.random()
    if style < 0.15:
        name = f"{name} {_pick(rng, ('wide', 'col-8', 'clearfix', 'block', 'dark', 'row', 'container'))}"
    elif style < 0.25:
        name = f"{_pick(rng, ('site', 'page', 'js', 'td', 'wp', 'c'))}-{name}"
    elif style < 0.32:
        name = "".join(p.capitalize() for p in name.split("-"))
    return f'<{tag} {_pick(rng, ("class", "class", "id"))}="{name}">'


def _other(rng: np.random.Generator, kind: str, rest: list[str]) -> str:
    """A part that is no main text: under a telling tag, or under a name in plain tags."""
    line = lambda: entities.escape(_pick(rng, PHRASES[kind]) if rng.random() < 0.45 else " ".join(_pick(rng, rest).split()[: int(rng.integers(2, 40))]))
    if kind == "header" and rng.random() < 0.4:
        return f"{_named(rng, kind, 'div')}<{(t := _pick(rng, ('h1', 'h2', 'p', 'span')))}>{line()}</{t}></div>"
    n, telling = int(rng.integers(1, 6)), {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
    tag = telling if telling and rng.random() < 0.6 else _pick(rng, ("div", "div", "section", "ul" if kind in ("menu", "share") else "div"))
    start = f"<{tag}>" if tag == telling and rng.random() < 0.5 else _named(rng, kind, tag)
    if tag == "ul" or kind in ("menu", "share") and rng.random() < 0.7:
        inner = "".join(f'<li><a href="/{k}">{line()}</a></li>' for k in range(n + 2))
        inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
    elif kind == "form":
        inner = f'<label>{line()}</label><input type="text"><button>{line()}</button>' + (f"<p>{line()}</p>" if rng.random() < 0.4 else "")
    elif kind == "comments":
        inner = "".join(f'<{_pick(rng, ("div", "li", "article"))} class="{_pick(rng, ("comment", "reply", "comment-item"))}"><span>{line()}</span><p>{line()}</p></div>' for _ in range(n))
        inner = inner if rng.random() < 0.5 else f"<h3>{line()}</h3>" + "".join(f"<p>{line()}</p>" for _ in range(n))
    elif kind == "sidebar":
        inner = f"<h3>{line()}</h3>" + "".join(f'<{t}><a href="/x{k}">{line()}</a></{t}>' for k, t in enumerate([_pick(rng, ("p", "li", "div"))] * n))
    else:
        inner = "".join(f"<{t}>{line()}</{t}>" for t in [_pick(rng, ("p", "div", "span"))] * n) if rng.random() < 0.6 else line()
    return f"{start}{inner}</{tag}>"


def restyled(rng: np.random.Generator, texts: list[str], rest: list[str]) -> tuple[str, str]:
    """A page that holds ``texts`` as its article, each ending in the returned mark, and other parts."""
    body = []
    for k, t in enumerate(texts):
        safe = entities.escape(t)
        if rng.random() < 0.12 and " " in safe:
            a, _, b = safe.partition(" ")
            safe = f'<a href="/y">{a}</a> {b}' if rng.random() < 0.5 else f"<b>{a}</b> {b}"
        tag = _pick(rng, ("h1", "h1", "h2", "p")) if k == 0 else _pick(rng, ("p",) * 12 + ("h2", "h3", "blockquote", "li", "div", "pre", "td"))
        piece = f"<{tag}>{safe} {MARK}</{tag}>"
        piece = {"li": f"<ul>{piece}</ul>", "td": f"<table><tr>{piece}</tr></table>"}.get(tag, piece)
        if tag == "p" and rng.random() < 0.1:
            piece = f"<p>{safe} {MARK}"
        body.append(piece)
        if rng.random() < 0.08:
            body.append(_other(rng, _pick(rng, ("advert", "sidebar", "form", "share", "notice")), rest))
    if rng.random() < 0.25:
        body.insert(1, _other(rng, "share", rest))
    if rng.random() < 0.15:
        body.append(_other(rng, "comments", rest))
    style = rng.random()
    if style < 0.3:
        open_, close = ("<article>", "</article>") if rng.random() < 0.6 else (_named(rng, "main", "article"), "</article>")
    elif style < 0.45:
        open_, close = "<main>", "</main>"
    elif style < 0.9:
        tag = _pick(rng, ("div", "section", "div", "td"))
        open_, close = _named(rng, "main", tag), f"</{tag}>"
    else:
        open_, close = "<div>", "</div>"
    if rng.random() < 0.3:
        open_, close = f"{_pick(rng, ('<main>', '<div id=\"main\">', '<div class=\"container\">'))}{open_}", f"{close}</div>"
    parts = [_other(rng, k, rest) for k in ("notice", "header", "menu", "advert", "share", "form", "sidebar") if rng.random() < 0.55]
    after = [_other(rng, k, rest) for k in ("comments", "sidebar", "advert", "form", "menu", "footer", "notice") if rng.random() < 0.5]
    if rng.random() < 0.5:
        rng.shuffle(parts)
    wrap = ("<div class=\"wrapper\">", "</div>") if rng.random() < 0.4 else ("", "")
    return f"<html><head><title>x</title></head><body>{wrap[0]}{''.join(parts)}{open_}{''.join(body)}{close}{''.join(after)}{wrap[1]}</body></html>", MARK
