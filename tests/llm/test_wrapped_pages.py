"""Main text of pages whose article stands in elements with misleading names: a wrapper never changes the text."""

import random

import pytest

from tallyforge.llm import html_text

WORDS = "the of and to in that it was for on with as by at from this which river house market winter letter story people garden morning town".split()
WRAPPERS = [
    "<div>{}</div>", '<div class="layout has-sidebar">{}</div>', '<div class="post-content no-sidebar">{}</div>', '<div class="post tags-php">{}</div>', '<div class="with-header"><main>{}</main></div>',
    '<div class="entry entry-social">{}</div>', '<form action="/"><div>{}</div></form>', '<div id="search">{}</div>', '<div class="sidebar-layout"><section>{}</section></div>', '<div class="related-wrapper">{}</div>',
    '<div class="menu-open">{}</div>', '<main class="alert-main">{}</main>', '<section class="share"><div class="social">{}</div></section>', '<div class="modal-ready header-fixed">{}</div>',
]
FURNITURE = [
    '<nav class="main"><ul><li><a href="/a">Home</a></li><li><a href="/b">All the news of the day</a></li></ul></nav>', '<div class="cookie-notice"><p>{}</p></div>', '<footer>&copy; the company and its people, all rights kept</footer>', '<div class="advert">Buy it now</div>',
    '<aside class="sidebar"><p>{}</p><p>{}</p></aside>', '<div class="comments"><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></div>', '<form><label>Name</label><input name="x"><button>Send</button></form>', '<div id="related-posts"><a href="/x">What else to read of it</a></div>',
]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_wrapper_never_changes_the_text(wrapper):
    rng = random.Random(WRAPPERS.index(wrapper))
    for case in range(40):
        paragraphs = [prose(rng, rng.randint(50, 90)) for _ in range(rng.randint(2, 5))]
        inner = "".join(f"<p>{p}</p>" for p in paragraphs)
        if rng.random() < 0.5:
            inner = f"<article>{inner}</article>"
        before, after = ([f.format(prose(rng, 30), prose(rng, 30)) for f in rng.sample(FURNITURE, rng.randint(0, 3))] for _ in range(2))
        plain, page = ("".join([*before, x, *after]) for x in (inner, wrapper.format(inner)))
        want = "\n\n".join(paragraphs)
        assert html_text.main_text(plain)[0] == want, plain
        assert html_text.main_text(page)[0] == want, page
        assert html_text.main_text(f'<html><body class="menu search-open">{WRAPPERS[case % len(WRAPPERS)].format(page)}</body></html>')[0] in (want, html_text.main_text(page)[0])


def test_names_of_elements():
    says = {"has-sidebar": "", "no-sidebar layout": "", "post tags-php": "article", "entry entry-social": "article", "sidebar-left": "likely", "main-menu": "likely", "comments-area": "sure", "post-comments": "sure", "tags": "likely", "share-buttons": "likely", "related": "likely", "header": "likely", "story": "article", "": "", "-": ""}
    assert {k: html_text.named(k) for k in says} == says


def test_comments_and_notices_stay_out():
    rng = random.Random(9)
    article, others = prose(rng, 40), [prose(rng, 60) for _ in range(4)]
    comments = "".join(f'<article class="comment"><p>{x}</p></article>' for x in others)
    assert html_text.main_text(f'<article><p>{article}</p><section class="comments">{comments}</section></article>')[0] == article
    assert html_text.main_text(f'<div><p>{article}</p><section class="comments">{comments}</section></div>')[0] == article
    assert others[0] not in html_text.main_text(f'<p>Short.</p><div class="cookie-consent"><p>{others[0]}</p></div>')[0]  # no wrapper, though no other text reads on


def test_many_nested_and_named_elements_take_linear_time():
    import time

    began = time.process_time()
    names = " ".join(f"col-{i}" for i in range(300))
    for page in ('<div class="sidebar">' * 100_000 + "<p>" + "the cat and the dog of it " * 20, f'<div class="{names}"><p>the cat</p></div>' * 1500, '<div class="share"><p>the cat and the dog are in the house of the man of it</p></div>' * 20_000):
        html_text.main_text(page)
    assert time.process_time() - began < 60
