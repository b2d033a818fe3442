"""Main text of pages that name no article: every part of the text stays, and only that."""

from __future__ import annotations

import math
import random

import pytest

from rainloom.llm import html_text


def paragraphs(rng, n, chars=300):
    """``n`` paragraphs of about ``chars`` characters, and their texts."""
    texts = []
    for _ in range(n):
        words = []
        while sum(map(len, words)) < chars:
            words.append("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))))
        texts.append(" ".join(words))
    return "".join(f"<p>{t}</p>" for t in texts), texts


@pytest.mark.parametrize("seed", range(20))
def test_all_parts_beside_the_densest_stay(seed):
    rng = random.Random(seed)
    (first, a), (second, b), (third, c) = (paragraphs(rng, rng.randint(4, 8)) for _ in range(3))
    links = "<ul>" + "".join(f"<li><a href=x>link {i}</a></li>" for i in range(20)) + "</ul>"
    page = (f"<body><div>{links}</div><div><div>{first}</div>{links}<p>short note</p><div>{second}</div></div>"
            f"<section>{third}</section><div>fine print</div></body>")
    assert html_text.main_text(page) == " ".join([*a, "short note", *b, *c])


def test_parts_of_six_and_five_paragraphs():
    (first, a), (second, b) = (paragraphs(random.Random(1), n) for n in (6, 5))
    assert html_text.main_text(f"<body><div><div>{first}</div><div>{second}</div></div></body>") == " ".join(a + b)


@pytest.mark.parametrize("name", ["class='has-sidebar'", "class='with-sidebar'", "class='page header-fixed'", "class=no-comments", "id=side"])
def test_a_name_does_not_remove_what_holds_most_of_the_text(name):
    rng = random.Random(2)
    (text, own), (aside, _) = paragraphs(rng, 6), paragraphs(rng, 1)
    page = f"<body><p>intro</p><div id=top><div {name}>{text}<div class=sidebar>{aside}</div></div></div></body>"
    assert html_text.main_text(page) == " ".join(own)


@pytest.mark.parametrize("name", ["comments", "cookie-notice", "related"])
def test_longer_text_of_another_kind_does_not_replace_the_article(name):
    rng = random.Random(3)
    (text, own), (other, _) = paragraphs(rng, 5), paragraphs(rng, 4 if name == "related" else 9)
    assert html_text.main_text(f"<body><div>{text}</div><div class={name}>{other}</div></body>") == " ".join(own)


def prose(word, paragraphs=1):
    return ("<p>" + f"{word} words of prose follow here and " * 10 + "</p>") * paragraphs


@pytest.mark.parametrize("body, wanted", [
    (f"<main><article>{prose('one', 3)}</article><article>{prose('two', 3)}</article></main>", {"one", "two"}),
    (f"<main><article>{prose('one', 3)}</article><section>{prose('two', 2)}</section></main>", {"one", "two"}),
    (f"<article>{prose('one', 3)}</article><div><article>{prose('two', 2)}</article></div><div>{prose('bad')}</div>", {"one", "two"}),
    (f"<div>{prose('one', 10)}</div><article><p>two lines</p></article>", {"one", "two"}),
    (f"<div>{prose('one', 5)}</div><article><p>two lines</p></article>", {"one", "two"}),
    (f"<form><nav>bad</nav>{prose('one', 3)}{prose('two')}<input value=bad><button>bad</button></form>", {"one", "two"}),
    (f"<div>{prose('one', 4)}{prose('two')}</div><form><label>bad</label><input></form>", {"one", "two"}),
    (f"<article>{prose('one', 4)}{prose('two')}<article class='comment'><p>bad remark</p></article></article>", {"one", "two"}),
    (f"<main><article>{prose('one', 4)}{prose('two')}</article><ul><li><a href=x>bad link</a></ul></main>", {"one", "two"}),
])
def test_named_elements_widen_the_choice_of_density(body, wanted):
    found = html_text.main_text(f"<html><body><nav><a href=x>bad</a></nav>{body}<footer>bad</footer></body></html>").split()
    assert wanted <= set(found) and "bad" not in found


def test_density_is_the_published_formula():
    """Characters a tag times the logarithm of (C/LC * T/LT) to the base ln(C/(C-LC) * LC + LCb/Cb * C + e)."""
    for c, t, lc, lt, share in ((200, 2, 50, 1, 0.1), (90, 7, 3, 2, 0.4), (500, 5, 499, 1, 0.9)):
        base = math.log(c / (c - lc) * lc + share * c + math.e)
        assert html_text.composite_density(c, t, lc, lt, share) == pytest.approx(c / t * max(math.log(c / lc * t / lt, base), 0), abs=1e-6)
