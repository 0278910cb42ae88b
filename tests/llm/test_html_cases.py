"""Pages on which a lookup of the article element fails, or keeps what isn't the main text."""

import pytest

from quillon.llm.op8_html import main_text

LONG = "The study of the rivers in the north shows that it is the rain of the spring that feeds them, and the people who live there have known it for a long time. " * 2
P, OTHER = f"<p>{LONG}</p>", f"<p>{LONG}XX</p>"
ONE = LONG.strip()

CASES = {
    "a form around the page": (f'<form id=f><div class="menu"><a href=1>Home</a></div><div><h1>Title</h1>{P}{P}<input><label>Search: XX</label><select><option>XX</select></div></form>', ["Title", ONE, ONE]),
    "a form around an article": (f"<form><article>{P}</article><p>XX</p></form>", [ONE]),
    "a form in an article": (f"<article>{P}<form><p>Get XX by mail every day of the week.</p><input></form>{P}</article>", [ONE, ONE]),
    "a form beside the text": (f"<div>{P}{P}</div><form>{OTHER}</form>", [ONE, ONE]),
    "a page of short blocks": ("<div><h1>Title</h1><p>Short text only.</p></div>", ["Title", "Short text only."]),
    "the same in an article": ("<article><h1>Title</h1><p>Short text only.</p></article>", ["Title", "Short text only."]),
    "text outside article": (f"<div><h1>Title</h1>{P}<p>A thin one.</p>{P}</div><nav><a href=1>XX</a></nav>", ["Title", ONE, "A thin one.", ONE]),
    "hidden": (f"<article>{P}<div hidden>{OTHER}</div><div style='display:none'>{OTHER}</div><div style=\"a:b; DISPLAY : none !important\">{OTHER}</div><p aria-hidden=true>{LONG}XX</p><p hidden=''>{LONG}XX</p>{P}</article>", [ONE, ONE]),
    "names that only look hidden": (f'<article><p data-hidden="no" class="hidden x not-hidden" title="x hidden y" style="display:block">{LONG}</p></article>', []),
    "a class says nothing of an attribute": (f'<article><p class="text unhidden" data-style="display:none">{LONG}</p></article>', [ONE]),
    "a notice over the page": (f"<article>{P}<div role=dialog>{OTHER}</div>{P}</article>", [ONE, ONE]),
    "comments by their heading": (f"<article>{P}</article><section><h2>Reader comments</h2>{OTHER}</section>", [ONE]),
    "comments in the article": (f"<article>{P}<h2>3 Comments</h2><div>{OTHER}</div><h3>by XX</h3>{OTHER}</article>", [ONE]),
    "what comes after a heading of others": (f"<article>{P}<h3>Related</h3><p>XX</p><h2>Part two</h2>{P}</article>", [ONE, "Part two", ONE]),
    "others beside the text": (f"<article>{P}</article><div><h2>Related articles</h2>{OTHER}</div>", [ONE]),
    "a heading that only begins so": (f"<article>{P}<h2>Comments on the rivers of the north</h2>{P}</article>", [ONE, "Comments on the rivers of the north", ONE]),
    "a dropped word in a line": (f"<article><p>{LONG}<button>XX</button> <span hidden>XX</span>end.</p></article>", [f"{LONG}end."]),
    "an advert inside": (f"<article>{P}<div class=ad>{OTHER}</div>{P}</article>", [ONE, ONE]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    got = main_text(f"<html><head><title>XX</title></head><body>{page}</body></html>")
    assert "XX" not in got
    if want:
        assert got == "\n".join(want)
    else:
        assert got == "" or got == ONE  # a class may stand for either


def test_deep_and_long_pages_are_linear():
    deep = "<div>" * 20_000 + P + "</div>" * 20_000
    assert main_text(f"<body>{deep}</body>") == ONE
    assert main_text("<form>" + P * 2000 + "</form>").count("\n") == 1999
