"""The second pass against walks from block to block, and pages that grow."""

import random
import time

import pytest

from cairn.llm import html as H


def walked(found, first, i, step):
    j = i + step
    while 0 <= j < len(found) and found[j].region == found[i].region and first[j] not in ("good", "bad"):
        j += step
    return j


def test_nearest_decided_blocks_equal_a_walk():
    r = random.Random(6)
    for _ in range(200):
        n = r.randrange(30)
        found = [H.Block("x", 0, False, r.randrange(2), False) for _ in range(n)]
        first = [r.choice(("good", "bad", "short", "near", "short")) for _ in range(n)]
        for step in (-1, 1):
            assert H._nearest(found, first, step) == [walked(found, first, i, step) for i in range(n)]


LONG = "The river bends under the old stone bridges and the traders of the town count their coins while they argue about the price of salt and of wool, as they have done in this place for all the years that anyone can remember, and nobody minds."


def labels(found):
    """What decide() keeps, from the rules as its docstring and the comments give them, block by block."""
    import re

    stops = lambda t: sum(w.strip(".,;:!?()\"'«»¿¡").lower() in H.STOP_WORDS for w in t.split()) / len(t.split())
    first = []
    for b in found:
        n = len(b.text)
        if b.outside or b.linked > H.LINKS * n or (b.text[0] == "©" and not b.region):
            first.append("bad")
        elif n < H.SHORT:
            first.append("short")
        else:
            first.append("good" if stops(b.text) >= H.MANY_STOPS and n > H.LONG else "near" if stops(b.text) >= H.FEW_STOPS or b.region else "bad")
    assert not any(b.named for b in found) and not re.search("©", "".join(b.text for b in found))
    out = []
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            out.append(first[i])
            continue
        left, right = ((j, first[j]) if 0 <= j < len(found) and found[j].region == b.region and not (b.region and found[j].outside) else (None, "") for j in (walked(found, first, i, -1), walked(found, first, i, 1)))
        strong = "good" if b.region or first[i] == "near" else "bad"
        if b.heading and right[1]:
            out.append(right[1])
        elif left[1] == right[1]:
            out.append(left[1] or strong)
        elif not left[1] or not right[1]:
            out.append("good" if b.region and first[i] == "near" else left[1] or right[1])
        elif i - left[0] != right[0] - i:
            out.append(left[1] if i - left[0] < right[0] - i else right[1])
        else:
            out.append(strong)
    if "good" not in out:
        out = ["good" if f == "near" or (f == "short" and not b.linked and not b.outside) else o for f, b, o in zip(first, found, out, strict=True)]
    return [b.text for b, o in zip(found, out, strict=True) if o == "good"]


def test_labels_of_random_pages_follow_the_rules():
    r = random.Random(12)
    parts = [f"<p>{LONG}</p>", "<p>Short one.</p>", f"<p>{LONG[:120]}</p>", "<h2>A heading</h2>", "<p>zzz qqq xxx yyy kkk jjj vvv www zzz qqq xxx yyy kkk jjj vvv www zzz</p>", "<nav><a href=x>Home</a></nav>", f"<p><a href=y>{LONG[:90]}</a></p>", "<article>", "</article>", "<div>", "</div>", "<footer>The end of it</footer>"]
    for _ in range(300):
        page = "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        found = H.blocks(page)
        want = labels(found)
        assert [b.text for b in H.decide(found)] == want
        assert H.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("page", ["<ul>" + "<li>one item" * 40_000, "<div>" * 20_000 + "<b>x</i>" * 20_000, "<p>" + "a < b & c " * 100_000, "<table>" + "<tr><td>x</td>" * 30_000 + "</table>"], ids=["items", "ends", "text", "cells"])
def test_long_pages_take_time_by_their_length(page):
    start = time.process_time()
    H.main_text(page)
    assert time.process_time() - start < 5
