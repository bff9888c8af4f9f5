"""Deep pages in linear time, and neighbours without an id."""

import random
import time

import pytest

from docloom.llm import additive_quant, html_extract


@pytest.mark.parametrize("opened, closed", [("<b>", "</i>"), ("<div>", "</section>"), ("<div>", "<li>"), ("<i>x<div><b>", "</i>")])
def test_deep_pages_are_parsed_in_linear_time(opened, closed):
    start = time.process_time()
    page = html_extract.parse(opened * 200_000 + "end" + closed * 200_000)
    assert page.text[-1] == "end" or "end" in page.text
    assert time.process_time() - start < 20


def open_elements(page):
    """The tags that are open at the end, going down the stack for each tag."""
    block, stack = html_extract.BLOCK, ["html"]
    for tag in page:
        end, name = tag[1] == "/", tag.strip("</>")
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i] == name:
                    del stack[i:]
                    break
                if name not in block and stack[i] in block:
                    break
            continue
        if name in block:
            closes, fence, i = html_extract.CLOSES.get(name, ()), html_extract.FENCE.get(name, ()), len(stack) - 1
            while i > 0 and stack[i] not in fence:
                if stack[i] in closes or stack[i] == "p":
                    was = stack[i]
                    del stack[i:]
                    if was == "p" and not closes:
                        break
                elif stack[i] in block and not closes:
                    break
                i -= 1
        stack.append(name)
    return stack


def test_open_elements_equal_going_down_the_stack(monkeypatch):
    made = []
    monkeypatch.setattr(html_extract, "OpenElements", lambda root, f=html_extract.OpenElements: made.append(f(root)) or made[-1])
    r = random.Random(5)
    tags = "p div li ul dt dd dl tr td th table tbody thead b i a span section h1 form".split()
    for _ in range(2000):
        page = [r.choice([f"<{t}>", f"</{t}>"]) for t in r.choices(tags, k=r.randint(0, 40))]
        html_extract.parse("".join(page))
        assert made.pop().names == open_elements(page), page


def test_rows_without_an_id_are_candidates(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows += [(None, rows[0][1]), (None, [-x for x in rows[0][1]]), (7, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(x.rank, x.vec_id, round(x.score, 9)) for x in additive_quant.neighbours(spark, frame, lambda i: i % 50 == 0).filter("query_id = 0").orderBy("rank").collect()]
    assert got[:2] == [(1, 7, 1.0), (2, None, 1.0)] and len(got) == 5
