"""Page furniture of problem 5 where pages lack their number or a line is unlike a heading."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import scans

LINES = ["the records room will collect the signed", "delivery challan for the current session", "and the older folder was archived before", "the closing hour of the billing counter"]


def numbered(labels, first="", table=None):
    """Lines of pages of equal length with the label (if any) as the last line of each."""
    lines = []
    for n, label in enumerate(labels):
        lines += [first + LINES[0], *LINES[1:]] if n != table else ["Qty", "30", "31", "Total 61"]
        lines += [label] if label else []
        if not label:
            lines.append(LINES[0])
    return lines


def page_numbers(lines):
    return [lines[i].strip() for i, kind in sorted(scans.furniture(lines).items()) if kind == "page_number"]


@pytest.mark.parametrize("first", ["", "\f"])
@pytest.mark.parametrize("labels", [["1", "2", "", "4", "5", "6"], ["1", "2", "3", "", "", "", "", "8", "9"], ["i", "", "iii", "iv", "", "", "vii"], ["38", "39", "4O", "41", "", "43"], ["xxxviii", "xxxix", "xl", "xli"], ["I", "II", "", "IV", "V"], ["i", "ii", "iii", "1", "2", "", "4"], ["i", "1i", "iii", "iv"]])
def test_missing_page_numbers(labels, first):
    """Numbers on both sides of a gap belong to the series; misread ones too."""
    assert page_numbers(numbered(labels, first)) == [x for x in labels if x]


def test_numbers_of_tables_stay():
    assert page_numbers(numbered(["28", "29", "", "31", "32"], table=1)) == ["28", "29", "31", "32"]
    assert page_numbers(["Qty", "54", "55", "Total 109", *LINES]) == []
    assert page_numbers([*LINES, "Qty", "31", "32", *LINES, "57", "Total 120", *LINES]) == []


def test_single_page_number():
    assert page_numbers([*LINES, "    17"]) == ["17"] and page_numbers(["i", *LINES]) == ["i"] and page_numbers([*LINES, "17", *LINES]) == []


def test_all_frequent_pairs_are_context(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(240)]
    one = spark.createDataFrame([(w,) for w in words], "a string")
    texts = one.crossJoin(one.withColumnRenamed("a", "b")).crossJoin(spark.range(6)).select(F.concat_ws(" ", "a", "b").alias("text"))
    assert set(scans.vocabulary_of(texts).pairs) == {f"{a} {b}" for a in words for b in words}


@pytest.mark.parametrize("running", ["Confidential", "printed for the members of the society", "All rights reserved.", "वार्षिक प्रतिवेदन"])
@pytest.mark.parametrize("mark", ["\f", "number"])
@pytest.mark.parametrize("top", [True, False])
def test_running_lines_of_any_case_and_script(running, mark, top):
    lines, want = [], set()
    for n in range(5):
        body = [f"{x} {chr(97 + n)}" for x in LINES]
        page = [running, *body] if top else [*body, running]
        want.add(len(lines) + page.index(running))
        if mark == "\f":
            page[0] = "\f" * (n > 0) + page[0]
        else:
            page.append(f"- {n + 1} -")
        lines += page
    assert {i for i, kind in scans.furniture(lines).items() if kind == "running"} == want


def test_lines_of_the_body_stay():
    """A line that repeats away from the page edges, at few of them, or on copies of a page is body."""
    pages = [[f"first {chr(97 + n)}", *LINES, f"last {chr(97 + n)}" if n > 1 else "the same end", f"- {n} -"] for n in range(6)]
    assert "running" not in scans.furniture(sum(pages, [])).values()
    copies = [*(f"{x} in full" for x in LINES), *LINES, "- 1 -"] * 2
    assert "running" not in scans.furniture(copies).values()
