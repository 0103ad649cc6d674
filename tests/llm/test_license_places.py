"""Licence notices that fill neither a line nor a paragraph."""

import itertools
import random

import pytest

from ordstack.llm import license_scan

DRAW = random.Random(8)
PROSE = " ".join(f"word{DRAW.randrange(300)}" for _ in range(200))
NOTICE = dict(license_scan.TEMPLATES[::-1])  # the first notice of each licence


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


@pytest.mark.parametrize("name", sorted(NOTICE))
def test_notices_inside_lines_and_paragraphs(name):
    scanner = license_scan.Scanner(places=True)
    inside = f"{PROSE} {NOTICE[name]} {PROSE}"
    for text in (inside, wrapped(inside, 7), inside + "\n\n" + inside.replace(". ", ".\n\n")):
        got = {n: (score, times) for n, score, times in scanner.scan(text)}
        assert set(got) == {name}  # a line of a wrapped notice may be enough for a match of its own
        assert got[name][0] == 1.0 or text != inside


def test_notices_over_several_paragraphs():
    text = dict(license_scan.TEMPLATES)["Zlib"].replace(", ", ",\n\n")
    assert license_scan.Scanner(places=True).scan(PROSE + "\n\n" + text + "\n\n" + PROSE) == [("Zlib", 1.0, 1)]


def test_places_against_all_runs_of_words():
    """A licence is found just where some run of words reaches the coefficient."""
    draw = random.Random(2)
    templates = (("A", "a b c d e"), ("B", "c d a b f g h"), ("C", "a a b a c"))
    scanners = [license_scan.Scanner([t], places=True) for t in templates]
    for _ in range(300):
        words = [draw.choice("abcdefghxy") for _ in range(draw.randint(0, 25))]
        want = {
            name
            for (name, text), made in zip(templates, [s.templates[0][1] for s in scanners])
            for i, j in itertools.combinations(range(len(words) + 1), 2)
            if 2 <= j - i <= int((len(text.split()) - 1) * 1.5 + 1e-9) + 1
            and license_scan.dice(license_scan.bigrams(" ".join(words[i:j])), made) >= license_scan.LEAST
        }
        assert {r[0] for s in scanners for r in s.scan(" ".join(words))} == want


def test_query_finds_places(spark):
    df = spark.createDataFrame([(1, f"{PROSE} {NOTICE['MIT']} {PROSE}"), (2, PROSE)], "doc_id long, text string")
    assert [tuple(r) for r in license_scan.scan(df).collect()] == [(1, "MIT", 1.0, 1)]


def test_no_notice_is_taken_for_another_licence():
    made = license_scan.Scanner().templates
    for (a, x), (b, y) in itertools.combinations(made, 2):
        assert a == b or license_scan.dice(x, y) < license_scan.LEAST, (a, b)


def test_repeated_notices_count_each_once():
    """Runs that a matching line or an earlier run touches don't count again, however many there are."""
    line = NOTICE["MIT"]
    inside = " ".join([f"{PROSE} {line}"] * 300)
    assert license_scan.Scanner(places=True).scan(inside) == [("MIT", 1.0, 300)]
    assert license_scan.Scanner(places=True).scan(f"{line}\n{inside}\n{line}") == [("MIT", 1.0, 302)]
