import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

ALPHABET = list("ab/*'\"\\\n \t\r") + ["//", "/*", "*/", "\\'", "\x01", "\x02", "\x03", "\x1c", "\xa0"]


def stripped(source):
    """Reference-free oracle: a scanner that goes through the text one character at a time."""
    out, i = [], 0
    while i < len(source):
        two, c = source[i : i + 2], source[i]
        if two == "//":
            end = source.find("\n", i)
            i = len(source) if end < 0 else end
            out.append(" ")
            continue
        if two == "/*":
            end = source.find("*/", i + 2)
            if end >= 0:
                out.append(" ")
                i = end + 2
                continue
        if c in "'\"":
            j = i + 1
            while j < len(source) and source[j] != c:
                j += 2 if source[j] == "\\" else 1
            if j < len(source):
                out.append(source[i : j + 1])
                i = j + 1
                continue
        out.append(c)
        i += 1
    return "\n".join(line for line in "".join(out).split("\n") if line.strip())


CASES = [
    "// one\n/* two */\n/* holds /* // /** and closes once */\n/**/\n",
    "x = y /* not + z */ - 1; /* **** */",
    "123;\n// comment",
    'x = "// no"; y = \'\\\'\'; /* open',
    "'" + "a" * 200_000 + "' // x",
    "a\r\n// b\r\n\r\nc",
    "\x01// a\x02\n\x03",
    "",
]


def run(spark, sources):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, s string")
    rows = df.select("i", tx.strip_c_comments(F.col("s")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_comment_cases(spark):
    assert run(spark, CASES) == [stripped(c) for c in CASES]
    assert run(spark, [None]) == [None]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), min_size=200, max_size=400))
def test_generated_sources(spark, sources):
    assert run(spark, sources) == [stripped(s) for s in sources]


def test_stripping_twice_changes_nothing_without_literals(spark):
    once = run(spark, ["a // b\nc /* d */ e\n\n", "x"])
    assert run(spark, once) == once


def test_languages(spark):
    df = spark.createDataFrame([("ruby", "a // b"), ("python", "a = 1  # b\n"), ("go", "a // b")], "lang string, code string")
    got = {r.lang: r.o for r in df.select("lang", tx.strip_comments(F.col("code"), F.col("lang"), python=True).alias("o")).collect()}
    assert got == {"ruby": "a // b", "python": "a = 1  ".rstrip("\n"), "go": "a  "}


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('"""mod"""\nimport os # x\n', "import os "),
        ("def f(a):\n    '''doc'''\n    x = 'keep' # no\n\n    return x\n", "def f(a):\n    x = 'keep' \n    return x"),
        ("x = f('a',\n      'b')\n", "x = f('a',\n      'b')"),
        ('x = [\n"a",\n"b"]\n', 'x = [\n"a",\n"b"]'),
        ('"a" "b"\nx = 1\n', "x = 1"),
        ('"a"  # c\n"b" \\\n"c"\nx\n', "x"),
        ('if a:\n    if b:\n        y\n    "s"\n    z("t")\n', 'if a:\n    if b:\n        y\n    z("t")'),
        ('f(\n# c\n"x"\n)\n', 'f(\n"x"\n)'),
        ('class A: "doc"\n', 'class A: "doc"'),
        ("def f(:\n  'x", None),
        ("x = (1,\n", None),
        (None, None),
    ],
)
def test_python_sources(spark, source, want):
    df = spark.createDataFrame([(source,)], "s string")
    assert df.select(tx.strip_python_comments("s")).first()[0] == want


def test_comment_kinds(spark):
    source = "// l\n/* b */ /** d */ /**/ \"/* no */\" '//'"
    df = spark.createDataFrame([(source,)], "s string").select(F.explode(tx.comments(F.col("s"))).alias("c"))
    got = [(r.c, r.k) for r in df.select("c", tx.comment_kind(F.col("c")).alias("k")).collect()]
    assert got == [("// l", "line"), ("/* b */", "block"), ("/** d */", "doc"), ("/**/", "block")]


def test_links_are_null_when_a_side_is(spark):
    df = spark.createDataFrame([("d", "c"), (None, "c"), ("d", None)], "d string, c string")
    assert [r[0] for r in df.select(tx.link_doc_and_code(F.col("d"), F.col("c"))).collect()] == ["d</s>c", None, None]


def test_blank_texts(spark):
    blanks = ["", " ", "\t\n", "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　 "]
    inked = ["a", " ​", "\x01", "᠎"]
    df = spark.createDataFrame([(s,) for s in blanks + inked], "s string")
    got = {r.s: r.k for r in df.select("s", tx.has_ink(F.col("s")).alias("k")).collect()}
    assert got == {s: bool(s.strip()) for s in blanks + inked}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=20), min_size=50, max_size=100))
def test_byte_letters_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    letters = tx.to_byte_letters(F.col("t"))
    for r in df.select("t", letters.alias("b"), tx.from_byte_letters(letters).alias("r")).collect():
        assert r.r == r.t
        assert len(r.b) == len(r.t.encode())
        assert not re.search(r"[\x00-\x20\x7f-\xa0\xad]", r.b)


def test_surface_of_half_a_character_is_the_token(spark):
    df = spark.createDataFrame([("é",), ("a",)], "t string")
    half = F.substring(tx.to_byte_letters(F.col("t")), 1, 1)
    assert [tuple(r) for r in df.select(half, tx.surface(half)).collect()] == [("Ã", "Ã"), ("a", "a")]
