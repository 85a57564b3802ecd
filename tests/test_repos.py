import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import java, pairs, repos


def read_in_order(events, votes, streak):
    """The vote as a reader takes it: file by file, method by method."""
    verdicts = {}
    for repo, rows in itertools.groupby(sorted(events), key=lambda e: e[0]):
        vote = bare = 0
        for _, methods in itertools.groupby(rows, key=lambda e: e[1]):
            for *_, kind in methods:
                if kind == repos.ERROR or abs(vote) >= votes:
                    break
                if kind == repos.NO_DOC:
                    bare += 1
                elif kind == repos.MATCH:
                    vote, bare = vote + 1, 0
                else:
                    vote -= 1
            if abs(vote) >= votes or bare >= streak:
                break
        verdicts[repo] = "keep" if vote >= votes else "drop" if vote <= -votes else "undecided"
    return verdicts


@pytest.mark.parametrize("block", [1, 3, 64])
@pytest.mark.parametrize("streak", [4, 500])
def test_vote_equals_reading_in_order(spark, block, streak):
    rng = random.Random(block * streak)
    kinds = [repos.NO_DOC, repos.MATCH, repos.OTHER, repos.ERROR]
    events = []
    for repo in range(150):
        weights = [rng.random() + 0.1, rng.random(), rng.random(), 0.05]
        for file in range(rng.randrange(1, 9)):
            for method in range(rng.randrange(1, 12)):
                events.append((f"r{repo}", file * rng.choice([1, 1]), method, rng.choices(kinds, weights)[0]))
    df = spark.createDataFrame(events, "repo string, file_no int, method_no int, kind string")
    got = {r.repo: r.verdict for r in repos.language_vote(df, 5, streak, block).collect()}
    want = read_in_order(events, 5, streak)
    # A repository of which an error hides every method has no vote at all.
    assert {r: v for r, v in want.items() if v != "undecided"} == {r: v for r, v in got.items() if v != "undecided"}
    assert got.keys() <= want.keys()
    assert len(set(got.values())) == 3


def test_removal_is_by_evidence(spark):
    names = spark.createDataFrame([("few",), ("many",), ("unknown",), ("voted out",), ("undecided",)], "repo string")
    meta = spark.createDataFrame([("few", 1), ("many", 2), ("voted out", 9), ("undecided", 3)], "repo string, stargazers_count int")
    verdicts = spark.createDataFrame([("voted out", "drop"), ("undecided", "undecided"), ("many", "keep")], "repo string, verdict string")
    kept = {r.repo for r in repos.select_repositories(names, meta, verdicts).collect()}
    assert kept == {"many", "unknown", "undecided"}


def test_queries_are_combinations_in_order(spark):
    words = ["Liste", "größer", "Datei", "Fehler", "Methode"]
    df = spark.createDataFrame(list(enumerate(words)), "pos int, word string").repartition(3)
    for k in (1, 3, 5, 6):
        got = sorted(r.query for r in repos.keyword_queries(df, k).collect())
        assert got == sorted(" ".join(c) for c in itertools.combinations(words, k))


def test_trees_fall_back_to_main(spark):
    tree = "array<struct<path: string, url: string>>"
    trees = spark.createDataFrame(
        [("a", "master", [("x.java", "1"), ("y.md", "2"), ("z.java", "3")]), ("a", "main", [("m.java", "4")]), ("b", "main", [("m.java", "5")]), ("d", "master", [])],
        f"repo string, branch string, tree {tree}",
    )
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "repo string")
    got = sorted(((r.repo, r.branch, r.file_no, r.url) for r in repos.branch_files(trees, names).collect()), key=str)
    assert got == [("a", "master", 0, "1"), ("a", "master", 2, "3"), ("b", "main", 0, "5"), ("c", None, None, None), ("d", "master", None, None)]


def test_blobs_are_one_character_per_byte(spark):
    df = spark.createDataFrame([("w6kK",)], "c string")
    assert df.select(repos.decode_blob(F.col("c"))).first()[0] == "Ã©\n"


JAVA = '''package p;
import java.util.*;
/** Class doc. */
@Deprecated
public class A<T> extends B {
  private int[] a = {1, 2}; // field
  static { init("}"); }
  /** Constructor. */
  public A() { super(); }

  /** Adds. {@code x}
   * @param x one
   */
  @Override @SuppressWarnings({"a", "b"})
  public static <K, V> Map<K, List<V>> add(int x) throws E {
    /** not this one */
    if (x > 0) { return "{" + '}' ; } // }
    Runnable r = new Runnable() { public void run() { } };
    return null;
  }
  // plain
  int bare() { return 1; }
  abstract void later();
  /** after */
  interface I { /** Inner. */ void inner(int y); }
  Runnable f = () -> { go(); };
  /* block */ String last(char c) { return "a" + c; }
}
/** Top. */ void top() { }
'''


def test_methods_with_their_docs(spark):
    df = spark.createDataFrame([("r", 1, JAVA), ("r", 2, None), ("r", 3, "int x = ; } } {"), ("r", 4, "")], "repo string, file_no int, code string")
    rows = sorted(pairs.methods_with_docs(df).collect(), key=lambda r: (r.file_no, r.method_no))
    assert [(r.file_no, r.method_no) for r in rows] == [(1, n) for n in range(7)]
    assert rows.pop(1).code == "public void run() { }"
    names = [r.code.split("(")[-2 if "Warnings" in r.code else 0] for r in rows]
    assert [r.doc and " ".join(r.doc.split())[:12] for r in rows] == ["/** Adds. {@", None, "/** after */", "/** Inner. *", None, "/** Top. */"]
    assert rows[0].code.startswith("@Override") and rows[0].code.endswith("return null;\n  }")
    assert rows[2].code == "abstract void later();" and rows[4].code == 'String last(char c) { return "a" + c; }'
    assert names[1] == "int bare"


def test_doc_parts(spark):
    docs = ["/** Adds. */", "/**\n * One, two.\n * Three.\n *\n * Four.\n * @param x\n */", "/** @return x */", "/***/"]
    df = spark.createDataFrame([(i, d, "f() { /* c */ }") for i, d in enumerate(docs)], "id int, doc string, code string")
    rows = {r.id: r for r in pairs.doc_elements(df).collect()}
    assert {i: r.docstring_summary for i, r in rows.items()} == {0: "Adds.", 1: "One, two.\nThree."}
    assert rows[1].docstring_tokens == ["One", "two", "Three"]
    got = pairs.language_pairs(pairs.doc_elements(df).withColumn("lang", F.when(F.col("id") == 0, "de")), "lang", "de").collect()
    assert [r.function for r in got] == ["f() {   }"]


SHAPES = {
    # source: (start of the method, doc) of each method, in order
    "class A { /** d */ @X(y = @Z(1)) void f() { } }": [("@X(y", "/** d */")],
    "enum E { A { /** d */ void g() { } }, B(1) { void h() { } }, C; E(int... x) { } int z() { return 1; } }": [
        ("void g", "/** d */"), ("void h", None), ("int z", None),
    ],
    "class A { void f() { class L { /** d */ void l() { } } new L(); } }": [("void f", None), ("void l", "/** d */")],
    "class A { Foo x = go(new Foo<A>(1) { /** d */ void m() { } }), y = new Foo() { void n() { } }; }": [("void m", "/** d */"), ("void n", None)],
    "@interface I { int v() default 3; String[] w() default {\"a\"}; class K { void k() { } } }": [("void k", None)],
    'class A { String s = """\n void no() { "x" }\n \\""" void no() { }"""; void f() { } }': [("void f", None)],
    "class A { <T> A(T t) { } A() { this(1); } static { } { } int[] v = {1}, w[] = {{2}}; <T> T f(T t) { return t; } }": [("<T> T f", None)],
    "record R<T>(T a, int b) { R { check(a); } static int s() { return 1; } } class C { record P(int x) { int p() { return x; } } }": [
        ("static int s", None), ("int p", None),
    ],
    "sealed interface S permits Q { /** d */ void s(); default int t() { return 1; } } non-sealed class Q implements S { public void s() { } }": [
        ("void s", "/** d */"), ("default int t", None), ("public void s", None),
    ],
    "class A { Runnable r = () -> { go(); }; void f() { x(() -> { }); Class<?> c = A.class; if (a) { } switch (b) { case 1 -> { } } } void g(); }": [
        ("void f", None), ("void g", None),
    ],
    "class A { int f()[] { return new int[]{1, 2}; } /** after */ }": [("int f", "/** after */")],
    "class A { void f() { } // no\n /** late */ int x; /** g */ native long g(); /* block */ }": [("void f", None), ("native", "/** g */")],
    "} ) ; class A { void f( { } void g() { }": [],
}


@pytest.mark.parametrize("source", SHAPES)
def test_method_shapes(source):
    found = java.methods(source)
    wanted = SHAPES[source]
    if not wanted:
        return  # Not well-formed: no more than that it ends is asked for.
    doc = lambda m: next((c for c in (m.before, m.after) if c and java.is_doc(c)), None)
    assert [doc(m) for m in found] == [d for _, d in wanted]
    assert all(source[m.start : m.end].startswith(w) for m, (w, _) in zip(found, wanted, strict=True))
    assert all(source[m.end - 1] in "};" for m in found)


def test_methods_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BATCH_BYTES", 100)
    body = " ".join(f"int f{n}() {{ return {n}; }}" for n in range(50))
    df = spark.createDataFrame([(1, f"class A {{ {body} }}"), (2, "class B { }")], "id int, code string")
    rows = pairs.methods_with_docs(df).collect()
    assert [(r.id, r.method_no) for r in rows] == [(1, n) for n in range(50)] and rows[49].code == "int f49() { return 49; }"
