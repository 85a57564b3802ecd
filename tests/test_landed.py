import base64
import json

import pytest

from corpusloom.operators.language import train_profile
from corpusloom.plans import landed as plan
from corpusloom.sources import landed

ENGLISH = "the weather is good and the house is open with the windows"
GERMAN = "das Wetter ist schön und das Haus ist offen mit den Fenstern"


def source(*docs):
    return "class C {\n" + "\n".join(f"/** {d} */ void m{i}() {{ go(); }}" for i, d in enumerate(docs)) + "\n}"


def put(root, kind, *lines):
    (root / kind).mkdir(exist_ok=True)
    with open(root / kind / "part.json", "a") as out:
        out.writelines((line if isinstance(line, str) else json.dumps(line)) + "\n" for line in lines)


def page(*names):
    return {"status": 200, "items": [{"repository": {"full_name": n}, "score": 1} for n in names]}


def tree(repo, branch, *paths, status=200):
    return {"status": status, "repo": repo, "branch": branch, "tree": [{"path": p, "url": f"{repo}/{p}"} for p in paths]}


def blob(url, text, status=200):
    # A host cuts its base64 into lines.
    return {"status": status, "url": url, "content": base64.encodebytes(text if isinstance(text, bytes) else text.encode()).decode()}


@pytest.fixture
def root(tmp_path):
    put(tmp_path, "hits", page("a/german", "a/english"), page("a/english", "a/few", "a/silent"), '{"status": 200, "items": [{"rep', {"status": 403}, "", page())
    put(tmp_path, "hits", page("a/main", "a/refused", "a/bad"), {"status": 200})
    stars = {"a/german": 5, "a/english": 2, "a/few": 1, "a/main": 7, "a/refused": 7, "a/bad": 7, "not/named": 50}
    put(tmp_path, "metadata", *[{"repo": r, "stargazers_count": n} for r, n in stars.items()])
    put(tmp_path, "metadata", {"status": 404, "repo": "a/silent"}, {"repo": "a/bad", "stargazers_count": "many"})
    put(tmp_path, "trees", tree("a/german", "master", "x.md", "A.java"), tree("a/german", "main", "B.java"))
    put(tmp_path, "trees", tree("a/english", "master", "A.java"), tree("a/english", "master", "A.java"))
    put(tmp_path, "trees", {"status": 404, "repo": "a/main", "branch": "master"}, tree("a/main", "main", "A.java"))
    put(tmp_path, "trees", {"status": 500, "repo": "a/refused", "branch": "master"}, tree("a/refused", "main", "A.java"))
    put(tmp_path, "trees", tree("a/bad", "master", "A.java", "B.java", "C.java", "D.java"), tree("a/few", "master", "A.java"), tree("not/named", "master", "A.java"))
    put(tmp_path, "blobs", blob("a/german/A.java", source(*[GERMAN] * 6)), blob("a/english/A.java", source(*[ENGLISH] * 6)), blob("a/main/A.java", source(GERMAN)))
    put(tmp_path, "blobs", blob("a/bad/A.java", b"\xff\xfe class"), {"url": "a/bad/B.java", "content": "=?"}, blob("a/bad/C.java", "", 500))
    put(tmp_path, "blobs", blob("a/refused/A.java", "unread"), blob("a/german/A.java", ""), '{"url": "a/bad/D.java", "content": "')
    return str(tmp_path)


def counts(rows):
    return {(r["kind"], r["error"]): r["n"] for r in rows.collect()}


def test_every_failure_has_a_row(spark, root):
    found = plan.read_landing(spark, root, utf8=True)
    assert counts(found.failures()) == {
        ("hits", "malformed"): 1, ("hits", "refused"): 1, ("hits", "incomplete"): 1,
        ("metadata", "refused"): 1, ("metadata", "malformed"): 1,
        ("trees", "refused"): 2,
        ("blobs", "refused"): 1, ("blobs", "malformed"): 1,
        ("files", "no blob"): 2, ("files", "undecodable"): 2,
    }
    assert {r.repo for r in found.names.collect()} == {"a/german", "a/english", "a/few", "a/silent", "a/main", "a/refused", "a/bad"}
    assert {(r.repo, r.file_no) for r in found.sources().collect()} == {("a/german", 1), ("a/english", 0), ("a/main", 0)}


def test_a_character_a_byte_reads_any_bytes(spark, root):
    code = {r.path: r.code for r in plan.read_landing(spark, root).files.where("repo = 'a/bad'").collect()}
    assert code["A.java"] == "ÿþ class" and code["B.java"] is None


def test_reasons_do_not_depend_on_the_columns_read(spark, root):
    rows = landed.landed(spark, root, "metadata")
    whole = sorted(r.error or "" for r in rows.collect())
    assert sorted(r.error or "" for r in rows.select("error").collect()) == whole == [""] * 7 + ["malformed", "refused"]
    assert rows.where("error = 'malformed'").count() == 1


def test_chain_from_hits_to_pairs(spark, root):
    texts = spark.createDataFrame([(ENGLISH, "en"), (GERMAN, "de")], "text string, lang string")
    profile, languages = train_profile(texts)
    found = plan.read_landing(spark, root, utf8=True)
    kept = plan.landed_repositories(found, profile, languages, "de")
    # Few stars and a vote for English remove; without evidence a name stays.
    assert {r.repo for r in kept.collect()} == {"a/german", "a/silent", "a/main", "a/refused", "a/bad"}
    pairs = plan.landed_documentation(found, kept, profile, languages, "de").collect()
    assert sorted((r.repo, r.method_no) for r in pairs) == [("a/german", n) for n in range(6)] + [("a/main", 0)]
    assert {r.docstring_summary for r in pairs} == {GERMAN} and all(r.function.startswith("void m") for r in pairs)


def test_empty_landing(spark, tmp_path):
    for kind in landed.KINDS:
        put(tmp_path, kind)
    found = plan.read_landing(spark, str(tmp_path))
    assert found.failures().count() == found.names.count() == found.sources().count() == 0
