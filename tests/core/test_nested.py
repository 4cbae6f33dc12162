import json
import random
import re

from pyspark.sql import functions as F

from talentloom.operators import grounding as G
from talentloom.operators import json_tree as J

SCHEMA = """bio struct<full_name:string,email:string>, summary string, skills array<string>,
jobs array<struct<company:string,year:int,duties:array<string>,projects:array<struct<name:string,tools:array<string>>>>>"""


def plain_support(value, source):
    if value is None or str(value).strip() == "":
        return "missing"
    tight = lambda x: re.sub("[^a-z0-9]+", "", x.lower())
    words = {t for t in re.findall(r"[a-z0-9][a-z0-9+.#/@-]*", str(value).lower()) if len(t) > 1 and t not in ("and", "the", "with", "for", "from")}
    if tight(str(value)) and tight(str(value)) in tight(source):
        return "supported"
    if not words:
        return "missing"
    return "weakly_supported" if sum(t in source.lower() for t in words) / len(words) >= 0.8 else "unsupported"


def plain(value, source, path=""):
    """(what stays, supported, unsupported, nullified) by recursion over Python objects."""
    if isinstance(value, dict):
        out, lists = {}, ([], [], [])
        for k, v in value.items():
            out[k], *more = plain(v, source, f"{path}.{k}" if path else k)
            for a, b in zip(lists, more, strict=True):
                a.extend(b)
        return out, *lists
    if isinstance(value, list):
        out, lists = [], ([], [], [])
        for i, v in enumerate(value):
            kept, *more = plain(v, source, f"{path}[{i}]")
            if more[0]:
                out.append(kept)
            elif isinstance(v, dict):
                more[2].append(f"{path}[{i}]")
            for a, b in zip(lists, more, strict=True):
                a.extend(b)
        return out, *lists
    state = plain_support(value, source)
    bad = [path] if state == "unsupported" else []
    return (None if bad else value), [path] if state in ("supported", "weakly_supported") else [], bad, list(bad)


def random_profile(rng, words):
    some = lambda: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 4)))])
    job = lambda: {"company": some(), "year": rng.choice([None, 2019, 7]), "duties": [some() for _ in range(rng.randrange(3))], "projects": [{"name": some(), "tools": [some()]} for _ in range(rng.randrange(3))]}
    return {"bio": {"full_name": some(), "email": some()}, "summary": some(), "skills": [some() for _ in range(rng.randrange(4))], "jobs": [job() for _ in range(rng.randrange(4))]}


def test_nested_grounding_equals_a_plain_walk(spark):
    rng = random.Random(2)
    words = ["Ann", "spark", "c++", "Tunis", "data", "zebra", "quux", "e.g", "the"]
    cases = [(i, random_profile(rng, words), "Ann knows Spark, C++ and data in 2019; Tunis") for i in range(60)]
    df = spark.createDataFrame(cases, f"id int, profile struct<{', '.join(re.sub(r'^([a-z]+) ', r'\1:', x) for x in re.split(r', (?![^<]*>)', SCHEMA.replace(chr(10), ' ')))}>, source string")
    for r in G.ground_nested(df, "profile", "source").collect():
        kept, good, bad, gone = plain(cases[r["id"]][1], cases[r["id"]][2])
        assert r["profile"].asDict(recursive=True) == kept
        assert [sorted(set(x)) for x in (good, bad, gone)] == [r["fields_supported"], r["fields_unsupported"], r["fields_nullified"]]


def test_nested_grounding_of_nulls_and_other_rules(spark):
    df = spark.createDataFrame([(None, "x"), (({"full_name": "x", "email": None}, None, None, None), None)], f"profile struct<bio:struct<full_name:string,email:string>,summary:string,skills:array<string>,jobs:array<struct<company:string>>>, source string")  # noqa: F541
    a, b = G.ground_nested(df, "profile", "source").collect()
    assert a["profile"] is None and a["fields_supported"] == a["fields_unsupported"] == []
    assert b["profile"]["skills"] is None and b["profile"]["jobs"] is None
    never = lambda v, s, low, tight: F.lit("unsupported")
    told = G.ground_nested(spark.createDataFrame([(([("a",), ("b",)],), "a b")], "p struct<items:array<struct<name:string>>>, s string"), "p", "s", {"items[].name": never}).first()
    assert told["fields_nullified"] == ["items[0]", "items[0].name", "items[1]", "items[1].name"] and told["p"]["items"] == []


def nest(depth):
    doc = {"profile_id": "p", "module2_file_path": "f"}
    for k in range(depth):
        doc = {"a": doc} if k % 2 else [0, doc]
    return doc


def plain_metadata(doc, path=""):
    if isinstance(doc, dict):
        if doc.get("profile_id") and doc.get("module2_file_path"):
            yield path
        for k, v in doc.items():
            yield from plain_metadata(v, f"{path}.{k}" if path else k)
    elif isinstance(doc, list):
        for i, v in enumerate(doc):
            yield from plain_metadata(v, f"{path}[{i}]")


def test_search_finds_objects_at_every_depth(spark):
    docs = [nest(k) for k in (0, 1, 2, 7, 50)] + [[], {}, None, 3, "x", {"profile_id": 0, "module2_file_path": "f"}, {"profile_id": "p", "module2_file_path": []}, {"it's": {"a.b": nest(0)}}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, None), (91, "{broken"), (92, "")]
    got = sorted((r["id"], r["path"]) for r in J.profile_metadata(spark.createDataFrame(rows, "id int, doc string"), "id", "doc").collect())
    assert got == sorted((i, p) for i, d in enumerate(docs) for p in plain_metadata(d))
    assert J.values(spark.createDataFrame([], "id int, doc string"), "id", "doc").count() == 0


def test_either_key_of_a_profile_and_its_origin(spark):
    doc = {"a": {"profile_id": "", "matched_profile_id": "m", "candidate_id": 5}, "b": [{"profile_id": "p"}, {"profile_id": "q", "source_path": "s", "candidate_id": False}]}
    got = J.matching_metadata(spark.createDataFrame([(1, json.dumps(doc))], "id int, doc string"), "id", "doc").collect()
    assert sorted((r["path"], r["profile_id"], r["candidate_id"], r["source_path"]) for r in got) == [("a", "m", "5", None), ("b[1]", "q", None, "s")]


def test_clearing_rebuilds_documents_without_signs(spark):
    deep = nest(50)
    doc = {"a": "sign", "b": ["x", "sign", {"c": "sign", "d": ["sign", ["sign", 1, None]]}], "e": {}, "f": 1.5, "g": "é"}
    rows = [(1, json.dumps(doc)), (2, '"sign"'), (3, None), (4, "{broken"), (5, json.dumps(deep))]
    got = {r["id"]: r for r in J.clear_strings(spark.createDataFrame(rows, "id int, doc string"), "id", "doc", lambda s: s == "sign").collect()}
    assert json.loads(got[1]["doc"]) == {"a": None, "b": ["x", {"c": None, "d": [[1, None]]}], "e": {}, "f": 1.5, "g": "é"}
    assert got[1]["nullified"] == ["a", "b[1]", "b[2].c", "b[2].d[0]", "b[2].d[1][0]"]
    assert json.loads(got[2]["doc"]) is None and got[2]["nullified"] == [""] and got[3]["doc"] is None and got[4]["doc"] == "{broken"
    assert json.loads(got[5]["doc"]) == deep


def test_documents_of_one_file_are_searched_by_many_tasks(spark):
    """every level stayed in as many parts as the input had."""
    from talentloom.operators import json_tree

    docs = spark.range(4000).coalesce(1).selectExpr("id", "concat('{\"a\":[', id, ',{\"b\":', id, '}]}') AS document")
    found = json_tree.values(docs, "id", "document")
    assert found.count() == 4000 * 5
    assert found.where("path = 'a[1]'").inputFiles() and len(found.where("depth = 3").select("path").inputFiles()) > 8


def test_only_what_is_found_is_written(spark):
    """every value of every level was written and then looked at, plain ones too."""
    rng = random.Random(5)
    pair = {"profile_id": "p", "module2_file_path": "f"}

    def some(depth):
        kind = rng.randrange(6 if depth else 2)
        if kind < 2:
            return rng.choice([None, 0, 1.5, "", "x", [], {}, pair, {"profile_id": 0, "module2_file_path": "f"}])
        inner = [some(depth - 1) for _ in range(rng.randrange(4))]
        return inner if kind < 4 else {f"k.{i}": v for i, v in enumerate(inner)} | (pair if rng.random() < 0.4 else {})

    docs = [{"a": [pair, "x"], **pair}, pair, [pair], "x", [], [[], pair], [["x", pair]], *(some(9) for _ in range(150))]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string")
    got = sorted((r["id"], r["path"]) for r in J.profile_metadata(rows, "id", "doc").select("id", "path").collect())
    assert got == sorted((i, p) for i, d in enumerate(docs) for p in plain_metadata(d)) and len(got) > 100
    found = J.profile_metadata(rows.where("id < 7"), "id", "doc")
    assert len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) == 1 and found.count() == 6
    assert all(r["depth"] == len(re.findall(r"[.\[]", "." + r["path"])) - r["path"].startswith("[") for r in found.where("path <> ''").collect())


def test_claims_take_their_words_from_the_start_of_a_text(spark, tmp_path, capsys):
    """every word of both texts was extracted, where the claims take the first sixteen."""
    from talentloom.plans import nested

    texts = [None, "", "  \t one", " a b ", " ".join(f"w{i}" for i in range(15)), " ".join(f"w{i}" for i in range(16)), "\n" + " \f".join(f"w{i}" for i in range(17)) + "\x0b", "\r\n" + " ".join(f"w{i}" for i in range(900)), "Größe x y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = nested.claimed_profiles(spark, str(tmp_path))
    rows.explain(True)
    assert "regexp_extract_all" not in capsys.readouterr().out
    found = {r["doc_id"]: r["profile"] for r in rows.collect()}
    for i, text in enumerate(texts):
        words = lambda t: [w for w in re.split(r"[ \t\n\r\f\x0b]+", t or "") if w]
        own, other = words(text), words(texts[i + 1] if i + 1 < len(texts) and texts[i + 1] is not None else text)
        p = found[i]
        assert p["bio"]["full_name"] == " ".join(own[:3]) and p["experiences"][0]["responsibilities"] == [" ".join(own[:12]), " ".join(other[:12])]
        assert p["experiences"][1]["responsibilities"] == [" ".join(other[12:16])] and p["expertise"]["hard_skills"][0] == (own[1] if len(own) > 1 else None)
