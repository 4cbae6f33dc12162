import random
import re

import pytest
from pyspark.sql import functions as F

from talentloom.operators import layout as L

SCHEMA = "doc_id long, page_no int, idx int, text string, l double, r double, t double, b double, page_width double, page_height double"
PHRASES = [
    "EDUCATION", "Work experience", "TECHNICAL SKILLS", "ACADEMIC PROJECTS", "PROFESSIONAL SUMMARY", "My project at home", "Languages", "2019 - 2021", "Mar 2020", "2020 Lyon, France", "Paris, France", "Tunis, Tunisia",
    "Built a thing", "- Used a hammer", "-- plain", "Data Intern", "Bachelor, Some School", "Python: pandas", "tools: a | b", "words of no kind", "said twice", "said twice", "ALPHA BETA", "  ", "a@b.org " + "long " * 20, "long " * 20,
]


def heading(s):
    known = s.upper() in L.SECTION_TITLES or (s.isupper() and 2 <= len(s.split()) <= 6)
    return known, s.upper() if known else next((t for t, ws in L.SECTION_KEYWORDS if any(w in s.lower() for w in ws)), None)


def dated(s):
    return bool(re.search(L.DATE_SIGN, s)) and len(s) <= 40


def placed(s):
    return ":" not in s and not any(w in s for w in L.TOOL_NAMES) and bool(re.search(L.PLACE_SIGN, s)) and len(s) <= 40


def plain(rows):
    """One document's fragments by walking its blocks one after the other: {(rank, section, item, slot): texts in order} and the number of homeless blocks."""
    bs = []
    for _, page, idx, text, l, r, t, b, width, height in rows:
        text = (text or "").strip(" ")
        if text:
            bs.append(dict(page=page, idx=idx, text=text, x=(l + r) / 2, y=(t + b) / 2, w=r - l, pw=width, ph=height))
    for b in bs:
        xs = sorted(o["x"] for o in bs if o["page"] == b["page"])
        b["side"] = "full" if b["y"] >= 0.9 * b["ph"] or b["w"] >= 0.85 * b["pw"] else "left" if b["x"] <= xs[len(xs) // 2] else "right"
    bs.sort(key=lambda b: (b["page"], -b["y"], b["idx"]))
    ranks = {}
    for place, b in enumerate(bs, 1):
        b["place"] = place
        b["known"], b["opens"] = heading(b["text"])
        if b["opens"]:
            ranks.setdefault(b["opens"], place)
    lines, items, loose = [], [], []
    for b in bs:
        s = b["text"]
        if b["known"]:
            continue
        if b["side"] == "right" and (dated(s) or placed(s)):
            loose.append(("date" if dated(s) else "location", b))
            continue
        over = [h for h in bs if h["opens"] and h["page"] == b["page"] and h["y"] >= b["y"]]
        over = [h for h in over if h["side"] == b["side"]] or over
        name = min(over, key=lambda h: (h["y"], h["place"]))["opens"] if over else "HEADER"
        mine = [i for i in items if i["section"] == name]
        if name in L.ITEM_SECTIONS and not s.startswith("-") and ("|" in s or "," in s or any(h in s for h in L.TITLE_HINTS)):
            items.append(dict(section=name, rank=ranks[name], n=len(mine) + 1, y=b["y"], title=s, date=None, location=None, detail=[]))
        elif name in L.ITEM_SECTIONS and mine:
            if dated(s):
                mine[-1]["date"] = s
            elif placed(s):
                mine[-1]["location"] = s
            else:
                mine[-1]["detail"].append(s.lstrip("- ").strip() if s.startswith("-") else s)
        else:
            lines.append([name, b])
    items.sort(key=lambda i: (i["rank"], i["n"]))
    for slot, b in loose:
        if items:
            near = min(items, key=lambda i: abs(i["y"] - b["y"]))
            near[slot] = near[slot] or b["text"]
    for i in items:
        m = i["date"] and not i["location"] and re.match(L.DATE_THEN_PLACE, i["date"])
        if m:
            i["date"], i["location"] = m.group(1).strip(), m.group(2).strip()
    work = [i for i in items if i["section"] in L.WORK_SECTIONS]
    out, late = {}, []
    for name, b in lines:
        s = b["text"]
        skill = any(s.lower().startswith(p) for p in L.SKILL_PREFIXES) or ((":" in s or "|" in s) and len(s.split()) <= 8)
        if name == "HEADER" and "PROFESSIONAL SUMMARY" in ranks and len(s) > 80 and "@" not in s and "http" not in s:
            late.append(("PROFESSIONAL SUMMARY", s))
        elif name in L.SKILL_SECTIONS and work and not skill and (any(v in s for v in L.DETAIL_VERBS) or any(h in s.lower() for h in L.DETAIL_HINTS)):
            min(work, key=lambda i: abs(i["y"] - b["y"]))["detail"].append(s)
        else:
            out.setdefault((ranks.get(name, 0), name, 0, "line"), []).append(s)
    for name, s in late:
        out.setdefault((ranks[name], name, 0, "line"), []).append(s)
    for i in items:
        for slot in ("title", "date", "location", "detail"):
            if i[slot]:
                out[(i["rank"], i["section"], i["n"], slot)] = i[slot] if isinstance(i[slot], list) else [i[slot]]
    return {k: [" ".join(s.split()) for s in v] for k, v in out.items()}


def made(rng, doc, n):
    rows = []
    for k in range(n):
        left, wide = rng.random() < 0.5, rng.random() < 0.1
        y = float(rng.randrange(0, 800, 40))
        rows.append((doc, rng.randint(1, 2), k, rng.choice(PHRASES), 40.0 if left or wide else 320.0, 570.0 if wide or not left else 290.0, y, y, 600.0, 800.0))
    return rows


def gathered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["moved"], r["place"])):
        if r["slot"]:
            out.setdefault((r["rank"], r["section"], r["item"], r["slot"]), []).append(r["text"])
    return out


def test_fragments_equal_a_walk_over_blocks(spark):
    rng = random.Random(7)
    docs = {d: made(rng, d, rng.choice([1, 5, 20, 60])) for d in range(60)}
    got = {}
    for r in L.fragments(spark.createDataFrame([r for rows in docs.values() for r in rows], SCHEMA)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for d, rows in docs.items():
        want = plain(rows)
        assert gathered(got.get(d, [])) == {k: v for k, v in want.items() if v}, d


def test_no_block_is_lost_and_spans_name_their_blocks(spark):
    rng = random.Random(8)
    rows = [r for d in range(20) for r in made(rng, d, 40)]
    blocks = spark.createDataFrame(rows, SCHEMA)
    parts = L.fragments(blocks).cache()
    content = sum(1 for r in rows if r[3].strip() and not heading(r[3].strip())[0])
    assert parts.select("doc_id", "place").distinct().count() == content
    spans = L.evidence(parts, blocks).collect()
    assert len(spans) == parts.where("slot is not null").count()
    said = {(r[0], r[2]): r for r in rows}
    for s in spans:
        if not s["fallback"]:
            block = said[s["doc_id"], s["idx"]]
            assert " ".join(block[3].split()) == s["text"] and block[1] == s["page_no"] and s["box"]["left"] == block[4]
        else:
            assert (s["page_no"], s["idx"], s["box"]) == (1, None, None)
    assert {s["text"] for s in spans if s["fallback"]} <= {"Used a hammer", "plain", "2020", "Lyon, France"}


def test_uses_beyond_the_last_block_rest_on_it(spark):
    blocks = spark.createDataFrame([(1, 1, k, t, 0.0, 1.0, 9.0 - k, 9.0 - k, 600.0, 800.0) for k, t in enumerate(["same", "other", "same"])], SCHEMA)
    parts = spark.createDataFrame([(1, 0, "HEADER", 0, "line", k, 0, t) for k, t in enumerate(["same", "same", "same", "gone"])], "doc_id long, rank int, section string, item int, slot string, place int, moved int, text string")
    got = {r["place"]: (r["idx"], r["start"], r["fallback"]) for r in L.evidence(parts, blocks).collect()}
    assert got == {0: (0, 0, False), 1: (2, 11, False), 2: (2, 11, False), 3: (None, None, True)}


def test_without_geometry_sections_run_on(spark):
    texts = ["Ann Lee", "Experience", "Data Intern", "2020", "- Built x", "Master degree 2019", "kept", "Languages", "stays", "Spoken languages", "French", None, ""]
    blocks = spark.createDataFrame([(1, 1, k, t) + (None,) * 6 for k, t in enumerate(texts)], SCHEMA)
    s = {r["section"]: r for r in L.logical_sections(L.evidence(L.fragments(blocks, by_index=True), blocks, by_index=True)).collect()}
    assert s["HEADER"]["lines"] == ["Ann Lee"] and s["LANGUAGES"]["lines"] == ["French"] and s["EDUCATION"]["lines"] == ["Master degree 2019", "kept", "stays"]
    assert [tuple(i) for i in s["PROFESSIONAL EXPERIENCE"]["items"]] == [("Data Intern", "2020", None, ["Built x"])]
    assert sorted(s, key=lambda n: s[n]["rank"]) == ["HEADER", "PROFESSIONAL EXPERIENCE", "EDUCATION", "LANGUAGES"]


@pytest.mark.parametrize("rows", [[], [(1, None, 0, None, None, None, None, None, None, None)]])
def test_nothing_to_lay_out(spark, rows):
    blocks = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("side", F.lit("x")).withColumn("section", F.lit("y"))
    assert L.logical_sections(L.evidence(L.fragments(blocks), blocks)).count() == 0


def test_parts_grow_with_the_blocks(spark, monkeypatch):
    """the number of parts was the session's, so that a task's share, and its memory, grew with the input."""
    make = lambda n: spark.range(n).selectExpr("id % 50 AS doc_id", "1 AS page_no", "CAST(id AS INT) AS idx", "concat('Intern, line ', id) AS text", "40.0D AS l", "290.0D AS r", "700.0D - id AS t", "680.0D - id AS b", "600.0D AS page_width", "800.0D AS page_height")
    whole = {n: sorted(L.evidence(L.fragments(make(n)), make(n)).collect()) for n in (200, 2000)}
    monkeypatch.setattr(L, "PART_BYTES", 20_000)
    few, many = (L.located(make(n)).rdd.getNumPartitions() for n in (200, 2000))
    assert many > 5 * few
    for n, want in whole.items():
        assert sorted(L.evidence(L.fragments(make(n)), make(n)).collect()) == want
