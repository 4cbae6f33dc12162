from pyspark.sql import functions as F

from talentloom.operators import copilot as B


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv long, turn long, text string")


def tools(spark):
    pool = spark.createDataFrame([("Data Engineer", f"c{i}", i, 1 - i / 20, "review_needed" if i == 2 else None) for i in range(1, 13)], "role string, candidate_id string, rank int, score double, status string")
    cards = spark.createDataFrame([("c1", "recommended"), ("c3", None)], "candidate_id string, card_status string")
    plain = spark.createDataFrame([("c1", 0.5, ["SQL", "Go", "R", "C"]), ("c2", 0.25, [])], "candidate_id string, score double, gaps array<string>")
    graph = spark.createDataFrame([("c2", 0.75, ["Rust"])], "candidate_id string, score double, gaps array<string>")
    return pool, cards, plain, graph


def test_roles_and_numbers_of_messages(spark):
    cases = [
        ("Find a DATA ENGINEER, top 3", "Data Engineer", 3),
        ("analyste data svp", "Data Analyst", 5),
        ("machine learning or devops", "Machine Learning Engineer", 5),
        ("a fullstack dev TOP10", "Full Stack Developer", 10),
        ("front-end, top 0", "Frontend Developer", 1),
        ("top 99999999999999999999999 backend", "Backend Developer", 10),
        ("laptop 3", "Backend Developer", 5),
        (None, "Backend Developer", 5),
    ]
    got = B.understand(messages(spark, [(i, 0, c[0]) for i, c in enumerate(cases)]), "conv", "turn", "text").orderBy("conv").collect()
    assert [(r["target_role"], r["top_k"]) for r in got] == [c[1:] for c in cases]
    assert got[0]["sources"] == ["user_message"] and got[-1]["job_description"] == ""


def test_a_number_holds_for_later_messages_of_its_conversation(spark):
    rows = [(1, 0, "hello"), (1, 1, "top 2"), (1, 2, "and now"), (1, 3, "top 7"), (2, 0, "hi")]
    got = B.understand(messages(spark, rows), "conv", "turn", "text").orderBy("conv", "turn").collect()
    assert [r["top_k"] for r in got] == [5, 2, 2, 7, 5]


def test_all_nodes_and_the_answer(spark):
    out = B.answer(messages(spark, [(1, 0, "a data engineer top 7")]), "conv", "turn", "text", *tools(spark)).first()
    assert [c["candidate_id"] for c in out["candidates"]] == [f"c{i}" for i in range(1, 8)]
    assert [c["candidate_id"] for c in out["cards"]] == ["c1", "c3"]
    assert [w for w in out["warnings"]] == [f"decision card missing for c{i}: not found" for i in (2, 4, 5)]
    assert [(m["candidate_id"], m["selected_source"]) for m in out["transferability"]] == [("c1", "yaml"), ("c2", "neo4j"), ("c3", "yaml"), ("c4", "yaml"), ("c5", "yaml")]
    assert out["sources"] == ["user_message", "match_candidates", "get_decision_card", "get_transferability", "get_neo4j_transferability"]
    lines = out["answer"].split("\n")
    assert lines[0] == B.SAYS["asked"] + "a data engineer top 7" and lines[1] == "Role cible estime: Data Engineer."
    assert "1. `c1` - rang V3 1; score V3 0.9500; statut recommended; transferabilite 0.5000; gaps bloquants: SQL, Go, R" in lines
    assert "2. `c2` - rang V3 2; score V3 0.9000; statut review_needed; transferabilite 0.7500; gaps bloquants: Rust" in lines
    assert "- `c2`: statut review_needed dans les donnees disponibles." in lines and not any("c6" in x for x in lines)


def test_without_candidates_nothing_is_recommended(spark):
    out = B.answer(messages(spark, [(1, 0, "devops")]), "conv", "turn", "text", *tools(spark)).first()
    assert out["candidates"] == [] and out["answer"].endswith(B.SAYS["none"][1])


def test_tools_that_fail_leave_warnings_and_the_rest_goes_on(spark):
    def broken():
        raise ConnectionError("no server")

    pool, cards, plain, graph = tools(spark)
    out = B.answer(messages(spark, [(1, 0, "data engineer top 2")]), "conv", "turn", "text", pool, broken, broken, broken).first()
    assert len(out["candidates"]) == 2 and out["cards"] == [] and len(out["warnings"]) == 4 and all("no server" in w for w in out["warnings"])
    assert {m["selected_source"] for m in out["transferability"]} == {"yaml"} and "rang V3 1" in out["answer"]
    out = B.answer(messages(spark, [(1, 0, "data engineer")]), "conv", "turn", "text", broken, cards, plain, graph).first()
    assert out["warnings"] == ["match_candidates failed: ConnectionError: no server"] and B.SAYS["none"][0] in out["answer"]


def test_messages_without_conversation_and_empty_tables(spark):
    out = B.answer(messages(spark, [(None, None, "data engineer top 1")]), "conv", "turn", "text", *tools(spark)).first()
    assert len(out["cards"]) == 1
    assert B.answer(messages(spark, []), "conv", "turn", "text", *tools(spark)).where(F.lit(True)).count() == 0
