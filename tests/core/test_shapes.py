"""Fixed cases of line shapes, dates, links, repairs and support: each column expression on a few values."""

import pytest
from pyspark.sql import functions as F

from talentloom.functions import dates as D
from talentloom.functions import lines as L
from talentloom.functions import quality, repair
from talentloom.functions import text as X
from talentloom.operators import grounding
from talentloom.operators import profiles as P
from talentloom.operators import windows as W


def _apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.repartition(1).sortWithinPartitions("i").select(f(F.col("v"))).collect()]


STRINGS = {
    "url_identity": (L.url_identity, ["https://www.GitHub.com/ada/", "http://github.com/ada", "www.github.com/Ada.", "github.com/ada", "", None], ["github.com/ada"] * 4 + ["", None]),
    "date_phrase": (L.date_phrase, ["Acme, Jan 2019 - Mar 2020 Tunis", "from 03/2019 to present", "class of 2015", "no date", None], ["Jan 2019 - Mar 2020", "03/2019 to present", "2015", None, None]),
    "best_url": (lambda v: L.best_url(F.split(v, ";")), ["x.org;github.com/ada", "b.org", None], ["github.com/ada", "b.org", None]),
    "short_summary": (L.short_summary, ["One.  Two! Three.", "Results-driven expert in things", None], ["One. Two!", "Results-driven expert in things", None]),
    "generic_summary": (L.generic_summary, ["builds things that work well", "Results-driven expert in things", "", None], [False, True, False, None]),
    "masked_uri": (P.masked_uri, ["db://user:pass@host/x", "db://host/x", None], ["db://***@host/x", "db://host/x", None]),
    "join_spaced": (repair.join_spaced, ["S K I L L S here", "a b", "", None], ["SKILLS here", "a b", "", None]),
    "mojibake": (repair.mojibake, ["cafÃ©", "plain", "naïve", "日本", None], ["café", "plain", "naïve", "日本", None]),
    "clean_lines": (repair.clean_lines, ["Title\n\n\n\nPage 3\n text   here \n--", "image\nkept line\n12/34", "", None], ["Title\n\ntext here", "kept line", "", None]),
    "normal_skill": (X.normal_skill, ["Node.js", "fast-api", "power_bi", "c++", "sql", " data  MESH "], ["Node.js", "FastAPI", "PowerBI", "C++", "SQL", "Data Mesh"]),
    "experience_value": (D.experience_value, ["5+", "3-5", "10 ans", "2020 - 2022", "present", "", None], [5.0, 4.0, 10.0, 2.0, None, None, None]),
    "month_index": (lambda v: D.month_index(v, True, 2026), ["03/2020", "2019", "Present", "soon", "13/2020", None], [2020 * 12 + 3, 2019 * 12 + 12, 2026 * 12 + 12, None, None, None]),
    "summary_support": (
        lambda v: grounding.summary_support(v, F.lit("engineer who designs pipelines and tests services")),
        ["Designs pipelines, tests!", "designs pipelines quickly alone mostly", "bakes bread", " ", None],
        ["supported", "weakly_supported", "unsupported", "missing", "missing"],
    ),
}


@pytest.mark.parametrize("name", sorted(STRINGS))
def test_fixed_cases(spark, name):
    f, values, want = STRINGS[name]
    assert _apply(spark, f, values) == want


def test_order_coherence_of_short_arrays(spark):
    assert [round(x, 6) for x in _apply(spark, W.order_coherence, [[], [3], [0, 2, 3, 1], [2, 1, 0]], "array<int>")] == [0.0, 1.0, round(4 / 6, 6), 0.0]


def test_template_signs_and_what_they_nullify(spark):
    values = ["Mail email@YourEmail.com", "first.last@x.org", "FIRST LAST", "see www.example.com/a", "Resume  Sample", 'x: "null"', "nullable énull", "call 000-000-0000", "Ada", "", None]
    want = [["email@youremail.com"], ["first.last@"], ["FIRSTLAST"], ["example.com"], ["resumesample"], ["null_text"], [], ["000-000-0000"], [], [], []]
    assert _apply(spark, quality.template_signs, values) == want
    kept, gone = quality.nullify_templates({"name": F.lit("First Last"), "city": F.lit("Tunis"), "none": F.lit(None).cast("string")})
    assert tuple(spark.range(1).select(*[v.alias(k) for k, v in kept.items()], gone.alias("gone")).first()) == (None, "Tunis", None, ["name"])
