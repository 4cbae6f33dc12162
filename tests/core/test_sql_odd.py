"""Queries against their SQL on small tables with odd values."""

import duckdb

from talentloom.plans import catalog


def same(spark, folder, name, **tables):
    """The rows of the query, which must be those of its SQL. tables: DataFrames."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rows = catalog.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    got = sorted([tuple(r) for r in rows.collect()], key=repr)
    assert got == sorted(want, key=repr)
    return got


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_lines_keep_digits_at_their_ends(spark, tmp_path):
    """a line's own number was cut from its ends, spaces were not; 57 of 800 is a half behind the fourth digit."""
    got = same(spark, tmp_path, "doc_quality_signals", documents=texts(spark, "0 ab 10\n 1 cd 1 ", None, "", " \n ", "é" * 57 + "a" * 743))
    assert got[0][1:3] == (14, 3)


def test_capitals_spell_no_new_letters(spark, tmp_path):
    """`ch ß` became the label CH SS, which the text holds by chance."""
    got = same(spark, tmp_path, "skill_labels", documents=texts(spark, "ch ß und noch ssehr viel ichss", "größe ﬁn und mehr", "Ähre éß 😀", None, "ẞa ß"))
    assert "CH SS" not in got[0][1]


def test_intervals_without_dates_stand_last(spark, tmp_path):
    """an order without a date or key was sorted first and opened an island of its own."""
    rows = [(4, 1, "1995-03-01"), (7, 1, None), (None, 1, "1995-03-01"), (None, 1, "1995-05-01"), (None, 1, "1999-05-01"), (5, 2, None), (3, None, "1996-01-01"), (None, None, None), (9, 3, "1996-01-31"), (11, 3, "1996-04-01")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string").selectExpr("o_orderkey", "o_custkey", "CAST(o_orderdate AS TIMESTAMP_NTZ) AS o_orderdate")
    same(spark, tmp_path, "interval_union_years", orders=orders)


#: Lines and sentences whose ends hold the digits of their own place, and blanks.
NUMBERED = ["0 Zero is 0\n 1 One is 1 \nIn 2 we Build 2! 3 Analyst 3? \n\n 4 and 4", None, "", " \n0", "0", "00. 11. 22. 3333 3", "Build 0.  you will 1.   2 "]


def test_job_texts_keep_digits(spark, tmp_path):
    """F4"""
    same(spark, tmp_path, "job_texts", documents=texts(spark, *NUMBERED, *[f"{'x' * n} 0. {'y' * n} 1\n2 {'z' * n} 2 " for n in range(20, 50)]))


def test_layout_sections_keep_digits(spark, tmp_path):
    """F5"""
    same(spark, tmp_path, "layout_sections", documents=texts(spark, *[x for x in NUMBERED if x is not None], *[f"{'x' * n} 0. {'y' * n} 1\n2 {'z' * n} 2 " for n in range(20, 50)]))


def test_line_shapes_keep_digits(spark, tmp_path):
    """F6"""
    same(spark, tmp_path, "line_shapes_whole", documents=texts(spark, *NUMBERED, *[f"{'x' * n} 0. {'y' * n} 1\n2 {'z' * n} 2 " for n in range(20, 50)]))


def test_line_shapes_of_odd_lines(spark, tmp_path):
    """Java's $ stood before a last carriage return, wide spaces stayed at the ends, edges of words and letters of other cases differed."""
    lines = ["Title one.\r", "Title two\r", "EDUCATION\r", "# Work Experience:\r", "Paris, France\r", "\u00a0EDUCATION\u00a0", "\u3000Skills \u2009", "a school\u00b2 b", "a \u00e9school b", "a school\u0301 b", "an in\u017ftitute of arts", "a \u017fep 2020", "lin\u212aedin.com here",
             "EXPER\u0130ENCE", "PROF\u0130LE", "\u0131nstitute \u0130nstitute", "Ends. \r", "\tTab first\t", "Ends?\u2028", "Ends!\u0085", "Profile:\u00a0", "a, b, c, d\x0b"]
    got = same(spark, tmp_path, "line_shapes_whole", documents=texts(spark, *lines, "\r\n".join(lines), "\n".join(lines), None))
    assert got[0][2] == "title" and {r[0]: r[2] for r in got}[7] == "text"
