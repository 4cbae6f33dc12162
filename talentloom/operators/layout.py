"""Layout of pages: columns, sections, their items, and the block that each fragment of a section rests on.

Blocks are rows (key, page_no, idx, text, l, r, t, b, page_width, page_height); y grows upwards. Everything is windows by document or page,
which spill: no document is gathered before its sections are built. All windows hold the document in their key, so blocks are shuffled by
document, and nothing is joined. The parts of that shuffle grow with the blocks' bytes, so that a task's memory does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.functions.text import collapse

# Section names, the words that tell them, and the signs of lines.
SECTION_TITLES = [
    "PROFESSIONAL SUMMARY", "EDUCATION", "TECHNICAL SKILLS", "PROFESSIONAL EXPERIENCE", "ACADEMIC PROJECTS", "LANGUAGES", "SOFT SKILLS", "CERTIFICATES (IN PROGRESS)", "MACHINE LEARNING & DEEP LEARNING",
    "COMPUTER VISION & NATURAL LANGUAGE PROCESSING (NLP)", "IDES & SOFTWARE",
]
SECTION_KEYWORDS = [
    ("PROFESSIONAL SUMMARY", ["professional summary", "summary", "profil", "profile"]),
    ("EDUCATION", ["education", "formation", "études", "etudes", "diplôme", "diplome"]),
    ("TECHNICAL SKILLS", ["technical skills", "skills", "compétences", "competences", "programming languages", "mlops", "deployment", "devops", "data engineering", "databases", "frameworks", "tools", "ides", "software", "cloud"]),
    ("PROFESSIONAL EXPERIENCE", ["professional experience", "experience", "expérience", "experiences"]),
    ("ACADEMIC PROJECTS", ["academic projects", "projects", "projets", "project"]),
    ("LANGUAGES", ["languages", "langues"]),
    ("SOFT SKILLS", ["soft skills", "skills", "qualités", "qualites"]),
    ("CERTIFICATES (IN PROGRESS)", ["certificates", "certifications", "certificats"]),
    ("MACHINE LEARNING & DEEP LEARNING", ["machine learning", "deep learning"]),
    ("COMPUTER VISION & NATURAL LANGUAGE PROCESSING (NLP)", ["computer vision", "nlp", "natural language processing"]),
    ("IDES & SOFTWARE", ["ides", "software"]),
]
ITEM_SECTIONS = ["PROFESSIONAL EXPERIENCE", "EDUCATION", "ACADEMIC PROJECTS"]
WORK_SECTIONS = ["PROFESSIONAL EXPERIENCE", "ACADEMIC PROJECTS"]
SKILL_SECTIONS = ["TECHNICAL SKILLS", "MACHINE LEARNING & DEEP LEARNING", "COMPUTER VISION & NATURAL LANGUAGE PROCESSING (NLP)", "IDES & SOFTWARE"]
TITLE_HINTS = ["Intern", "Training", "Degree", "University", "Project", "Studies", "Baccalaur"]
DETAIL_VERBS = ["Built", "Implemented", "Delivered", "Developed", "Used", "Added", "Versioned", "Wrapped", "Designed", "Created"]
DETAIL_HINTS = ["pcap", "oca", "prep", "training"]
SKILL_PREFIXES = ["cloud (aws)", "python:", "databases:", "frameworks", "tools:", "devops", "mlops", "deployment", "big data", "etl", "bi & etl tools", "data engineering"]
TOOL_NAMES = ["Frameworks", "Tools", "Databases", "Python", "TensorFlow", "Keras", "PyTorch", "Apache", "Spark", "SQL"]
DEGREE_WORDS = ["degree", "university", "baccalaur", "studies"]
DATE_SIGN = r"(?i)(?:19|20)\d{2}\s*[-–]\s*(?:19|20)\d{2}|\b(?:19|20)\d{2}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b.*\b(?:19|20)\d{2}\b"
PLACE_SIGN = r"\b[A-Z][a-zA-Z]+,\s*[A-Z][a-zA-Z]+"
DATE_THEN_PLACE = r"^(.+?\d)\s+([A-Z][^,]+,\s*[A-Z][^,]+)$"

#: Bytes of blocks in one part: every window sorts a part again, so a task holds several times that.
PART_BYTES, BLOCK_BYTES = 96 << 20, 256

HEADER = "HEADER"
SLOTS = ["line", "title", "date", "location", "detail"]


def _any(text: Column, words: list[str], test=Column.contains) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | test(text, w)
    return out


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def all_upper(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def is_title(text: Column) -> Column:
    """A known section name, or two to six words in capitals."""
    return F.upper(F.trim(text)).isin(SECTION_TITLES) | (all_upper(text) & word_count(text).between(2, 6))


def named_section(text: Column) -> Column:
    """The first section one of whose words occurs in the text, or null."""
    low = F.lower(F.trim(text))
    return F.coalesce(*[F.when(_any(low, words), title) for title, words in SECTION_KEYWORDS])


def short_heading(text: Column) -> Column:
    """The section that a line of at most four words opens in a document without geometry, or null."""
    return F.when(word_count(text) <= 4, F.coalesce(named_section(text), F.when(all_upper(text), F.upper(F.trim(text)))))


def is_date(text: Column) -> Column:
    return text.rlike(DATE_SIGN) & (F.length(text) <= 40)


def is_place(text: Column) -> Column:
    return ~text.contains(":") & ~_any(text, TOOL_NAMES) & text.rlike(PLACE_SIGN) & (F.length(text) <= 40)


def opens_item(text: Column) -> Column:
    return ~text.startswith("-") & (text.contains("|") | text.contains(",") | _any(text, TITLE_HINTS))


def is_skill_line(text: Column) -> Column:
    return _any(F.lower(F.trim(text)), SKILL_PREFIXES, Column.startswith) | ((text.contains(":") | text.contains("|")) & (word_count(text) <= 8))


def is_work_detail(text: Column) -> Column:
    return _any(text, DETAIL_VERBS) | _any(F.lower(text), DETAIL_HINTS)


def parts_of(blocks: DataFrame) -> int:
    """How many parts the blocks are dealt to: enough that one holds about PART_BYTES, a block weighing its text and BLOCK_BYTES for the rest."""
    size = blocks.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(BLOCK_BYTES)).alias("n")).first()["n"] or 0
    return max(int(size) // PART_BYTES + 1, blocks.sparkSession.sparkContext.defaultParallelism)


def located(blocks: DataFrame, key: str = "doc_id", by_index: bool = False, parts: int | None = None) -> DataFrame:
    """Blocks that say something, with centre, side (`full`, `left`, `right`) and place in reading order.

    A block is `full` if it is as wide as 85 % of its page or stands in the top tenth; others go by the middle one of the page's centres.
    Missing coordinates count as 0, a missing page as 1; ties go by idx. With by_index the place follows idx alone. parts: as parts_of counts them,
    which is done here where they are not given.
    """
    parts = parts or parts_of(blocks)
    page = Window.partitionBy(key, "page_no")
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    b = blocks.select(key, F.greatest(F.coalesce(F.col("page_no").cast("int"), F.lit(1)), F.lit(1)).alias("page_no"), "idx", F.trim("text").alias("text"), *[num(c).alias(c) for c in ("l", "r", "t", "b", "page_width", "page_height")])
    b = b.where("text <> ''").repartition(parts, key).withColumns({"x": (F.col("l") + F.col("r")) / 2, "y": (F.col("t") + F.col("b")) / 2})
    b = b.withColumns({"nth": F.row_number().over(page.orderBy("x", "idx")), "of": F.count(F.lit(1)).over(page)})
    b = b.withColumn("mid", F.max(F.when(F.col("nth") == F.floor(F.col("of") / 2) + 1, F.col("x"))).over(page))
    top = (F.col("page_height") > 0) & (F.col("y") >= 0.9 * F.col("page_height"))
    wide = (F.col("page_width") > 0) & (F.col("r") - F.col("l") >= 0.85 * F.col("page_width"))
    side = F.when(top | wide, "full").when(F.col("x") <= F.col("mid"), "left").otherwise("right")
    order = ["idx"] if by_index else ["page_no", F.desc("y"), "idx"]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return b.withColumns({"side": side, "place": place}).drop("nth", "of", "mid", "x")


def sectioned(b: DataFrame, key: str = "doc_id", by_index: bool = False) -> DataFrame:
    """Located blocks with `opens` (the section that the block names), `section`, and `content` (false for headings).

    With geometry a block belongs to the nearest heading at or above it in its own column of the page, else in any column of the page, else to
    the header. A keyword inside a line opens a section too, and that line stays content. Without geometry sections run on until the next short
    heading or line with a degree and a year; a bare section name is passed over there and opens none.
    """
    text = F.col("text")
    titled = is_title(text)
    found = lambda c: F.when(c.isNotNull(), F.struct(c.alias("section"), "rank"))
    if by_index:
        short = F.when(~titled, short_heading(text))
        degree = _any(F.lower(text), DEGREE_WORDS) & (text.contains("20") | text.contains("19")) & ~titled & ~((F.col("side") == "right") & (is_date(text) | is_place(text)))
        anchor = F.coalesce(short, F.when(degree, "EDUCATION"))
        b = b.withColumns({"content": ~titled & short.isNull(), "anchor": anchor, "opens": F.coalesce(F.when(titled, F.upper(text)), named_section(text))})
        # a line may name one section and open another: ranks are those of the names that open
        b = b.withColumn("opens", F.coalesce("anchor", "opens"))
        b = b.withColumn("rank", F.min("place").over(Window.partitionBy(key, "opens")))
        into = F.last(found(F.col("anchor")), ignorenulls=True).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    else:
        b = b.withColumns({"content": ~titled, "opens": F.coalesce(F.when(titled, F.upper(text)), named_section(text))})
        b = b.withColumn("rank", F.min("place").over(Window.partitionBy(key, "opens")))
        nearest = F.when(F.col("opens").isNotNull(), F.struct("y", "place"))
        above = lambda *cols: F.min_by(found(F.col("opens")), nearest).over(Window.partitionBy(key, "page_no", *cols).orderBy(F.desc("y")).rangeBetween(Window.unboundedPreceding, 0))
        into = F.coalesce(above("side"), above())
    summary = F.max(F.when(F.col("opens") == "PROFESSIONAL SUMMARY", F.col("rank"))).over(Window.partitionBy(key))
    b = b.withColumns({"into": into, "summary_rank": summary})
    return b.withColumns({"section": F.coalesce(F.col("into.section"), F.lit(HEADER)), "rank": F.coalesce(F.col("into.rank"), F.lit(0))}).drop("into", "anchor")


def _nearest(b: DataFrame, key: str, item: Column) -> Column:
    """struct(rank, item, section) of the item nearest in height within the document, the first of equals; null if there is none."""
    up = Window.partitionBy(key).orderBy(F.desc("y")).rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy("y").rangeBetween(Window.unboundedPreceding, 0)
    over = F.min(F.when(item, F.struct("y", "rank", "item", "section"))).over(up)
    under = F.max(F.when(item, F.struct(F.col("y"), (-F.col("rank")).alias("rank"), (-F.col("item")).alias("item"), F.col("section")))).over(down)
    under = F.when(under.isNotNull(), F.struct(under["y"].alias("y"), (-under["rank"]).alias("rank"), (-under["item"]).alias("item"), under["section"].alias("section")))
    near, far = F.col("y") - under["y"], over["y"] - F.col("y")
    first = F.struct(under["rank"], under["item"]) < F.struct(over["rank"], over["item"])
    return F.when(over.isNull() | (near < far) | ((near == far) & first), under).otherwise(over)


def fragments(blocks: DataFrame, key: str = "doc_id", by_index: bool = False, parts: int | None = None) -> DataFrame:
    """One row per fragment: key, rank and name of its section, item (0: none), slot (line, title, date, location, detail), place, moved, text.

    Dates and places in the right column go to the nearest item that has none yet; a date with a place behind it is split where the item has no
    place; long header lines move to the summary, where there is one; signs of work among skills move to the nearest work item. Dates and places
    that no item takes, or that a later one of their item replaces, keep a row whose slot and section are null: no block is lost.
    """
    text = F.col("text")
    b = sectioned(located(blocks, key, by_index, parts), key, by_index)
    b = b.where("content")
    loose = F.when(F.col("side") == "right", F.when(is_date(text), "date").when(is_place(text), "location"))
    b = b.withColumn("loose", loose)
    held = F.col("section").isin(ITEM_SECTIONS) & F.col("loose").isNull()
    b = b.withColumn("slot", F.when(held, F.when(opens_item(text), "title").when(is_date(text), "date").when(is_place(text), "location").otherwise("detail")).otherwise("line"))
    b = b.withColumn("item", F.sum(F.when(F.col("slot") == "title", 1).otherwise(0)).over(Window.partitionBy(key, "section").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    b = b.withColumn("item", F.when(held, F.col("item")).otherwise(0)).withColumn("slot", F.when(F.col("item") == 0, "line").otherwise(F.col("slot")))
    titled = (F.col("slot") == "title") & F.col("loose").isNull()
    work = titled & F.col("section").isin(WORK_SECTIONS)
    b = b.withColumns({"near": _nearest(b, key, titled), "near_work": _nearest(b, key, work)})
    to_item = F.col("loose").isNotNull() & F.col("near").isNotNull()
    to_summary = F.col("loose").isNull() & (F.col("section") == HEADER) & F.col("summary_rank").isNotNull() & (F.length("text") > 80) & ~text.contains("@") & ~text.contains("http")
    to_work = F.col("loose").isNull() & F.col("section").isin(SKILL_SECTIONS) & F.col("near_work").isNotNull() & is_work_detail(text) & ~is_skill_line(text)
    pick = lambda name, other: F.when(to_item, F.col("near")[name]).when(to_work, F.col("near_work")[name]).otherwise(other)
    b = b.select(
        key, "page_no", "idx", "y", "place", "text", "loose",
        pick("section", F.when(to_summary, "PROFESSIONAL SUMMARY").otherwise(F.col("section"))).alias("section"),
        pick("rank", F.when(to_summary, F.col("summary_rank")).otherwise(F.col("rank"))).alias("rank"),
        pick("item", F.col("item")).alias("item"),
        F.when(F.col("loose").isNotNull(), F.col("loose")).when(to_work, "detail").otherwise(F.col("slot")).alias("slot"),
        F.when(to_summary | to_work, 1).otherwise(0).alias("moved"),
        (F.col("loose").isNotNull() & F.col("near").isNull()).alias("homeless"),
    )
    # of an item's own dates the last stands; of loose ones the first, where there is no own one
    of_item = Window.partitionBy(key, "section", "item", "slot", "homeless")
    own = F.max(F.when(F.col("loose").isNull(), F.col("place"))).over(of_item)
    given = F.min(F.when(F.col("loose").isNotNull(), F.col("place"))).over(of_item)
    single = F.col("slot").isin("date", "location")
    stays = ~F.col("homeless") & (~single | (F.col("place") == F.coalesce(own, given)))
    b = b.withColumn("stays", stays)
    has_place = F.max(F.when(F.col("stays") & (F.col("slot") == "location"), 1).otherwise(0)).over(Window.partitionBy(key, "section", "item"))
    fused = F.col("stays") & (F.col("slot") == "date") & (has_place == 0) & text.rlike(DATE_THEN_PLACE)
    b = b.withColumn("fused", fused)
    part = lambda slot, t: F.struct(slot.alias("slot"), t.alias("text"))
    pieces = F.when(
        F.col("fused"), F.array(*[part(F.lit(s), F.trim(F.regexp_extract("text", DATE_THEN_PLACE, i))) for i, s in ((1, "date"), (2, "location"))])
    ).otherwise(F.array(part(F.when(F.col("stays"), F.col("slot")), F.when(F.col("stays") & (F.col("slot") == "detail") & (F.col("moved") == 0), F.trim(F.regexp_replace("text", r"^(-[- ]*)", ""))).otherwise(text))))
    b = b.withColumn("part", F.explode(pieces))
    keep = lambda c: F.when(F.col("stays"), F.col(c))
    return b.select(key, keep("rank").alias("rank"), keep("section").alias("section"), keep("item").alias("item"), F.col("part.slot").alias("slot"), "place", "moved", F.coalesce(collapse(F.col("part.text")), F.lit("")).alias("text"))


def evidence(found: DataFrame, blocks: DataFrame, key: str = "doc_id", by_index: bool = False, parts: int | None = None) -> DataFrame:
    """Fragments of sections with the block they rest on: page_no, idx, box, offset in the text read in order; a fallback on page 1 where none says the same.

    The nth fragment with a text rests on the nth block with that text, further ones on the last: fragments and blocks go by
    their numbers in one window, each fragment behind the block it rests on.
    """
    parts = parts or parts_of(blocks)
    said = located(blocks, key, by_index, parts).withColumn("said", collapse(F.col("text")))
    start = F.coalesce(F.sum(F.length("said") + 1).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    box = F.struct(F.least("l", "r").alias("left"), F.least("t", "b").alias("top"), F.greatest("l", "r").alias("right"), F.greatest("t", "b").alias("bottom"))
    spots = said.withColumn("start", start)
    spots = spots.select(key, F.col("said").alias("text"), "place", F.struct("page_no", "idx", box.alias("box"), "start").alias("spot"))
    slot = F.coalesce(*[F.when(F.col("slot") == s, i) for i, s in enumerate(SLOTS)])
    both = found.where("slot is not null and text <> ''").unionByName(spots, allowMissingColumns=True).repartition(parts, key)
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy(key, "text", F.col("spot").isNull()).orderBy("rank", "item", slot, "moved", "place")))
    last = F.last("spot", ignorenulls=True).over(Window.partitionBy(key, "text").orderBy("nth", F.col("spot").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    used = both.withColumns({"at": last, "is_part": F.col("spot").isNull()}).where("is_part")
    return used.select(
        key, "rank", "section", "item", "slot", "moved", "place", "text", F.coalesce("at.page_no", F.lit(1)).alias("page_no"), F.col("at.idx").alias("idx"), F.col("at.box").alias("box"), F.col("at.start").alias("start"),
        F.col("at").isNull().alias("fallback"),
    )


def logical_sections(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per section that holds something: key, rank, section, lines, items (title, date, location, details), n_spans, n_fallback."""
    of = lambda s: F.collect_list(F.when(F.col("slot") == s, F.struct("moved", "place", "text")))
    one = lambda s: F.max(F.when(F.col("slot") == s, F.col("text")))
    texts = lambda c: F.transform(F.array_sort(c), lambda x: x["text"])
    spread = [F.count(F.lit(1)).alias("spans"), F.sum(F.col("fallback").cast("int")).alias("without")]
    items = spans.groupBy(key, "rank", "section", "item").agg(texts(of("line")).alias("lines"), one("title").alias("title"), one("date").alias("date"), one("location").alias("location"), texts(of("detail")).alias("details"), *spread)
    whole = F.array_sort(F.collect_list(F.when(F.col("item") > 0, F.struct("item", "title", "date", "location", "details"))))
    return items.groupBy(key, "rank", "section").agg(
        F.flatten(F.collect_list("lines")).alias("lines"),
        F.transform(whole, lambda x: F.struct(x["title"].alias("title"), x["date"].alias("date"), x["location"].alias("location"), x["details"].alias("details"))).alias("items"),
        F.sum("spans").alias("n_spans"), F.sum("without").alias("n_fallback"),
    )
