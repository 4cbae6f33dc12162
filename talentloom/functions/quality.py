"""Document and markdown quality, status, routing and handoff rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.functions.scoring import clip01, round4

# Status thresholds (confidence, characters, completeness) by source kind.
OCR_VALIDATED, OCR_PARTIAL = (0.58, 500, 0.25), (0.38, 250, 0.15)
NATIVE_VALIDATED, NATIVE_PARTIAL = (0.72, 800, 0.45), (0.42, 300, 0.18)
OCR_FORMATS = ["images", "scans"]
SECTION_PATTERNS = {
    "experience": r"(?i)\b(experience|work experience|professional experience|internship|employment)\b",
    "education": r"(?i)\b(education|formation|degree|university|school|baccalaur|diploma)\b",
    "skills": r"(?i)\b(skills|technical skills|competences|programming|tools|frameworks)\b",
}


def confidence(chars: Column, completeness: Column, ordering: Column, segmentation: Column, block_score: Column, noise: Column, weird: Column, source_format: Column) -> Column:
    penalty = F.when(source_format.isin(OCR_FORMATS), noise * 0.7).otherwise(noise * 0.2)
    score = 0.28 * F.least(chars / 2500.0, F.lit(1.0)) + 0.24 * completeness + 0.18 * ordering + 0.16 * segmentation + 0.14 * block_score - 0.18 * penalty - 0.12 * weird
    return round4(clip01(score))


def warnings(chars: Column, completeness: Column, ordering: Column, segmentation: Column, noise: Column, weird: Column, source_format: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(chars < 350, "very_low_text_recovery").when(chars < 900, "low_text_recovery"),
            F.when(completeness < 0.35, "low_section_completeness").when(completeness < 0.55, "partial_section_completeness"),
            F.when(ordering < 0.6, "low_section_order_coherence"),
            F.when(segmentation < 0.45, "unstable_segmentation"),
            F.when(noise > F.when(source_format.isin(OCR_FORMATS), 0.28).otherwise(0.45), "high_ocr_noise"),
            F.when(weird > 0.35, "abnormal_section_titles"),
        )
    )


def status(score: Column, chars: Column, completeness: Column, flags: Column, source_format: Column) -> Column:
    meets = lambda t: (score >= t[0]) & (chars >= t[1]) & (completeness >= t[2])
    ocr = F.when(meets(OCR_VALIDATED) & ~F.array_contains(flags, "very_low_text_recovery"), "validated").when(meets(OCR_PARTIAL), "partial").otherwise("uncertain")
    native = F.when(meets(NATIVE_VALIDATED), "validated").when(meets(NATIVE_PARTIAL), "partial").otherwise("uncertain")
    return F.when(source_format.isin(OCR_FORMATS), ocr).otherwise(native)


def try_fallback(state: Column, chars: Column, completeness: Column, noise: Column, flags: Column, source_format: Column, ocr_required: Column) -> Column:
    low = (chars < 900) | (completeness < 0.5) | ((noise > 0.24) & (chars < 1400)) | F.arrays_overlap(flags, F.array(F.lit("very_low_text_recovery"), F.lit("high_ocr_noise")))
    return (state != "validated") & (source_format.isin(OCR_FORMATS) | ocr_required | F.coalesce(low, F.lit(False)))


def handoff(state: Column, source_format: Column, was_repaired: Column | None = None) -> Column:
    """The decision struct of a document's status: lane, eligibility, repair state, reasons, next action."""
    revalidated = F.coalesce(was_repaired, F.lit(False)) if was_repaired is not None else F.lit(False)

    def row(lane, eligible, repair, repair_reason, quarantine, action):
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(F.lit(lane).alias("lane"), F.lit(eligible).alias("eligible"), as_col(repair).alias("repair_status"), as_col(repair_reason).alias("repair_reason"), as_col(quarantine).alias("quarantine_reason"), F.lit(action).alias("next_action"))

    partial_reason = F.when(source_format.isin(OCR_FORMATS), "ocr_partial_requires_repair").otherwise("partial_document_requires_repair")
    return (
        F.when(state == "validated", row("accepted", True, F.when(revalidated, "revalidated").otherwise("not_applicable"), None, None, "consume_in_module2"))
        .when(state == "partial", row("repair_required", False, "pending_repair", partial_reason, None, "send_to_repair_queue"))
        .when(state == "uncertain", row("quarantined", False, "quarantined", None, "uncertain_document_blocked", "send_to_quarantine_queue"))
        .otherwise(row("quarantined", False, "quarantined", None, "failed_document_blocked", "send_to_quarantine_queue"))
    )


def markdown_signals(text: Column) -> dict[str, Column]:
    """Signals of a markdown text: sizes, sections found, odd characters, noisy and broken lines."""
    # F.trim takes what to trim as a second argument, which transform would fill with the place of the line
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    body = F.array_join(lines, "\n")
    words = F.regexp_extract_all(body, F.lit("([A-Za-z0-9]{2,})"), F.lit(1))
    # words are letters and digits: translate counts both without a regular expression per word
    letters = F.filter(F.transform(F.filter(words, lambda w: F.length(w) >= 8), lambda w: F.translate(w, "0123456789", "")), lambda w: F.length(w) >= 8)
    noisy = F.filter(letters, lambda w: (F.length(w) - F.length(F.translate(w, "aeiouyAEIOUY", ""))) / F.length(w) < 0.2)
    glued = lambda x: (F.length(x) >= 18) & (x.rlike("[A-Za-z]{14,}") | x.rlike("(?i)[a-z]{5,}(with|and|from|to|of|in)[a-z]{5,}"))
    # halves go by the product in doubles, as SQL rounds them, not by the quotient's decimal digits
    share = lambda n, of: F.round(n / F.greatest(of, F.lit(1)) * 10000) / 10000
    sections = [body.rlike(p).cast("int") for p in SECTION_PATTERNS.values()]
    return {
        "chars": F.length(body),
        "words": F.size(words),
        "useful_sections": sections[0] + sections[1] + sections[2],
        "weird_ratio": share(F.length(F.regexp_replace(body, r"[\x00-\x7F]", "")), F.length(body)),
        "glued_lines": F.size(F.filter(lines, glued)),
        "broken_lines": F.size(F.filter(lines, lambda x: x.rlike(r"\b\w{1,3}-$"))),
        "noise_ratio": share(F.size(noisy), F.size(words)),
    }


def markdown_warnings(chars: Column, words: Column, sections: Column, weird: Column, glued: Column, noise: Column, source_format: Column) -> Column:
    weak = (chars < 900) | (words < 120) | (sections < 2)
    noisy = (weird > 0.025) | (noise > 0.18) | ((glued >= 10) & ((words < 180) | (sections < 2)))
    repair = source_format.isin(OCR_FORMATS) & (weak | (noisy & ((words < 180) | (sections < 2))))
    return F.array_compact(F.array(F.when(weak, "markdown_too_weak"), F.when(noisy, "high_ocr_noise"), F.when(repair, "needs_ocr_repair")))


def normalised_quality(templates: Column, missing_sections: Column, words: Column) -> Column:
    return round4(clip01(1 - 0.15 * templates - 0.10 * missing_sections - F.when(words < 80, 0.20).otherwise(0.0)))


def compact(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def field_support(value: Column, source: Column, low: Column | None = None, tight: Column | None = None) -> Column:
    """supported / weakly_supported (0.8 of its words occur) / unsupported / missing. low, tight: the source's lower-case and compact forms, where many values share them."""
    low, tight = F.lower(source) if low is None else low, compact(source) if tight is None else tight
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(value), F.lit("([a-z0-9][a-z0-9+.#/@-]*)"), F.lit(1)), lambda t: (F.length(t) > 1) & ~t.isin("and", "the", "with", "for", "from")))
    present = F.size(F.filter(words, lambda t: low.contains(t)))
    return (
        F.when(value.isNull() | (F.trim(value) == ""), "missing")
        .when((compact(value) != "") & tight.contains(compact(value)), "supported")
        .when(F.size(words) == 0, "missing")
        .when(present / F.size(words) >= 0.8, "weakly_supported")
        .otherwise("unsupported")
    )


# Folders named after formats, and extensions.
FORMAT_FOLDERS = ["pdf", "docx", "images", "scans"]
FORMAT_EXTENSIONS = {"pdf": ["pdf"], "docx": ["docx"], "images": ["png", "jpg", "jpeg", "tif", "tiff", "bmp"]}


def source_format(path: Column) -> Column:
    """The deepest folder named after a format, else what the extension says, else unknown."""
    folder = F.filter(F.split(F.lower(path), "/"), lambda p: p.isin(FORMAT_FOLDERS))
    ext = F.regexp_extract(F.lower(path), r"[^/]\.([a-z0-9]+)$", 1)
    named = [F.when(ext.isin(known), label) for label, known in FORMAT_EXTENSIONS.items()]
    return F.coalesce(F.try_element_at(folder, F.lit(-1)), *named, F.lit("unknown"))


# Limits of the text layer of paged files.
TEXT_PAGE_CHARS, NATIVE_MEAN_CHARS, NATIVE_TEXT_SHARE, NATIVE_WORDS, IMAGE_SHARE, IMAGE_MEAN_CHARS = 40, 80.0, 0.5, 200, 0.8, 140.0


def paged_route(pages: Column, chars: Column, words: Column, text_pages: Column, image_pages: Column) -> Column:
    """(route scanned, hybrid or native, ocr, reasons) of a file from counts over its pages.

    text_pages: pages of at least TEXT_PAGE_CHARS characters. A file full of images with little text is scanned, and so is one without a
    usable text layer; a usable layer of few words is hybrid and is read by OCR too.
    """
    n = F.greatest(pages, F.lit(1))
    mean, text_share, image_share = chars / n, text_pages / n, image_pages / n
    by_images = (image_share >= IMAGE_SHARE) & (mean < IMAGE_MEAN_CHARS)
    usable = (chars >= TEXT_PAGE_CHARS) & (mean >= NATIVE_MEAN_CHARS) & (text_share >= NATIVE_TEXT_SHARE)
    route = F.when(by_images | ~usable, "scanned").when(words < NATIVE_WORDS, "hybrid").otherwise("native")
    reason = F.when(by_images, "images with weak text").when(~usable, "text below limits").when(words < NATIVE_WORDS, "too few native words").otherwise("text above limits")
    facts = [("pages", pages.cast("string")), ("chars", chars.cast("string")), ("words", words.cast("string")), ("mean_chars", F.format_string("%.1f", mean)), ("text_share", F.format_string("%.2f", text_share)), ("image_share", F.format_string("%.2f", image_share))]
    reasons = F.array(*[F.concat(F.lit(k + "="), v) for k, v in facts], reason)
    return F.struct(route.alias("route"), (route != "native").alias("ocr"), reasons.alias("reasons"))


# Signs of a form that was never filled in, by name.
TEMPLATE_SIGNS = [
    ("email@youremail.com", r"\bemail@youremail\.com\b"),
    ("first.last@", r"\bfirst\.last@"),
    ("FIRSTLAST", r"\bfirst\s*last\b"),
    ("info@qwikresume.com", r"\binfo@qwikresume\.com\b"),
    ("info@resumeworded.com", r"\binfo@resumeworded\.com\b"),
    ("info@resumekraft.com", r"\binfo@resumekraft\.com\b"),
    ("example.com", r"\bexample\.com\b"),
    ("qwikresume", r"\bqwikresume\b"),
    ("resumeworded", r"\bresumeworded\b"),
    ("resumekraft", r"\bresumekraft\b"),
    ("resumesample", r"\bresume\s*sample\b|\bresumesample\b"),
    ("null_text", r'(?<!\w)"?null"?(?!\w)'),
    ("000-000-0000", r"\b0{3}[- .]?0{3}[- .]?0{4}\b"),
]


def template_signs(x: Column) -> Column:
    """Names of the template signs in a text, in their order; none for null. Letters of all alphabets bound words."""
    return F.array_compact(F.array(*[F.when(x.rlike("(?iU)" + p), name) for name, p in TEMPLATE_SIGNS]))


def nullify_templates(fields: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """The fields without values that hold a template sign, and the paths of what went."""
    kept, paths = {}, []
    for name, x in fields.items():
        kept[name] = F.when(F.size(template_signs(x)) == 0, x)
        paths.append(F.when(F.size(template_signs(x)) > 0, name))
    return kept, F.array_compact(F.array(*paths))
