"""Text normalisation and extraction as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

# Skill aliases after cleaning.
SKILL_ALIASES = {
    "FastAPI": ["fast api", "fastapi", "fast api framework"],
    "REST API": ["rest api", "rest api design", "restful api", "restful apis"],
    "MongoDB": ["mongo db", "mongodb", "mongo"],
    "CI/CD": ["ci cd", "cicd"],
    "GitHub": ["git hub", "github"],
    "JavaScript": ["java script", "javascript", "js"],
    "TypeScript": ["type script", "typescript", "ts"],
    "React": ["reactjs", "react js", "react"],
    "Node.js": ["nodejs", "node js", "node"],
    "PostgreSQL": ["postgre sql", "postgresql", "postgres", "postgre"],
    "MySQL": ["my sql", "mysql"],
    "PyTorch": ["py torch", "pytorch"],
    "TensorFlow": ["tensor flow", "tensorflow"],
    "NumPy": ["num py", "numpy"],
    "MLOps": ["ml ops", "mlops"],
    "MLflow": ["m lflow", "mlflow"],
    "PowerBI": ["power bi", "powerbi", "po wer bi"],
    "XGBoost": ["xg boost", "xgboost"],
    "NoSQL": ["no sql", "nosql"],
}


def fold_accents(x: Column) -> Column:
    return F.translate(x, ACCENTED, PLAIN)


def collapse(x: Column) -> Column:
    """White space to single spaces, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(x, r"[ \t\n\r\f\x0B]+", " ")), F.lit(""))


def alnum_key(x: Column, sep: str = "") -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", sep))


def clean_skill(x: Column) -> Column:
    out = F.translate(F.lower(F.trim(x)), "_-./", "    ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9+#]+", " "))


def normal_skill(x: Column) -> Column:
    """Cleaned, then an alias' canonical name, else words with capitals (up to three letters: all capitals)."""
    token = clean_skill(x)
    part = lambda p: F.when((F.length(p) <= 3) & p.rlike("^[a-z]+$"), F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000)))
    title = F.array_join(F.transform(F.split(token, " "), part), " ")
    out = None
    for name, keys in SKILL_ALIASES.items():
        out = F.when(token.isin(keys), name) if out is None else out.when(token.isin(keys), name)
    return out.otherwise(title)


def graph_skill(x: Column) -> Column:
    out = F.replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit("."), F.lit(""))
    return F.trim(F.regexp_replace(out, "[^a-z0-9+#/]+", " "))


def distinct_folded(values: Column) -> Column:
    """Ordered distinct strings, compared trimmed and lower-cased; empty ones go."""
    cleaned = F.filter(F.transform(values, collapse), lambda x: x.isNotNull())
    lowered = F.transform(cleaned, F.lower)
    return F.filter(cleaned, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def distinct_folded_long(values: Column) -> Column:
    """distinct_folded for whole texts: by sorting, n log n in the number of strings and without Python."""
    cleaned = F.filter(F.transform(values, collapse), lambda x: x.isNotNull())
    keyed = F.array_sort(F.transform(cleaned, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    # an array of one, so that the sorted strings are made once and not for each use
    firsts = F.transform(F.array(keyed), lambda a: F.filter(a, lambda v, i: (i == 0) | (v["k"] != F.get(a, i - 1)["k"])))[0]
    return F.transform(F.array_sort(F.transform(firsts, lambda v: F.struct(v["i"].alias("i"), v["x"].alias("x")))), lambda v: v["x"])


def email(x: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(x)), r"\s+", "")
    return F.when(out.rlike("@[^@]*[.][^@]*$"), out)


def email_class(normal: Column, generic_domains: list[str], generic_locals: list[str]) -> Column:
    local, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    starts = reduce(lambda a, b: a | b, [(local == p) | local.startswith(p + ".") | local.startswith(p + "-") for p in generic_locals])
    return F.when(normal.isNull(), "missing").when(domain.isin(generic_domains) | starts, "generic").otherwise("real")


def phone(x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]+", "")
    return F.when(F.length(digits) >= 7, digits)


def phone_class(digits: Column) -> Column:
    one_digit = F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) == 0
    weak = digits.isin("0000000000", "1234567890", "123456789") | digits.contains("1234567") | digits.contains("1111111") | one_digit | digits.rlike("555[0-9]{4}$")
    return F.when(digits.isNull(), "missing").when(weak, "weak_or_placeholder").otherwise("real")


def urls(x: Column) -> Column:
    found = F.regexp_extract_all(x, F.lit(r"(?i)((?:https?://|www\.)[^ \t\n\r]+)"), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, r"^[.,);\]]+|[.,);\]]+$", ""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 12 hex digits of the SHA-1 of the parts that aren't empty, joined by |."""
    raw = F.concat_ws("|", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(raw), 1, 12))


def keyword_label(x: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first pattern that occurs in the lower-cased text."""
    out = None
    for pattern, label in rules:
        hit = F.lower(x).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def sentences(x: Column) -> Column:
    """What stands between line ends and between ., ! or ? and white space; in one pass, which looks back from white space only."""
    return F.filter(F.transform(F.split(x, r"\s(?:(?<=[.!?]\s)\s*|(?<=\n)\n*)"), lambda s: F.trim(s)), lambda s: s != "")


def escape_html(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def strip_html(x: Column) -> Column:
    out = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return collapse(F.regexp_replace(out, r"<[^>]*>", " "))


def repair_words(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered case-insensitive replacements, one after the other."""
    return reduce(lambda acc, r: F.regexp_replace(acc, "(?i)" + r[0], r[1]), rules, x)
