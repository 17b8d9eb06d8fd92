"""Text normalisation, extraction and coercion as Column expressions.

All patterns stay within RE2's syntax, so the same pattern means the same in
other SQL engines. A null input gives null unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

TOKEN = r"[\p{L}\p{N}]+"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
INVISIBLE = "[\u200b\u200c\u200d\u2060\ufeff]"
CURLY = "\u2018\u2019\u201a\u201c\u201d\u201e"
STRAIGHT = "'''\"\"\""
EASTERN_DIGITS = "".join(map(chr, range(0x0660, 0x066A)))
HONORIFICS = r"(?i)^(mr|mrs|ms|dr|prof|sir|justice|judge)\.?\s+"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
UNANSWERABLE = ("", "n/a", "na", "none", "null", "unknown", "not found", "no answer")


def ascii_bounded(text: Column) -> Column:
    """``text`` with U+FFFC for each code point beyond ASCII. Java's ``\\b`` counts letters
    of every script before version 19 and RE2's only ASCII's; here both mean the same, so
    patterns of ASCII find what RE2 finds in the text itself, at the same places."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "\ufffc")


def normalise(text: Column) -> Column:
    """Dashes to '-', zero-width characters out, no-break space to space, curly
    quotes to straight, Eastern Arabic digits to 0-9."""
    t = F.translate(text, DASHES, "-" * len(DASHES))
    t = F.regexp_replace(t, INVISIBLE, "")
    t = F.translate(t, "\u00a0", " ")
    t = F.translate(t, CURLY, STRAIGHT)
    return F.translate(t, EASTERN_DIGITS, "0123456789")


def collapse(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lookup_key(text: Column) -> Column:
    """Normalised, lower case, everything but letters and digits to one space."""
    return F.trim(F.regexp_replace(F.lower(normalise(text)), r"[^\p{L}\p{N}]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def person_key(name: Column) -> Column:
    """Key of a person: honorific and trailing J or CJ removed."""
    return lookup_key(F.regexp_replace(F.regexp_replace(F.trim(name), HONORIFICS, ""), r"\s+(J|CJ|JA)\.?$", ""))


def organisation_key(name: Column) -> Column:
    return lookup_key(F.regexp_replace(F.trim(name), r"(?i)^the\s+", ""))


def acronym(name: Column) -> Column:
    """Initials of tokens longer than two letters or all capitals; null unless 3 to 8."""
    words = F.filter(F.regexp_extract_all(name, F.lit(r"[A-Za-z]+"), F.lit(0)), lambda w: (F.length(w) > 2) | (w == F.upper(w)))
    letters = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(F.length(letters).between(3, 8), letters)


def case_number(text: Column) -> Column:
    """First 'PREFIX n/yyyy' or 'PREFIX n of yyyy' or '[yyyy] PREFIX n' as 'PREFIX 00n/yyyy'."""
    plain, bracket = r"([A-Z]{2,6})[ \-]?(?:No\.? ?)?([0-9]{1,4}) ?(?:/|of) ?([0-9]{4})", r"\[([0-9]{4})\] ([A-Z]{2,6}) ([0-9]{1,4})"
    one = F.concat(F.regexp_extract(text, plain, 1), F.lit(" "), F.lpad(F.regexp_extract(text, plain, 2), 3, "0"), F.lit("/"), F.regexp_extract(text, plain, 3))
    two = F.concat(F.regexp_extract(text, bracket, 2), F.lit(" "), F.lpad(F.regexp_extract(text, bracket, 3), 3, "0"), F.lit("/"), F.regexp_extract(text, bracket, 1))
    return F.when(text.rlike(plain), one).when(text.rlike(bracket), two)


def plausible_case(number: Column, first_year: int = 1950, last_year: int = 2100, most: int = 9999) -> Column:
    """Whether a case number as ``case_number`` gives it has a likely number and year."""
    n, year = F.regexp_extract(number, r"([0-9]+)/", 1).cast("int"), F.regexp_extract(number, r"/([0-9]{4})$", 1).cast("int")
    return F.coalesce(n.between(1, most) & year.between(first_year, last_year), F.lit(False))


def extract_unique(text: Column, *patterns: str) -> Column:
    """All matches of the patterns, pattern by pattern, first occurrences only."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])))


def trailing_title(text: Column, stops: tuple[str, ...]) -> Column:
    """Words after the last of the stop words, in title case: read from the right
    until one is met."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))

    def step(s: Column, w: Column) -> Column:
        done = s["done"] | F.lower(w).isin(*stops)
        return F.struct(F.when(done, s["kept"]).otherwise(F.concat(F.array(w), s["kept"])).alias("kept"), done.alias("done"))

    return F.initcap(F.array_join(F.aggregate(F.reverse(F.split(collapse(text), " ")), start, step)["kept"], " "))


def quoted_terms(text: Column) -> Column:
    """Quoted phrases of 3 to 81 characters that start with a capital."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r'"([A-Z][^"]{2,80})"'), F.lit(1)))


def caption_parties(title: Column) -> Column:
    """Both sides of 'A v B', 'A vs. B' or 'A versus B'; empty array if it is none."""
    parts = F.split(F.regexp_replace(title, r"(?i)\s+(v|vs|versus)\.?\s+", " | "), r" \| ")
    return F.when(F.size(parts) == 2, F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s*\([^)]*\)", "")))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def truncate_words(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut back to the last whole word."""
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(F.substring(text, 1, limit), r"\s+\S*\z", ""))


def pack_segments(segments: Column, limit: int, separator: str = " ") -> Column:
    """Complete leading segments that fit ``limit`` characters together."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(state: Column, segment: Column) -> Column:
        joined = F.when(state["text"] == "", segment).otherwise(F.concat(state["text"], F.lit(separator), segment))
        fits = ~state["full"] & (F.length(joined) <= limit)
        return F.struct(F.when(fits, joined).otherwise(state["text"]).alias("text"), (~fits).alias("full"))

    return F.aggregate(segments, start, step)["text"]


def sentences(text: Column) -> Column:
    """Text cut after '.', '!' or '?' before white space; no empty pieces."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def first_sentence(text: Column) -> Column:
    return F.try_element_at(sentences(text), F.lit(1))


def coerce_number(text: Column) -> Column:
    """First number, with thousands separators and currency removed; digits of a
    case number ('AB 12/2020') don't count."""
    clean = F.regexp_replace(text, r"[A-Z]{2,6}[ \-]?[0-9]{1,4}/[0-9]{4}", " ")
    return F.regexp_replace(F.regexp_extract(clean, r"-?[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "").try_cast("double")


def coerce_date(text: Column) -> Column:
    """ISO date of the earliest ISO, d/m/yyyy, 'd Month yyyy' or 'Month d, yyyy'."""
    names = "|".join(m.capitalize() for m in MONTHS)
    forms = [
        (r"([0-9]{4}-[0-9]{2}-[0-9]{2})", lambda t: F.try_to_date(t, "yyyy-MM-dd")),
        (r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", lambda t: F.try_to_date(t, "d/M/yyyy")),
        (rf"([0-9]{{1,2}} (?:{names}) [0-9]{{4}})", lambda t: F.try_to_date(t, "d MMMM yyyy")),
        (rf"((?:{names}) [0-9]{{1,2}}, [0-9]{{4}})", lambda t: F.try_to_date(t, "MMMM d, yyyy")),
    ]
    found = []
    for pattern, parse in forms:
        match = F.regexp_extract(text, pattern, 1)
        date = parse(F.when(match != "", match))
        found.append(F.when(date.isNotNull(), F.struct(F.instr(text, match).alias("at"), date.alias("date"))))
    return F.date_format(F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))["date"], "yyyy-MM-dd")


def unique_ignoring_case(values: Column) -> Column:
    """First spelling of each value."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda kept, v: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(v)), kept).otherwise(F.concat(kept, F.array(v))))


def coerce_names(text: Column) -> Column:
    """Names separated by ',', ';', line ends or 'and', first spelling of each."""
    parts = F.split(F.regexp_replace(text, r"\s+and\s+|[,;\n]", "|"), r"\|")
    return unique_ignoring_case(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def coerce_boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.rlike(r"^(yes|true|y|1)\b"), True).when(t.rlike(r"^(no|false|n|0)\b"), False)


def coerce_answer(kind: Column, text: Column) -> Column:
    """An answer as struct<bool_v, num_v, date_v, text_v, list_v> by its type."""
    return F.struct(
        F.when(kind == "boolean", coerce_boolean(text)).alias("bool_v"),
        F.when(kind == "number", coerce_number(text)).alias("num_v"),
        F.when(kind == "date", coerce_date(text)).alias("date_v"),
        F.when(kind.isin("name", "free_text"), collapse(text)).alias("text_v"),
        F.when(kind == "names", coerce_names(text)).alias("list_v"),
    )


def unanswerable(text: Column) -> Column:
    """Null and empty answers and the usual ways of giving none."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return t.isin(*UNANSWERABLE) | t.rlike(r"^(i (do not|don't) know|cannot be determined|there is no information)")


def cited_ids(answer: Column) -> Column:
    """Ids of '(cite: a, b)' groups, first occurrences."""
    groups = F.regexp_extract_all(answer, F.lit(r"\(cite: ([^)]*)\)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.trim(x)), lambda x: x != ""))


def strip_citations(answer: Column) -> Column:
    return collapse(F.regexp_replace(answer, r"\(cite: [^)]*\)", " "))


def page_of_chunk(chunk_id: Column) -> Column:
    """'doc:section:...' to 'doc_<section + 1>'; ids with '_' and no ':' pass; else ''."""
    section = F.split_part(chunk_id, F.lit(":"), F.lit(2)).try_cast("int")
    return F.when(F.instr(chunk_id, ":") > 0, F.coalesce(F.concat(F.split_part(chunk_id, F.lit(":"), F.lit(1)), F.lit("_"), (section + 1).cast("string")), F.lit(""))).when(F.instr(chunk_id, "_") > 0, chunk_id).otherwise("")


def split_page_id(page_id: Column) -> Column:
    """struct<doc, page> of 'doc_<page>'; page is null if it has none."""
    return F.struct(F.regexp_extract(page_id, r"^(.*)_([0-9]+)$", 1).alias("doc"), F.regexp_extract(page_id, r"^(.*)_([0-9]+)$", 2).try_cast("int").alias("page"))


def clean_answer(text: Column) -> Column:
    """Preambles, filler and an unfinished last sentence removed."""
    t = F.regexp_replace(collapse(text), r"(?i)^(according to (the )?(document|text|context)s?,?|based on (the )?(context|document)s?,?|the answer is:?)\s*", "")
    t = F.regexp_replace(t, r"(?i)\s*(please note that|it should be noted that)\s+", " ")
    return F.trim(F.when(t.rlike(r"[.!?]") & ~t.rlike(r"[.!?]$"), F.regexp_extract(t, r"^(.*[.!?])", 1)).otherwise(t))


def short_hash(text: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def search_text(*parts: Column) -> Column:
    """Parts that aren't null or empty, joined by ' | '."""
    return F.concat_ws(" | ", *[F.when(F.trim(p) != "", p) for p in parts])


def json_in(text: Column) -> Column:
    """The first {...} object in text with code fences, as text; null if none."""
    body = F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.when(body != "", body)


def record(text: Column, schema: str) -> Column:
    """The object in noisy text as a struct; null if it isn't one of the schema."""
    return F.from_json(json_in(text), schema, {"mode": "PERMISSIVE"})


def char_ratio(text: Column, pattern: str) -> Column:
    """Share of the characters that match a character class; 0 for empty text."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)
