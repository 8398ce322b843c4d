"""Column functions on text: clean-up, identifiers, parsing of file names and labels.

Java's ``\\w`` and ``\\d`` are ASCII, so classes of letters are written as ``\\p{L}`` and ``\\p{M}``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and digits that recognition takes for each other.
DIGIT_FROM, DIGIT_TO = "OoIl|SB", "0011158"
LETTER_FROM, LETTER_TO = "0158", "OISB"
CANONICAL_ID = "^[A-Z]{3}[0-9]{7}$"
PERMISSIVE_ID = "[A-Z]{2,4}[0-9]{6,9}"


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def filled(c: Column) -> Column:
    """The text, or null if it is blank."""
    return F.when(~blank(c), c)


def collapse(c: Column) -> Column:
    """White-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# What is no part of a value at its beginning (a numbering or punctuation) and at its end.
LEADING = r"^(?:\s*+\d++[.:)\s]++|[\s\-–—.,;:])++"
TRAILING = r"[\s\-–—_.,;:\"'“”‘’]+$"


def strip_value(c: Column) -> Column:
    """A value without numbering and punctuation before it and punctuation behind it; a bare number stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(c), LEADING, ""), TRAILING, ""))


def skeleton(c: Column, signs: str = "[ா-ௌௗ]") -> Column:
    """The text without the characters of the class ``signs`` (by default Tamil vowel signs)."""
    return F.trim(F.regexp_replace(c, signs, ""))


def digits(c: Column) -> Column:
    """Digits of a text, with the usual confusions read as digits."""
    return F.regexp_replace(F.translate(c, DIGIT_FROM, DIGIT_TO), "[^0-9]", "")


def identifier(c: Column) -> Column:
    """Repair an identifier of three letters and seven digits; null if it can't be one.

    With one character too many, both ends are tried.
    """
    raw = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))

    def fixed(start: int) -> Column:
        head = F.translate(F.substring(raw, start, 3), LETTER_FROM, LETTER_TO)
        tail = F.translate(F.substring(raw, start + 3, 7), DIGIT_FROM.upper(), "0011158")
        whole = F.concat(head, tail)
        return F.when(whole.rlike(CANONICAL_ID), whole)

    n = F.length(raw)
    return F.when(n == 10, fixed(1)).when(n == 11, F.coalesce(fixed(1), fixed(2)))


def normal_id(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def is_canonical_id(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit(""))).rlike(CANONICAL_ID)


def looks_like_id(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit(""))).rlike(PERMISSIVE_ID)


# Labels before a printed name.
NAME_LABELS = "கணவர்|கணவரின்|தந்தை|தந்தையின்|தாய்|தாயின்|குடும்ப|பாதுகாவலர்|உறவினர்|husband|father|mother|family|guardian|relative"
NAME_WORDS = "பெயர்|பெயா்|பெயா|name"


def clean_name(c: Column, labels: str = NAME_LABELS, words: str = NAME_WORDS) -> Column:
    """A name to compare: without label, numbering and punctuation around it, in lower case; null is ''."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?iu)^\s*(\d+[.:)\-\s]+)?(({labels})[\s.,]+)?({words})[\s:;=\-.,]+", "")
    out = F.regexp_replace(F.regexp_replace(out, LEADING, ""), TRAILING, "")
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def normal_house(c: Column) -> Column:
    """House number in upper case with ``-`` for each run of separators; null is ''."""
    out = F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"[-\s./\\_,;]+", "-")
    return F.regexp_replace(out, "^-|-$", "")


def is_missing_house(c: Column) -> Column:
    return normal_house(c).isin("", "0", "NA", "NIL")


def building_key(c: Column) -> Column:
    """The dwelling of a house number: its first two parts, without the letters of a sub-door; null
    where the house is missing."""
    head = F.slice(F.split(normal_house(c), "-"), 1, 2)
    last = F.regexp_replace(F.element_at(head, -1), r"^(\d+)\p{L}+$", "$1")
    joined = F.when(F.size(head) > 1, F.concat_ws("-", head[0], last)).otherwise(last)
    return F.when(~is_missing_house(c), joined)


def number_after(c: Column, word: str) -> Column:
    """The number after a word, 0 if there is none."""
    return F.coalesce(_to_int(F.regexp_extract(c, rf"(?i){word}\s*[-_ ]?\s*(\d+)", 1)), F.lit(0))


def _to_int(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{1,9}$"), c).try_cast("int")


def revision(c: Column) -> Column:
    return number_after(c, "revision")


def file_parts(c: Column) -> tuple[Column, Column]:
    """Constituency and part number in a file name like ``AC012-PART-034``; null where missing."""
    ac = _to_int(F.regexp_extract(c, r"(?i)ac[-_ ]?0*(\d+)", 1))
    part = _to_int(F.regexp_extract(c, r"(?i)part[-_ ]?0*(\d+)", 1))
    return ac, part


def section_number(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d+)", 1)


def canonical(c: Column, table: dict[str, list[str]], other: str | None = None) -> Column:
    """The key of ``table`` that lists the lower-cased text; else ``other`` (default: the text)."""
    out = None
    low = F.lower(F.trim(c))
    for k, names in table.items():
        hit = low.isin(names)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise(c if other is None else F.lit(other))


# Fixed values.
GENDERS = {"Male": ["male", "m"], "Female": ["female", "f"], "Third Gender": ["third gender", "other", "o", "t", "transgender"]}
RELATIONS = {"Father": ["father", "f"], "Mother": ["mother", "m"], "Husband": ["husband", "h"], "Other": ["other", "o"]}
REASONS = {"E": "Expired", "S": "Shifted", "R": "Repeated", "Q": "Disqualified", "M": "Missing"}


def reason_code(c: Column, codes: str = "ESRQM") -> Column:
    """A deletion code, alone or before a serial number; null if none."""
    alone = F.regexp_extract(F.upper(F.trim(c)), f"^([{codes}])$", 1)
    leading = F.regexp_extract(F.upper(F.trim(c)), rf"^([{codes}])\s*[-.]?\s*\d+$", 1)
    return F.coalesce(filled(alone), filled(leading))


def reason_text(c: Column) -> Column:
    code = reason_code(c)
    names = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), F.when(code.isNotNull(), "Unknown"))


def count_text(c: Column) -> Column:
    """A printed count: ``o`` is 0, any dash is a minus, at most six digits; null if it is no number."""
    plain = count_signs(c)
    return F.when(is_count(plain), plain).try_cast("int")


def count_signs(c: Column) -> Column:
    """Text with the digits and signs that ``o`` and dashes stand for, without white space and commas."""
    return F.translate(c, "oO–—−, \t\n\x0b\f\r", "00---")  # what has no counterpart goes


def is_count(plain: Column) -> Column:
    return plain.rlike(r"^-?[0-9]{1,6}$")


def without_bracket(c: Column) -> Column:
    """Text without a trailing ``(...)``."""
    return F.trim(F.regexp_replace(c, r"\s*\([^()]*\)\s*$", ""))


def numbered_name(c: Column) -> tuple[Column, Column]:
    """``12 - Some place`` as number and name."""
    return _to_int(F.regexp_extract(c, r"^\s*(\d+)\s*[-.:]", 1)), F.trim(F.regexp_replace(c, r"^\s*\d+\s*[-.:]\s*", ""))


def dates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d{2}[-/.]\d{2}[-/.]\d{4}"), 0)


def years(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?<!\d)(?:19|20)\d{2}(?!\d)"), 0)


def cut_at(c: Column, labels: list[str]) -> Column:
    """Text up to the next of the labels."""
    return F.trim(F.regexp_replace(c, rf"(?s)\s*({'|'.join(labels)}).*$", ""))


def intact_age_line(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)age\s*[:=]?\s*\d{2,3}.*gender\s*[:=]?\s*\p{L}+")


def intact_house(c: Column) -> Column:
    """Holds a separator, or at most one digit."""
    return c.rlike(r"[/\-]") | (F.length(F.regexp_replace(c, "[^0-9]", "")) <= 1)


def masked_secret(c: Column) -> Column:
    """All but the last four characters hidden."""
    return F.when(blank(c), "").when(F.length(c) <= 4, "****").otherwise(F.concat(F.lit("****"), F.right(c, F.lit(4))))


def size_text(c: Column) -> Column:
    kb, mb = F.lit(1024.0), F.lit(1024.0 * 1024)
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, F.concat(F.format_number(c / kb, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(c / mb, 1), F.lit(" MB")))


def label_or(c: Column, default: str) -> Column:
    return F.coalesce(filled(c.cast("string")), F.lit(default))


def long_vowels(c: Column, vowels: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"[{vowels}]", ""))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done * 100.0 / total)).otherwise(0.0)


# Vowel signs, and pairs of them that make up one sign.
SIGNS = "ாிீுூெேைொோௌௗ"
SIGN_PAIRS = {"\u0bc6\u0bbe": "\u0bca", "\u0bc7\u0bbe": "\u0bcb", "\u0bc6\u0bd7": "\u0bcc", "ெெ": "ே", "ெே": "ே", "ெொ": "ொ", "ெோ": "ோ", "ிி": "ீ", "ுு": "ூ"}  # escaped where an editor would compose them


def repaired_signs(c: Column, pairs: dict[str, str] = SIGN_PAIRS, signs: str = SIGNS) -> Column:
    """Each run of vowel signs as one sign, composed from left to right: a pair by the table, else the later one."""
    known = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    pieces = F.regexp_extract_all(c, F.lit(f"[{signs}]+|[^{signs}]+"), 0)

    def folded(run: Column) -> Column:
        return F.aggregate(F.split(run, ""), F.lit(""), lambda done, sign: F.coalesce(F.try_element_at(known, F.concat(done, sign)), sign))

    return F.when(c.rlike(f"[{signs}]{{2}}"), F.array_join(F.transform(pieces, lambda p: F.when((F.length(p) > 1) & p.rlike(f"^[{signs}]"), folded(p)).otherwise(p)), "")).otherwise(c)


def enum_by_containment(c: Column, options: list[str]) -> Column:
    """The first option that the text holds."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = None
    for o in options:
        out = F.when(low.contains(o.lower()), o) if out is None else out.when(low.contains(o.lower()), o)
    return out


def spelling_score(count: Column, word: Column, vowels: str) -> Column:
    """Votes, weighted by a quarter for each long vowel."""
    return count * (1 + 0.25 * long_vowels(word, vowels))


def reservation(c: Column) -> Column:
    """Reservation status in brackets: GEN, SC or ST."""
    got = F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\((gen|sc|st)\)", 1))
    return filled(got)


def label_windows(c: Column, label: str) -> Column:
    """The pieces of a text about as long as a label: from one shorter to two longer, in order."""
    n = len(label)
    sizes = F.array(*[F.lit(k) for k in range(max(1, n - 1), n + 3)])
    of = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, k))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(sizes, of))
