"""Field parsers: id number, printed date, serial number, gender, names, addresses, recoveries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import dims
from docspark.functions.text import digits_to_western, nonempty, normalize_numeric, normalize_text, squeeze, tokens

ID = "[23][0-9]{13}"
#: \d and \s of all scripts, as the rules have them.
SERIAL = r"(?U)[A-Z]{1,3}\d{5,9}"
_SEP = r"[\s\x1C-\x1F\x85\p{Z}/\-.]+"
_YEAR = r"(19\d{2}|20\d{2})"
_DM = r"(\d{1,2})"
YMD, DMY = f"{_YEAR}{_SEP}{_DM}{_SEP}{_DM}", f"{_DM}{_SEP}{_DM}{_SEP}{_YEAR}"
TRAILING = r"[\s\d٠-٩]{4,}$"
HEADER = "(?i)^(?:" + "|".join(dims.HEADER_PHRASES + dims.HEADER_WORDS) + r")[\s\-_/]*"
_HEAD = HEADER.removeprefix("(?i)^")
#: Six rounds of HEADER and a trim at once; spaces in front take the first round.
HEADERS = f"(?i)^(?:(?:{_HEAD}){{1,6}}| +(?:{_HEAD}){{0,5}})"


def parse_national_id(c: Column) -> Column:
    z = normalize_numeric(c)
    found, rest = F.regexp_extract(z, ID, 0), F.ltrim(z, F.lit("0"))
    return F.when(found != "", found).when(F.length(rest) > 14, F.right(rest, F.lit(14))).otherwise(rest)


def _iso(y: Column, m: Column, d: Column, plausible: Column) -> Column:
    mi, di = m.try_cast("int"), d.try_cast("int")
    ok = plausible & mi.between(1, 12) & di.between(1, 31)
    return F.when(ok, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def parse_dob(c: Column) -> Column:
    """The printed date as yyyy-mm-dd. Days are not held against the month's length."""
    plain = F.regexp_replace(c, SERIAL, "")
    west = digits_to_western(plain)
    part = lambda pattern, k: F.regexp_extract(west, pattern, k)
    ymd = _iso(part(YMD, 1), part(YMD, 2), part(YMD, 3), part(YMD, 0) != "")
    dmy = _iso(part(DMY, 3), part(DMY, 2), part(DMY, 1), part(DMY, 0) != "")
    z = normalize_numeric(plain)
    run = F.length(z) >= 8
    at = lambda a, n: F.substring(z, a, n)
    year = lambda y: run & y.try_cast("int").between(1900, 2030)
    return F.coalesce(ymd, dmy, _iso(at(1, 4), at(5, 2), at(7, 2), year(at(1, 4))), _iso(at(5, 4), at(3, 2), at(1, 2), year(at(5, 4))))


def parse_serial(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit("")), SERIAL, 0), F.lit(""))


def parse_gender(c: Column) -> Column:
    text = normalize_text(c)
    female = text.contains(dims.FEMALE[0]) | text.contains(dims.FEMALE[1])
    return F.when(text.contains(dims.MALE), "male").when(female, "female")


def near(w: Column, keyword: Column, most: int) -> Column:
    """Whether the edit distance is at most ``most``; lengths that rule it out come first."""
    return (F.abs(F.length(w) - F.length(keyword)) <= most) & (F.levenshtein(w, keyword, most) >= 0)


def edits(keyword: str) -> int:
    """Edits that a reading of the word may have: one up to five letters, else two."""
    return 1 if len(keyword) <= 5 else 2


def is_header_token(w: Column, words: list[str] = dims.HEADER_TOKENS, keywords: list[str] = dims.HEADER_KEYWORDS) -> Column:
    """One of ``words``, or near one of ``keywords``."""
    fuzzy = F.lit(False)
    for k in keywords:
        fuzzy = fuzzy | near(w, F.lit(k), edits(k))
    # what is near a keyword keeps all but ``edits`` of its letters, and letters beyond ASCII show in the number of bytes
    letters = min((len(k) - edits(k) for k in keywords), default=0)
    if not any(c.isascii() for k in keywords for c in k):
        fuzzy = (F.octet_length(w) >= F.length(w) + letters) & fuzzy
    return (F.length(w) > 1) & (w.isin(words) | fuzzy)


def parse_name(c: Column, compatibility: bool = True) -> Column:
    text = normalize_text(c, compatibility)
    for phrase in dims.NAME_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    text = F.trim(F.regexp_replace(text, HEADERS, ""))
    known = {wrong: right for right, wrongs in dims.NAME_CORRECTIONS.items() for wrong in wrongs}
    fixes = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # the text is normalized, so spaces alone part its words
    kept = F.filter(F.split(text, " "), lambda w: ((F.length(w) > 1) | (w == "و")) & ~is_header_token(w))
    return F.array_join(F.transform(kept, lambda w: F.when(w.isin(list(known)), F.try_element_at(fixes, w)).otherwise(w)), " ")


def parse_address(lines: Column, compatibility: bool = True) -> Column:
    """Of the lines in turn; null and blank ones do not count."""
    joined = F.array_join(F.filter(lines, lambda t: F.coalesce(squeeze(t) != "", F.lit(False))), " ")
    # every step of the normalization works within lines, so it may run on all of them at once
    text = normalize_text(joined, compatibility)
    for phrase in dims.ADDRESS_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    text = F.trim(F.regexp_replace(text, TRAILING, ""))
    kept = F.filter(F.split(text, " "), lambda w: ((F.length(w) > 1) | w.isin("و", "ش")) & ~w.isin(dims.ADDRESS_TOKENS))
    return F.array_join(kept, " ")


def split_name(full: Column) -> Column:
    words = tokens(full)
    return F.struct(F.try_element_at(words, F.lit(1)).alias("first_name"), F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, 1 << 20), " ")).alias("last_name"))


def recover_nid(address_raw: Column, current: Column) -> Column:
    """An id number that stands in the address, if the one at hand has not 14 digits; else null."""
    found = nonempty(F.regexp_extract(digits_to_western(address_raw), ID, 0))
    return F.when(F.coalesce(F.length(current), F.lit(0)) != 14, found)


def recover_serial(dob_raw: Column, current: Column, status: Column) -> Column:
    """A serial number that stands in the printed date, if the one at hand is missing or doubtful; else null."""
    doubtful = nonempty(current).isNull() | status.isin("LOW_CONFIDENCE", "FAILED")
    return F.when(F.coalesce(doubtful, F.lit(True)), nonempty(parse_serial(dob_raw)))
