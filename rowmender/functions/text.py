"""String, date and similarity expressions shared by every audit.

All of them are plain Column expressions. White space means the Unicode set
that browsers trim, which is wider than the one of Spark's ``trim``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# fixed values: characters that count as white space
SPACE = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

SPACE_CHARACTERS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# fixed values: formal first names and their nicknames
NICKNAMES = {
    "robert": ("bob", "rob", "bobby", "robbie"),
    "michael": ("mike", "mickey", "mick"),
    "william": ("bill", "will", "billy", "willie"),
    "richard": ("rick", "dick", "rich", "ricky"),
    "james": ("jim", "jimmy", "jamie"),
    "john": ("jack", "johnny"),
    "joseph": ("joe", "joey"),
    "thomas": ("tom", "tommy"),
    "charles": ("charlie", "chuck", "chas"),
    "christopher": ("chris",),
    "daniel": ("dan", "danny"),
    "matthew": ("matt",),
    "anthony": ("tony",),
    "elizabeth": ("liz", "beth", "betty", "lizzy", "betsy"),
    "margaret": ("maggie", "meg", "peggy", "marge"),
    "catherine": ("cathy", "kate", "katie", "cat"),
    "jennifer": ("jen", "jenny"),
    "kimberly": ("kim",),
    "susan": ("sue", "susie"),
    "patricia": ("pat", "patty", "tricia"),
    "barbara": ("barb", "barbie"),
}

# fixed values: legal forms that do not distinguish companies
COMPANY_SUFFIXES = ("inc", "llc", "ltd", "corp", "corporation", "company", "co", "incorporated", "limited")

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """Not null and not the empty string; blank text counts as present."""
    c = _col(c)
    return F.coalesce(c != "", F.lit(False))


def nonempty(c: Column | str) -> Column:
    """The value, with the empty string turned into null."""
    return F.nullif(_col(c), F.lit(""))


def trim_spaces(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(SPACE_CHARACTERS))


def plain_spaces(c: Column | str) -> Column:
    """Every white-space character as a blank, one for one."""
    return F.translate(_col(c), SPACE_CHARACTERS, " " * len(SPACE_CHARACTERS))


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(plain_spaces(c), " {2,}", " ")


def has_double_space(c: Column | str) -> Column:
    return F.contains(plain_spaces(c), F.lit("  "))


def digit_count(c: Column | str) -> Column:
    c = _col(c)
    return F.length(c) - F.length(F.translate(c, "0123456789", ""))


def tidy(c: Column | str) -> Column:
    return trim_spaces(collapse_spaces(c))


def first_present(*cs: Column | str) -> Column:
    return F.coalesce(*[nonempty(c) for c in cs])


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - normalized_levenshtein(a, b)


def normalize_name(c: Column | str) -> Column:
    """Lower case, trimmed, single-spaced, then stripped of symbols.

    Symbols go last and nothing is trimmed again: ``'A & B'`` keeps two spaces.
    """
    # one pass: blanks after a blank go, and so do symbols, whose blanks stay
    spaced = plain_spaces(trim_spaces(F.lower(_col(c))))
    return F.coalesce(F.regexp_replace(spaced, "(?<= ) +|[^a-z0-9 '-]", ""), F.lit(""))


def normalize_phone(c: Column | str, country: str = "US") -> Column:
    digits = F.coalesce(F.regexp_replace(_col(c), "[^0-9]", ""), F.lit(""))
    if country != "US":
        return digits
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def email_domain(c: Column | str) -> Column:
    parts = F.split(F.lower(_col(c)), "@")
    whole = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    return F.when(whole, parts[1]).otherwise("")


def email_key(c: Column | str) -> Column:
    """Comparison key of an address; null when it is missing or blank."""
    return nonempty(trim_spaces(F.lower(_col(c))))


def formal_name(c: Column) -> Column:
    """The formal first name behind a normalised nickname, else null."""
    entries = [F.lit(x) for formal, nicks in NICKNAMES.items() for nick in nicks for x in (nick, formal)]
    return F.try_element_at(F.create_map(*entries), c)


def is_likely_nickname(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    left, right = normalize_name(a), normalize_name(b)
    match = (formal_name(left) == right) | (formal_name(right) == left)
    return present(a) & present(b) & (left != right) & F.coalesce(match, F.lit(False))


def company_core(c: Column | str) -> Column:
    """Company name without its legal form."""
    words = "|".join(COMPANY_SUFFIXES)
    squeezed = collapse_spaces(trim_spaces(F.lower(_col(c))))
    return trim_spaces(F.regexp_replace(squeezed, rf"(?i)\b({words})\b\.?", ""))


def is_same_company(a: Column | str, b: Column | str, threshold: float = 0.85) -> Column:
    a, b = _col(a), _col(b)
    left, right = company_core(a), company_core(b)
    return present(a) & present(b) & ((left == right) | (similarity(left, right) >= threshold))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def instant(df: DataFrame, name: str) -> Column:
    """A property as a timestamp; text that is no date becomes null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(nonempty(name))
    return F.col(name).cast("timestamp")


def iso_timestamp(c: Column) -> Column:
    return F.date_format(c.cast("timestamp"), ISO_FORMAT)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, from whole milliseconds."""
    return (F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))) / F.lit(86400000)


def parse_int_prefix(c: Column | str) -> Column:
    """Leading integer of a text, 0 when there is no text, null when it has no digits."""
    c = _col(c)
    digits = F.regexp_extract(c, rf"^[{SPACE}]*([+-]?[0-9]+)", 1)
    return F.when(present(c), digits.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def as_timestamp(value) -> Column:
    """A literal instant from a Column, datetime or UTC text."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def title_case(c: Column | str) -> Column:
    return F.initcap(tidy(c))
