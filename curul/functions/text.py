"""Text, key and array columns. Everything here is Column -> Column and stays inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: what counts as white space and as a diacritic ------------------------------
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACING_DIACRITICS = "^`\u00a8\u00af\u00b4\u00b7\u00b8"
COMBINING_DIACRITICS = (
    (0x0300, 0x034E),
    (0x0350, 0x0357),
    (0x035D, 0x0362),
    (0x0483, 0x0487),
    (0x0591, 0x05BD),
    (0x064B, 0x0652),
)
# --- end of fixed values ----------------------------------------------------------------------

WORD = "[A-Za-z0-9_]"
WORD_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@lru_cache(maxsize=None)
def rx(pattern: str, ignore_case: bool = True) -> str:
    r"""Write a pattern once with web-style classes and get the Java spelling.

    ``\s`` covers every Unicode space, ``\b`` looks at ASCII word characters only, ``$`` is the
    very end of the text and letter case folds over all of Unicode.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        char = pattern[i]
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(SPACES if in_class else f"[{SPACES}]")
            i += 2
        elif pair == r"\b" and not in_class:
            out.append(WORD_EDGE)
            i += 2
        elif char == "\\":
            out.append(pair)
            i += 2
        else:
            if char == "[":
                in_class = True
            elif char == "]":
                in_class = False
            out.append(r"\z" if char == "$" and not in_class else char)
            i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def let(value: Column, body) -> Column:
    """Bind a costly value once for an expression that uses it several times.

    Expressions inside lambdas and conditional branches are evaluated anew at every use, so a
    value needed there is passed through a one-element array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(value: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    return as_col(value).rlike(rx(pattern, ignore_case))


def replace(value: Column | str, pattern: str, by: str = "", ignore_case: bool = True) -> Column:
    return F.regexp_replace(as_col(value), rx(pattern, ignore_case), by)


def extract(value: Column | str, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """First match of a group, null where there is none."""
    return F.nullif(F.regexp_extract(as_col(value), rx(pattern, ignore_case), group), F.lit(""))


def extract_all(value: Column | str, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(as_col(value), F.lit(rx(pattern, ignore_case)), F.lit(group))


def split(value: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    return F.split(as_col(value), rx(pattern, ignore_case))


def strip(value: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return replace(value, r"^\s+|\s+$")


def collapse(value: Column | str) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(replace(value, r"\s+", " "))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(as_col(value), F.lit(""))


def clean_optional(value: Column | str) -> Column:
    return blank_to_null(collapse(value))


def clean_title(value: Column | str) -> Column:
    """Collapsed title without its final full stop."""
    return replace(collapse(value), r"\.$")


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Translate table: each precomposed letter to its base letter, diacritics to nothing."""
    marks = {chr(c) for low, high in COMBINING_DIACRITICS for c in range(low, high + 1)}
    marks.update(SPACING_DIACRITICS)
    source, target, dropped = [], [], []
    for code in range(0x80, 0x2000):
        char = chr(code)
        if char in marks:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char) if c not in marks)
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
        elif base == "":
            dropped.append(char)
    dropped.extend(sorted(marks))
    return "".join(source + dropped), "".join(target)


def strip_diacritics(value: Column | str) -> Column:
    matching, replacement = _accent_table()
    return F.translate(as_col(value), matching, replacement)


def normalize_text(value: Column | str) -> Column:
    """Comparison form: no diacritics, lower case, single blanks."""
    return collapse(F.lower(strip_diacritics(value)))


def sha256(value: Column | str) -> Column:
    return F.sha2(as_col(value), 256)


def dedupe_hash(title_normalized: Column | str, date: Column | str) -> Column:
    """Key of a record that has nothing better than its title and its date."""
    return sha256(F.concat_ws("|", as_col(title_normalized), F.coalesce(as_col(date), F.lit("no-date"))))


def event_hash(initiative: Column | str, event_type: Column | str, date: Column | str, title: Column | str) -> Column:
    parts = [F.coalesce(as_col(p).cast("string"), F.lit("")) for p in (initiative, event_type, date, title)]
    return sha256(F.concat_ws("|", *parts))


def row_id(*parts: Column | str) -> Column:
    """Stable surrogate id from a natural key: a rerun yields the same id."""
    return sha256(F.concat_ws("|", *[F.coalesce(as_col(p).cast("string"), F.lit("")) for p in parts]))


def strip_html(value: Column | str) -> Column:
    return collapse(F.regexp_replace(as_col(value), "<[^>]+>", " "))


def decode_breaks(value: Column | str) -> Column:
    return replace(value, r"<br\s*/?>|&lt;br\s*/?&gt;", "\n")


# Fixed values, in the order in which they are decoded.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"))


def decode_entities(value: Column | str) -> Column:
    out = as_col(value)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def clean_text(value: Column | str) -> Column:
    """Decoded, break tags as blanks, collapsed; null becomes the empty text."""
    return collapse(decode_breaks(decode_entities(F.coalesce(as_col(value), F.lit("")))))


def word_xml_text(value: Column | str) -> Column:
    """Text of a word-processing document: its text runs joined, entities decoded."""
    runs = F.regexp_extract_all(as_col(value), F.lit(r"(?s)<w:t[^>]*>(.*?)</w:t>"), F.lit(1))
    return decode_entities(F.array_join(runs, ""))


def enumerated_list(value: Column | str) -> Column:
    """``1.- a 2.- b`` becomes ``1.- a | 2.- b``; any other text is only collapsed."""
    text = collapse(value)
    items = extract_all(text, r"\d+\.-.*?(?=\d+\.-|$)")
    joined = F.array_join(F.transform(items, lambda v: F.trim(v)), " | ")
    return F.coalesce(blank_to_null(joined), blank_to_null(text))


def first_non_blank(*values: Column | str) -> Column:
    """First text that is not blank, collapsed; empty text if none."""
    return F.coalesce(*[clean_optional(v) for v in values], F.lit(""))


def joined_values(values: Column | str) -> Column:
    """The non-blank members of an array joined by a blank; null if there are none."""
    kept = F.filter(F.transform(as_col(values), strip), lambda v: v != "")
    return blank_to_null(F.array_join(kept, " "))


def metadata_text(metadata: Column | str, key: str) -> Column:
    return blank_to_null(strip(F.try_element_at(as_col(metadata), F.lit(key))))


def metadata_number(metadata: Column | str, key: str) -> Column:
    return F.try_element_at(as_col(metadata), F.lit(key)).try_cast("double")


def variant_text(metadata: Column | str, key: str) -> Column:
    """The same getter over a VARIANT column: a value that is no text counts as missing."""
    value = as_col(metadata)
    is_text = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")) == "STRING"
    return F.when(is_text, blank_to_null(strip(F.try_variant_get(value, f"$.{key}", "string"))))


def from_parser(metadata: Column | str, *parsers: str) -> Column:
    """Rows whose metadata names one of the parsers."""
    return F.try_element_at(as_col(metadata), F.lit("parser")).isin(*parsers)


def capitalize_first(value: Column | str) -> Column:
    text = as_col(value)
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def truncate(value: Column | str, size: int) -> Column:
    """First ``size`` characters. Only for display columns, never for keys or scores."""
    return F.substring(as_col(value), 1, size)


def drop_first(value: Column | str, part: Column | str) -> Column:
    """The text without the first occurrence of a part."""
    text, piece = as_col(value), as_col(part)
    at = F.instr(text, piece)
    rest = F.concat(text.substr(F.lit(1), at - 1), text.substr(at + F.length(piece), F.length(text)))
    return F.when(at > 0, rest).otherwise(text)


def better_title(candidate: Column | str, current: Column | str) -> Column:
    size = F.length(strip(candidate))
    return F.coalesce((size > 0) & (size >= F.length(strip(current))), F.lit(False))


def better_description(candidate: Column | str, current: Column | str) -> Column:
    size = F.coalesce(F.length(strip(candidate)), F.lit(0))
    return (size > 0) & (size > F.coalesce(F.length(strip(current)), F.lit(0)))


def drop_prefixes(value: Column | str, prefixes: list[str]) -> Column:
    """Take each prefix off once, in the given order, in a single regex pass."""
    return replace(value, "^" + "".join(f"(?:{p})?" for p in prefixes))


def unique_by(values: Column | str, key=normalize_text, keep_blank_keys: bool = False) -> Column:
    """Order-preserving unique: the first member of each key stays."""


    def firsts(items: Column, keys: Column) -> Column:
        def is_first(_, position):
            own = F.get(keys, position)
            first = F.array_position(keys, own) == position + 1
            return first if keep_blank_keys else first & (own != "")

        return F.filter(items, is_first)

    return let(as_col(values), lambda items: let(F.transform(items, key), lambda keys: firsts(items, keys)))


def as_authors(names: Column | str, role: str = "primary") -> Column:
    """Names to (full_name, role) structs."""
    return F.transform(
        as_col(names), lambda n: F.struct(n.alias("full_name"), F.lit(role).alias("role"))
    )


def tokens(value: Column | str) -> Column:
    """Search terms: maximal runs of letters and digits of the comparison form."""
    plain = F.lower(strip_diacritics(value))
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trigrams(value: Column | str) -> Column:
    """Distinct three-letter groups of each word padded as two blanks + word + one blank.

    The padded words are set end to end and read by one pattern that skips the groups which
    belong to two words.
    """
    plain = F.lower(strip_diacritics(value))
    padded = F.concat(F.lit("  "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "   ")), F.lit(" "))
    groups = r"(?=(  [^ ]| [^ ][^ ]| [^ ] |[^ ]{3}|[^ ]{2} ))"
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(groups), F.lit(1)))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams, for two trigram arrays."""


    def ratio(a: Column, b: Column) -> Column:
        shared = F.size(F.array_intersect(a, b))
        return let(
            F.struct(shared.alias("shared"), (F.size(a) + F.size(b) - shared).alias("total")),
            lambda n: F.when(n["total"] > 0, n["shared"] / n["total"]).otherwise(F.lit(0.0)),
        )

    return let(left, lambda a: let(right, lambda b: ratio(a, b)))
