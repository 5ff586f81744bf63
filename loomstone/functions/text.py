"""Text functions: columns in, columns out, without Python at run time (but for what says so)."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql.types import ArrayType, StringType

from . import segments

# Fixed value: words that carry no signal in a posting's title.
STOPWORDS = ("estagio", "estagiario", "estagiaria", "trainee", "pessoa", "vaga", "de", "em", "para", "na", "no", "um", "uma", "e", "a", "o")
# Fixed value: legal forms at the end of a company's name.
LEGAL_FORMS = ("sa", "ltda", "me", "eireli", "epp")
# Phrasings of a least semester, the first that gives a value from 1 to 8 counts.
PERIOD_PATTERNS = (
    r"(?i)a partir do\s*(\d{1,2})\s*[ºo°]?\s*per[ií]odo",
    r"(?i)(\d{1,2})\s*[ºo°]?\s*per[ií]odos?\s*em diante",
    r"(?i)a partir do\s*(\d{1,2})\s*[ºo°]?\s*semestre",
    r"(?i)semestre\s*exigido\s*:?\s*(\d{1,2})",
)


#: White space, as in ECMAScript's ``\\s``: Java's and Python's own notions of it are others.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_CLASS = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def _bare(text: str) -> str:
    """Canonical decomposition without the combining marks U+0300 to U+036F."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F)


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters other than Hangul syllables that ``_bare`` changes: those that become one, and the others."""
    changed = {c: _bare(c) for i in range(0xC0, sys.maxunicode + 1) if not (0xAC00 <= i <= 0xD7A3 or 0xD800 <= i <= 0xDFFF) and (c := chr(i)) and unicodedata.decomposition(c) and _bare(c) != c}
    return {c: b for c, b in changed.items() if len(b) == 1}, {c: b for c, b in changed.items() if len(b) != 1}


_ONE, _MORE = _decompositions()
_ACCENTED, _PLAIN = "".join(_ONE), "".join(_ONE.values())


def _apart(c: Column, table: dict[str, str], more: str = "", otherwise: Callable[[Column], Column] = lambda x: x) -> Column:
    """Text with the characters of a table replaced by several, character by character; texts without any stay.

    more: further characters (of a pattern's class) for which ``otherwise`` is asked. Latin texts are told by a cheap test.
    """
    several = F.from_json(F.lit(json.dumps(table)), "map<string,string>")
    found = f"[{more}{''.join(f'\\x{{{ord(x):x}}}' for x in table)}]"
    beyond = f"[^\\x00-\\x{{{min(map(ord, table)) - 1:x}}}]"

    def apart(text: Column) -> Column:
        each = F.array_join(F.transform(F.split(text, ""), lambda x: F.coalesce(F.try_element_at(several, x), otherwise(x))), "")
        return F.when(text.rlike(beyond) & text.rlike(found), each).otherwise(text)

    return F.transform(F.array(c), apart)[0]  # bound once: nested calls would repeat the text's expression


def _hangul(c: Column) -> Column:
    """A Hangul syllable as its two or three letters."""
    code = F.ascii(c) - 0xAC00
    letter = lambda x: F.decode(F.unhex(F.lpad(F.hex(x), 4, "0")), "UTF-16BE")
    tail = code % 28
    return F.concat(letter(0x1100 + F.floor(code / 588)), letter(0x1161 + F.floor(code % 588 / 28)), F.when(tail > 0, letter(0x11A7 + tail)).otherwise(F.lit("")))


def strip_accents(c: Column) -> Column:
    """Text in canonical decomposition, without the combining marks U+0300 to U+036F.

    Most characters become one, by translation. Texts with Hangul syllables or characters that become several are taken
    apart by character.
    """
    syllable = lambda x: F.when(x.between(F.lit("\uac00"), F.lit("\ud7a3")) & (F.length(x) == 1), _hangul(x)).otherwise(x)
    apart = _apart(F.translate(c, _ACCENTED, _PLAIN), _MORE, "\\x{ac00}-\\x{d7a3}", syllable)
    return F.regexp_replace(apart, "[\u0300-\u036f]", "")


def trimmed(c: Column) -> Column:
    """Text without white space (of any kind) at its ends."""
    return F.regexp_replace(c, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\\z", "")


def _cleaned(c: Column, mark: str) -> Column:
    plain = F.regexp_replace(strip_accents(F.lower(c)), rf"[^\p{{L}}\p{{N}}{SPACE_CLASS}]", mark)
    return F.trim(F.regexp_replace(plain, f"[{SPACE_CLASS}]+", " "))


def normalize(c: Column) -> Column:
    """Lower case, no accents, punctuation deleted, white space collapsed: ``Back-End`` -> ``backend``."""
    return _cleaned(c, "")


def normalize_title(c: Column) -> Column:
    """As ``normalize``, but punctuation becomes a space: ``Back-End`` -> ``back end``."""
    return _cleaned(c, " ")


#: For similarity the same rule holds.
normalize_for_similarity = normalize_title


def plain_normalize(text: str, mark: str = "") -> str:
    """``normalize`` (or with mark " " ``normalize_title``) of a constant, on the driver."""
    kept = "".join(" " if c in SPACES else c if unicodedata.category(c)[0] in "LN" else mark for c in _bare(text.lower()))
    return " ".join(x for x in kept.split(" ") if x)


def _compatible() -> dict[str, str]:
    """Characters that compatibility decomposition turns into ASCII letters, digits and ``+ # .`` (besides what canonical does), with spaces for the rest."""
    found = {}
    for i in range(0xA0, sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.normalize("NFKD", c) != unicodedata.normalize("NFD", c):
            folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
            if re.search(r"[A-Za-z0-9+#.]", folded):
                found[c] = re.sub(r"[^A-Za-z0-9+#.]", " ", folded)
    return found


_COMPATIBLE = _compatible()
_WIDE, _NARROW = ("".join(x) for x in zip(*((c, f) for c, f in _COMPATIBLE.items() if len(f) == 1), strict=True))


def normalized_words(c: Column) -> Column:
    """Letters, digits and ``+ # .`` in lower case between spaces, padded with a space at both ends.

    Characters whose compatibility decomposition has any of these are folded to it.
    """
    folded = _apart(F.translate(c, _WIDE, _NARROW), {k: v for k, v in _COMPATIBLE.items() if len(v) > 1})
    words = F.trim(F.regexp_replace(F.lower(strip_accents(folded)), r"[^a-z0-9+#.]+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def plain_words(text: str) -> str:
    """``normalized_words`` of a constant, on the driver."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(c) <= 0x36F)
    return f" {re.sub(r'[^a-z0-9+#.]+', ' ', bare.lower()).strip()} "


def includes_term(padded: Column, term: Column) -> Column:
    """Whether a term of two characters or more stands as whole words in ``normalized_words`` text."""
    needle = F.trim(normalized_words(term))
    return (F.length(needle) >= 2) & F.contains(padded, F.concat(F.lit(" "), needle, F.lit(" ")))


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def title_matches_any(title: Column, terms: Sequence[str], normalized: bool = False) -> Column:
    """Whether any term stands in the title (already in its title form, if normalized) as whole words; empty terms never do."""
    padded = _padded(title if normalized else normalize_title(title))
    return _any([F.contains(padded, F.lit(f" {n} ")) for t in terms if (n := plain_normalize(t, " "))])


def keyword_matches(text: Column, keyword: str) -> Column:
    """Whether a keyword stands in the text: a single word only in the text with punctuation deleted, a phrase in either form."""
    spaced, collapsed = plain_normalize(keyword, " "), plain_normalize(keyword)
    if not spaced:
        return F.lit(False)
    in_collapsed = F.contains(_padded(normalize(text)), F.lit(f" {collapsed} ")) if collapsed else F.lit(False)
    return in_collapsed if " " not in spaced else F.contains(_padded(normalize_title(text)), F.lit(f" {spaced} ")) | in_collapsed


def matched_keywords(spaced: Column, collapsed: Column, keywords: Sequence[str]) -> Column:
    """Those of the keywords that stand in a text given in both (unpadded) forms; an array in the keywords' order."""
    found = []
    for k in keywords:
        s, c = plain_normalize(k, " "), plain_normalize(k)
        hit = F.contains(_padded(collapsed), F.lit(f" {c} ")) if c else F.lit(False)
        if " " in s:
            hit = hit | F.contains(_padded(spaced), F.lit(f" {s} "))
        found.append(F.when(hit, F.lit(k)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def significant_tokens(title: Column) -> Column:
    """Words of a title without stop words, in order."""
    return F.filter(F.split(normalize_for_similarity(title), " "), lambda t: (t != "") & ~t.isin(*STOPWORDS))


def significant_title(title: Column) -> Column:
    """A title's significant words, sorted and joined; empty for null."""
    return F.coalesce(F.array_join(F.array_sort(significant_tokens(title)), " "), F.lit(""))


def bigrams(c: Column) -> Column:
    """Character pairs of a string as numbers, from the code points; of one character, itself; of none, nothing."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda x, y: x * (1 << 21) + y)
    return F.when(F.length(c) >= 2, pairs).when(F.length(c) == 1, codes).otherwise(F.array().cast("array<bigint>"))


#: Bigrams numbered together.
_CHUNK = 64


def numbered_bigrams(title: Column) -> Column:
    """The bigrams of a title's significant words, sorted and joined, as numbers, each with its occurrence number.

    Numbering makes a set of the multiset, so that a built-in set intersection counts common bigrams with repetition.
    Among sorted bigrams, an occurrence's number is its distance from the first equal one; that is looked for within a
    chunk, and once for the bigram that the chunk begins with, so that long titles stay cheap.
    """

    def numbered(o: Column) -> Column:
        def chunk(k: Column) -> Column:
            own, begun = F.slice(o, k * _CHUNK + 1, F.lit(_CHUNK)), F.array_position(o, F.element_at(o, k * _CHUNK + 1))
            bound = F.transform(F.array(F.struct(own.alias("own"), (k * _CHUNK + 1 - begun).alias("before"))), lambda c: F.transform(c["own"], lambda g, i: g * (1 << 21) + F.when(g == c["own"][0], c["before"] + i).otherwise(i + 1 - F.array_position(c["own"], g))))
            return F.element_at(bound, 1)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(o) - 1) / _CHUNK).cast("int")), chunk))

    # bound once
    return F.element_at(F.transform(F.array(F.array_sort(bigrams(significant_title(title)))), lambda o: F.when(F.size(o) == 0, o).otherwise(numbered(o))), 1)


def dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice coefficient of two ``numbered_bigrams``; 0 where both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.greatest(total, F.lit(1)))


def title_similarity(a: Column, b: Column) -> Column:
    """Similarity of two titles, 0 to 1."""
    return dice(numbered_bigrams(a), numbered_bigrams(b))


def company_group(company: Column) -> Column:
    """Normalised company name without legal forms at its end, as long as a word is left."""
    return F.regexp_replace(normalize(company), f"^(.+?)( ({'|'.join(LEGAL_FORMS)}))+$", "$1")


# What each kind of markup becomes, in this order; they define the output.
MARKUP = (
    (r"<(script|style)\b[^>]*>[\s\S]*?</\1>", " "),
    (r"<li\b[^>]*>", "\n- "),
    (r"<br\s*/?>", "\n"),
    (r"</(p|div|h[1-6]|li|ul|ol|tr|table|blockquote)>", "\n\n"),
    (r"</?[a-zA-Z][^>]*>", ""),
)
# How lines are tidied afterwards.
TIDY = ((r"[ \t]+", " "), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"))


def strip_markup(markup: Column) -> Column:
    """HTML to lines of text, entities still encoded: list items as ``- ``, blocks apart by an empty line."""
    for pattern, mark in MARKUP:
        markup = F.regexp_replace(markup, f"(?i){pattern}", mark)
    return markup


def collapse_lines(c: Column) -> Column:
    """Runs of blanks to one, none at line ends, at most one empty line, trimmed."""
    for pattern, mark in TIDY:
        c = F.regexp_replace(c, pattern, mark)
    return trimmed(c)


# The named entities that are decoded; others stay as they are.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
_ENTITY = re.compile(r"&(#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);")


def _decode_entity(m: re.Match[str]) -> str:
    code = m[1]
    if code[0] != "#":
        return ENTITIES.get(code, m[0])
    n = int(code[2:], 16) if code[1] in "xX" else int(code[1:])
    return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "�"


@F.pandas_udf(StringType())
def _decode_numeric(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda t: None if t is None else _ENTITY.sub(_decode_entity, t))


def decode_entities(c: Column, numeric: bool = True) -> Column:
    """Entities decoded in a single pass (``&amp;lt;`` gives ``&lt;``); invalid code points give U+FFFD.

    Without numeric, only named ones, without Python. With it, rows without ``&#`` still take the native way.
    """
    named = c
    for name, char in ENTITIES.items():  # & last, so that what it makes is not decoded again
        named = F.replace(named, F.lit(f"&{name};"), F.lit(char))
    some = F.when(F.contains(c, F.lit("&#")), c)  # other rows aren't handed over
    return F.when(F.contains(c, F.lit("&#")), _decode_numeric(some)).otherwise(named) if numeric else named


def html_to_text(markup: Column, numeric: bool = True) -> Column:
    """Readable text of a posting's rich text."""
    return collapse_lines(decode_entities(strip_markup(markup), numeric))


def had_markup(c: Column) -> Column:
    """Whether there is any tag."""
    return c.rlike(r"<[a-zA-Z/][^>]*>")


def truncate_text(c: Column, most: int) -> Column:
    """Whole paragraphs up to most UTF-16 units; if the first is too long, whole words; if the first word is too long, whole user-perceived characters."""
    joined = F.aggregate(
        F.split(c, r"\n{2,}"),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda a, p: F.when(
            a["open"] & (a["n"] + F.when(a["s"] == "", F.lit(0)).otherwise(F.lit(2)) + segments.units(p) <= most),
            F.struct(F.when(a["s"] == "", p).otherwise(F.concat(a["s"], F.lit("\n\n"), p)).alias("s"), (a["n"] + F.when(a["s"] == "", F.lit(0)).otherwise(F.lit(2)) + segments.units(p)).alias("n"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["s"].alias("s"), a["n"].alias("n"), F.lit(False).alias("open"))),
        lambda a: a["s"],
    )
    # no text has more units than bytes
    fits = (F.octet_length(c) <= most) | (segments.units(c) <= most)
    return F.when(fits, c).when(joined != "", joined).otherwise(segments.truncate_at_word(c, most))


def strip_evidence_tag(c: Column) -> Column:
    """Text without a leading ``- [tag]``."""
    return trimmed(F.regexp_replace(c, rf"^[{SPACE_CLASS}]*-?[{SPACE_CLASS}]*\[[^\]]+\][{SPACE_CLASS}]*", ""))


def log_label(c: Column, most: int = 60) -> Column:
    """One line for a log: control characters become blanks, at most 60 characters and an ellipsis."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{Cntrl}]", " "), r"\s+", " "))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("…"))).otherwise(clean)


def model_output(c: Column) -> Column:
    """The JSON in a model's answer: fences stripped, from the first bracket to the last of its kind."""
    bare = F.regexp_replace(c, r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    first_object, first_array = F.instr(bare, "{"), F.instr(bare, "[")
    as_object = (first_object > 0) & ((first_array == 0) | (first_object < first_array))
    return F.when(as_object, F.regexp_extract(bare, r"(?s)(\{.*\})", 1)).when(first_array > 0, F.regexp_extract(bare, r"(?s)(\[.*\])", 1)).otherwise(F.trim(bare))


def escape_cell(c: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A template with its ``{{KEY}}`` replaced."""
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def fenced_template(c: Column) -> Column:
    """The text in the first fenced block."""
    return F.regexp_extract(c, r"(?s)```[a-zA-Z]*\n(.*?)\n```", 1)


def percent(share: Column) -> Column:
    """A share as a rounded percentage with its sign."""
    return F.concat(F.round(share * 100).cast("long").cast("string"), F.lit("%"))


def minimum_period(text: Column) -> Column:
    """The least semester (1 to 8) that a requirement names, or null."""
    found = []
    for pattern in PERIOD_PATTERNS:
        n = F.regexp_extract(text, pattern, 1).try_cast("int")
        found.append(F.when(n.between(1, 8), n))
    return F.coalesce(*found)
