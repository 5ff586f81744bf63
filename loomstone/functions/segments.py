"""Cuts between words and between user-perceived characters, as assertions of regular expressions in the JVM.

Words go by the default word boundary rules of Unicode's text segmentation, with the colon between words as in the common
locale data; characters are extended grapheme clusters. Scripts whose words only a dictionary tells apart (Thai, Lao, Khmer,
Myanmar, ideographs, Hiragana) are cut between clusters. A pattern takes the longest prefix that ends at a cut: it starts at
the budget and goes back, so it costs as much as the last word is long, and looks ahead as far as it needs to.

Lengths are numbers of UTF-16 code units.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

# Classes of the segmentation rules, by script and general category.
_DICTIONARY = r"\p{IsIdeographic}\p{IsHiragana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}"
_KATAKANA = r"\p{IsKatakana}\x{3031}-\x{3035}\x{309B}\x{309C}\x{30A0}\x{30FC}\x{FF70}"
_EXTEND = r"[\p{M}\p{Cf}\x{1F3FB}-\x{1F3FF}\x{FF9E}\x{FF9F}&&[^\x{200B}]]"
_LETTER = rf"[\p{{IsAlphabetic}}&&[^{_DICTIONARY}{_KATAKANA}\p{{M}}\p{{Nd}}\x{{FF9E}}\x{{FF9F}}]]"
_HEBREW = r"[\p{IsHebrew}&&\p{L}]"
_NUMBER = r"[\p{Nd}\x{66B}]"
_JOINER = r"[\p{Pc}\x{202F}]"
_BREAK = r"\r\n\x0B\f\x85\x{2028}\x{2029}"
_BLANK = r"[\p{Zs}&&[^\xA0\x{2007}\x{202F}]]"
_MID_LETTER = r"[\xB7\x{387}\x{55F}\x{5F4}\x{2027}.'\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}]"
_MID_NUMBER = r"[,;\x{37E}\x{589}\x{60C}\x{60D}\x{66C}\x{7F8}\x{2044}\x{FE10}\x{FE14}\x{FE50}\x{FE54}\x{FF0C}\x{FF1B}.'\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}]"
_PICTURE = r"[\p{So}\p{Sm}\x{203C}\x{2049}\x{3030}\x{303D}]"
#: As characters: a look-behind counts code points only if the pattern after its start holds one beyond U+FFFF itself.
_FLAG = "[\U0001f1e6-\U0001f1ff]"
#: Marks that a rule looks back over, at most; flags likewise.
_X = rf"{_EXTEND}{{0,30}}"


def _after(before: str, after: str) -> str:
    """The rule that nothing is cut between what ends with one pattern and what begins with another."""
    return rf"(?!(?={after})(?<={before}))"


#: Holds between two words.
WORD_CUT = "".join(
    [
        _after(r"\r", r"\n"),
        _after(rf"[^{_BREAK}]", _EXTEND),
        _after(r"\x{200D}", _PICTURE),
        _after(_BLANK, _BLANK),
        _after(rf"(?:{_LETTER}|{_NUMBER}|{_JOINER}){_X}", rf"(?:{_LETTER}|{_NUMBER}|{_JOINER})"),
        _after(rf"(?:[{_KATAKANA}]|{_JOINER}){_X}", rf"[{_KATAKANA}]"),
        _after(rf"[{_KATAKANA}]{_X}", _JOINER),
        _after(rf"{_LETTER}{_X}", rf"{_MID_LETTER}{_X}{_LETTER}"),
        _after(rf"{_LETTER}{_X}{_MID_LETTER}{_X}", _LETTER),
        _after(rf"{_NUMBER}{_X}", rf"{_MID_NUMBER}{_X}{_NUMBER}"),
        _after(rf"{_NUMBER}{_X}{_MID_NUMBER}{_X}", _NUMBER),
        _after(rf"{_HEBREW}{_X}", rf"(?:'|\"{_X}{_HEBREW})"),
        _after(rf"{_HEBREW}{_X}\"{_X}", _HEBREW),
        _after(rf"(?<!{_FLAG})(?:{_FLAG}{_FLAG}){{0,20}}{_FLAG}", _FLAG),
    ]
)
# Hangul's kinds of letters, and what attaches to the character before or after it.
_LEAD, _VOWEL, _TAIL, _SYLLABLE = r"\x{1100}-\x{115F}\x{A960}-\x{A97C}", r"\x{1160}-\x{11A7}\x{D7B0}-\x{D7C6}", r"\x{11A8}-\x{11FF}\x{D7CB}-\x{D7FB}", r"\x{AC00}-\x{D7A3}"
_ATTACHED = r"[\p{M}\x{200C}\x{200D}\x{1F3FB}-\x{1F3FF}\x{FF9E}\x{FF9F}\x{E33}\x{EB3}]"
_PREPENDED = r"[\x{600}-\x{605}\x{6DD}\x{70F}\x{890}\x{891}\x{8E2}\x{D4E}\x{110BD}\x{110CD}]"
#: Holds between two extended grapheme clusters. (Java's own assertion looks from the last match on, so it can't go back.)
CLUSTER_CUT = "".join(
    [
        _after(r"\r", r"\n"),
        _after(rf"[^\p{{Cc}}{_BREAK}\x{{200B}}]", _ATTACHED),
        _after(rf"{_PICTURE}{_X}\x{{200D}}", _PICTURE),
        _after(rf"[{_LEAD}]", rf"[{_LEAD}{_VOWEL}{_SYLLABLE}]"),
        _after(rf"[{_VOWEL}{_SYLLABLE}]", rf"[{_VOWEL}{_TAIL}]"),
        _after(rf"[{_TAIL}]", rf"[{_TAIL}]"),
        _after(_PREPENDED, rf"[^\p{{Cc}}{_BREAK}\x{{200B}}]"),
        _after(rf"(?<!{_FLAG})(?:{_FLAG}{_FLAG}){{0,20}}{_FLAG}", _FLAG),
    ]
)
#: Highest first byte of a UTF-16 unit that needs a second unit, and lowest.
_HIGH = (0xD8, 0xDB)


def units(c: Column) -> Column:
    """Length of a text in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def _within(c: Column, most: int) -> Column:
    """Number of whole code points in the first ``most`` UTF-16 units of a text."""
    encoded = F.substring(F.encode(F.substring(c, 1, most), "UTF-16BE"), 1, 2 * most)
    last = F.conv(F.hex(F.substring(encoded, 2 * most - 1, 1)), 16, 10).cast("int")
    halved = F.coalesce(last.between(*_HIGH), F.lit(False)) & (F.octet_length(encoded) == 2 * most)
    return F.length(F.decode(F.when(halved, F.substring(encoded, 1, 2 * most - 2)).otherwise(encoded), "UTF-16BE"))


def longest_prefix(c: Column, most: int, cut: str) -> Column:
    """The longest prefix of at most ``most`` UTF-16 units that ends at a cut; empty if there is none."""
    if most < 1:
        return F.when(c.isNotNull(), F.lit(""))
    pattern = lambda n: F.concat(F.lit("(?s)^(.{1,"), n, F.lit(rf"}}){cut}"))
    wide = F.substring(c, 1, most).rlike(r"[\x{10000}-\x{10FFFF}]")
    n = F.greatest(_within(c, most), F.lit(1))
    found = F.when(wide & (_within(c, most) == 0), F.lit("")).when(wide, F.call_function("regexp_extract", c, pattern(n.cast("string")), F.lit(1)))
    return found.otherwise(F.regexp_extract(c, rf"(?s)^(.{{1,{most}}}){cut}", 1))


def truncate_at_word(c: Column, most: int) -> Column:
    """The longest prefix of whole words without white space at its end; if not even the first word fits, of whole clusters."""
    words = longest_prefix(c, most, WORD_CUT)
    return F.when(words != "", F.regexp_replace(words, r"[\s\p{Zs}\x{2028}\x{2029}\x{FEFF}]+\z", "")).otherwise(longest_prefix(c, most, CLUSTER_CUT))
