"""Normalisation as Column -> Column: no Python on executors, so that it stays within generated code.

Cleaning follows Python's idea of words (letters and numbers of any script and
the underscore), which Java's \\w is not; see the patterns.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lex


def let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space of Unicode, as Java's classes name it.
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
#: Decompositions of up to so many characters are made by place, longer ones from a map, Hangul syllables by rule.
PLACES = 2
#: Hangul syllables, and their leading, middle and trailing letters in order.
HANGUL = (0xAC00, 0xD7A3)
JAMO = ((0x1100, 19), (0x1161, 21), (0x11A8, 27))


@cache
def _decompositions() -> dict[str, str]:
    """Each character that is not its own compatibility decomposition without combining marks, and that ('' for a mark)."""
    found = {}
    for first in range(0x80, 0x110000, 0x80):
        if 0xD800 <= first < 0xE000:
            continue
        block = "".join(map(chr, range(first, first + 0x80)))
        if unicodedata.is_normalized("NFKD", block) and not any(map(unicodedata.combining, block)):
            continue  # as most are, which is much sooner told
        for char in block:
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if plain != char:
                found[char] = plain
    return found


@cache
def _accent_table() -> tuple[str, str]:
    """For translate(): characters with one-character decompositions, then what is deleted."""
    short = {k: v for k, v in _decompositions().items() if len(v) < 2}
    order = sorted(short, key=lambda k: (not short[k], k))
    return "".join(order), "".join(short[k] for k in order)


@cache
def _places() -> list[tuple[str, str]]:
    """For translate(), one pair per place: characters with decompositions of 2 to PLACES characters to that place's (or nothing)."""
    some = {k: v for k, v in _decompositions().items() if 2 <= len(v) <= PLACES and not HANGUL[0] <= ord(k) <= HANGUL[1]}
    out = []
    for i in range(PLACES):
        order = sorted(some, key=lambda k: (len(some[k]) <= i, k))
        out.append(("".join(order), "".join(some[k][i] for k in order if len(some[k]) > i)))
    return out


@cache
def _long_forms() -> str:
    """For str_to_map(): characters with longer decompositions."""
    return "\x01".join(f"{k}\x02{v}" for k, v in _decompositions().items() if len(v) > PLACES and not HANGUL[0] <= ord(k) <= HANGUL[1])


@cache
def _spread() -> str:
    """A regular expression of the characters with decompositions of several characters."""
    codes = sorted(ord(k) for k, v in _decompositions().items() if len(v) > 1)
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def _syllable(ch: Column) -> Column:
    """A Hangul syllable's letters: syllables are numbered by leading, middle and trailing letter (or none)."""
    first, middle, last = ("".join(chr(a + i) for i in range(n)) for a, n in JAMO)
    n = F.ascii(ch) - HANGUL[0]
    tails = len(last) + 1
    at = lambda letters, i: F.substring(F.lit(letters), i, F.lit(1))
    lead = at(first, F.floor(n / (len(middle) * tails)).cast("int") + 1)
    vowel = at(middle, F.floor(F.pmod(n, F.lit(len(middle) * tails)) / tails).cast("int") + 1)
    tail = F.pmod(n, F.lit(tails))
    return F.concat(lead, vowel, F.when(tail > 0, at(last, tail)).otherwise(F.lit("")))


def strip_accents(c: Column) -> Column:
    """The compatibility decomposition without combining marks (N-1).

    ASCII texts, by far the most, skip the tables. Only texts that hold a
    character with a decomposition into several (ligatures, fractions, Hangul)
    are taken apart into characters; nothing leaves generated code for Python.
    """
    source, target = _accent_table()

    def spread(ch: Column) -> Column:
        parts = F.concat(*(F.translate(ch, a, b) for a, b in _places()))
        longer = F.try_element_at(F.str_to_map(F.lit(_long_forms()), F.lit("\x01"), F.lit("\x02")), ch)
        in_places = F.translate(ch, _places()[0][0], "") == ""
        hangul = ch.between(chr(HANGUL[0]), chr(HANGUL[1]))
        return F.when(hangul, _syllable(ch)).when(in_places, parts).otherwise(F.coalesce(longer, ch))

    whole = F.array_join(F.transform(F.split(c, ""), spread), "")
    several = F.when(c.rlike(_spread()), whole).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(several, source, target)).otherwise(c)


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def clean(c: Column) -> Column:
    """Lower case, no accents, `&` as a word, anything but words to single spaces (N-2); no value gives ''."""
    text = F.replace(F.lower(strip_accents(c)), F.lit("&"), F.lit(" and "))
    text = F.trim(F.regexp_replace(text, r"[^a-z0-9_\p{L}\p{N}]+", " "))  # letters of ASCII first, as most are
    return F.when(c.isNull() | c.rlike(rf"(?i)^{BLANK}*({'|'.join(lex.NO_VALUE)}){BLANK}*\z"), F.lit("")).otherwise(text)


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, " "), "")  # generated code, which a lambda is not


def _mapped(words: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def normalize_name(c: Column) -> Column:
    """Cleaned, with legal forms shortened (N-3)."""
    return name_of(clean(c))


def name_of(cleaned: Column) -> Column:
    return F.array_join(_mapped(tokens(cleaned), lex.NAME_WORDS), " ")


def normalize_address(c: Column) -> Column:
    """Cleaned, with words shortened and landmark words dropped (N-4)."""
    return address_of(clean(c))


def address_of(cleaned: Column) -> Column:
    words = _mapped(tokens(cleaned), lex.ADDRESS_WORDS)
    return F.array_join(F.filter(words, lambda t: ~t.isin(*lex.ADDRESS_STOPWORDS)), " ")


def normalize_country(c: Column) -> Column:
    """Cleaned, with other names of known countries replaced; unknown ones pass (N-5)."""
    pairs = F.create_map(*(F.lit(x) for pair in lex.COUNTRIES.items() for x in pair))
    return let(clean(c), lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def token_set(c: Column) -> Column:
    """Distinct tokens (N-6)."""
    return F.array_distinct(tokens(c))


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\p{Nd}+"), F.lit(0))


def house_number(cleaned: Column) -> Column:
    """First digit run of a cleaned address (N-7)."""
    return F.regexp_extract(cleaned, r"\p{Nd}+", 0)


def postcode(cleaned: Column) -> Column:
    """Longest digit run of four or more, the first of equals; else the last run; else '' (N-8)."""

    def pick(runs: Column) -> Column:
        longest = F.aggregate(runs, F.lit(""), lambda best, r: F.when((F.length(r) >= 4) & (F.length(r) > F.length(best)), r).otherwise(best))
        return F.when(longest != "", longest).otherwise(F.coalesce(F.get(runs, F.size(runs) - 1), F.lit("")))

    return let(digit_runs(cleaned), pick)


def sound_key(word: Column) -> Column:
    """First letter and up to four phonetic classes (N-9).

    Letters without a class do not part equal classes, so uncoded letters go,
    runs collapse, and the first letter's own class is skipped.
    """
    coded = "".join(lex.SOUND_CLASSES.values())
    digits = "".join(d * len(cs) for d, cs in lex.SOUND_CLASSES.items())
    silent = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in coded)
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")

    def key(w: Column) -> Column:
        runs = F.regexp_replace(F.translate(w, coded + silent, digits), r"(\d)\1+", "$1")
        rest = F.when(F.substring(w, 1, 1).rlike(f"[{coded}]"), F.substring(runs, 2, 100)).otherwise(runs)
        return F.when(w == "", F.lit("")).otherwise(F.substring(F.concat(F.substring(w, 1, 1), rest), 1, 5))

    return let(letters, key)


def digit_key(address: Column) -> Column:
    """All digit runs of a normalised address, sorted as strings and joined (N-10)."""
    return F.array_join(F.array_sort(digit_runs(address)), "")


def first_token(name: Column) -> Column:
    """Text up to the first space (N-11)."""
    return F.substring_index(F.coalesce(name, F.lit("")), " ", 1)


def name_prefix(name: Column, n: int) -> Column:
    """First n characters without spaces (N-12)."""
    return F.substring(F.replace(name, F.lit(" "), F.lit("")), 1, n)


def plain_country(c: Column) -> Column:
    """Trimmed lower case only, as features compare it (N-13)."""
    return F.coalesce(F.lower(stripped(c)), F.lit(""))
