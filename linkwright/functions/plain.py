"""Normalisation of whole Arrow batches of records, with the results of the expressions in `text`.

Spark interprets functions of arrays, and each executor first compiles the
expressions of a record; whole records are sooner normalised in Python. Tests
hold both against each other for every character.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

from . import lexicon as lex

INPUT = ("business_name", "business_address", "country")
MADE = ("name", "addr", "area", "house", "post", "keys")
#: Countries and first words whose results are held.
HELD = 1 << 16

_no_word, _digits = re.compile(r"\W+"), re.compile(r"\d+")
_address_words = {k: "" if v in lex.ADDRESS_STOPWORDS else v for k, v in ({w: w for w in lex.ADDRESS_STOPWORDS} | lex.ADDRESS_WORDS).items()}
_class = {c: d for d, cs in lex.SOUND_CLASSES.items() for c in cs}


def clean(value: str | None) -> str:
    """N-2."""
    if value is None or value.strip().lower() in lex.NO_VALUE:
        return ""
    if not value.isascii():
        value = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return _no_word.sub(" ", value.lower().replace("&", " and ")).strip(" ")


def name_of(cleaned: str) -> str:
    return " ".join([lex.NAME_WORDS.get(w, w) for w in cleaned.split(" ") if w])


def address_of(cleaned: str) -> str:
    return " ".join([w for w in [_address_words.get(w, w) for w in cleaned.split(" ")] if w])


@lru_cache(HELD)
def area(country: str | None) -> str:
    """N-5, or the name for records without a country."""
    cleaned = clean(country)
    return lex.COUNTRIES.get(cleaned, cleaned) or lex.UNKNOWN_COUNTRY


def postcode(runs: list[str]) -> str:
    """N-8, of the digit runs of a cleaned address."""
    long = [r for r in runs if len(r) >= 4]
    return max(long, key=len) if long else runs[-1] if runs else ""


@lru_cache(HELD)
def sound_key(word: str) -> str:
    """N-9."""
    letters = [c for c in word.lower() if "a" <= c <= "z"]
    if not letters:
        return ""
    runs: list[str] = []
    for d in map(_class.get, letters):
        if d and runs[-1:] != [d]:
            runs.append(d)
    return (letters[0] + "".join(runs[letters[0] in _class :]))[:5]


def fields(name: str | None, address: str | None, country: str | None) -> tuple:
    """MADE of a record: normalised fields and its five keys (B-1 to B-6)."""
    address = clean(address)
    name, addr, where, runs = name_of(clean(name)), address_of(address), area(country), _digits.findall(address)
    house, post, short = runs[0] if runs else "", postcode(runs), name.replace(" ", "")[:4]
    keys = [f"{where}|{short}", f"{where}|{''.join(sorted(_digits.findall(addr)))}", f"{where}|{post}", f"{where}|{house}|{short[:2]}", f"{where}|{sound_key(name.partition(' ')[0])}"]
    return name, addr, where, house, post, keys


def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records with MADE in place of columns of these names."""
    for batch in batches:
        made = list(zip(*map(fields, *(batch.column(c).to_pylist() for c in INPUT)), strict=True)) or [()] * len(MADE)
        kept = [c for c in batch.schema.names if c not in MADE]
        arrays = [pa.array(x, pa.list_(pa.string()) if c == "keys" else pa.string()) for c, x in zip(MADE, made, strict=True)]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *arrays], [*kept, *MADE])
