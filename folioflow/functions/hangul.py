"""Hangul arithmetic on the syllable block that begins at U+AC00, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import nfkc

# Fixed values of the Unicode block: 19 initials, each with 21 vowels and 28 finals.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
FIRST, LAST = 0xAC00, 0xD7A3
#: Fixed values of the writing system: doubled initials share the group of the plain one.
FOLDED = {"ㄲ": "ㄱ", "ㄸ": "ㄷ", "ㅃ": "ㅂ", "ㅆ": "ㅅ", "ㅉ": "ㅈ"}


def _letters(text: Column, of_syllable) -> Column:
    def one(letter: Column) -> Column:
        at = F.ascii(letter) - FIRST
        return F.when(F.ascii(letter).between(FIRST, LAST), of_syllable(at)).otherwise(letter)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def initials(text: Column) -> Column:
    """Each syllable replaced by its initial consonant; other characters stay."""
    return _letters(text, lambda at: F.substring(F.lit(INITIALS), F.floor(at / 588).cast("int") + 1, F.lit(1)))


def jamo(text: Column) -> Column:
    """Each syllable taken apart into its letters; other characters stay."""

    def parts(at: Column) -> Column:
        final = F.pmod(at, F.lit(28))
        return F.concat(
            F.substring(F.lit(INITIALS), F.floor(at / 588).cast("int") + 1, F.lit(1)),
            F.substring(F.lit(VOWELS), F.floor(F.pmod(at, F.lit(588)) / 28).cast("int") + 1, F.lit(1)),
            F.when(final > 0, F.substring(F.lit(FINALS), final.cast("int"), F.lit(1))).otherwise(""),
        )

    return _letters(text, parts)


def group_key(title: Column) -> Column:
    """The index letter of a title: Hangul initial (doubled ones folded), A-Z, kana, han, or # for the rest.

    A letter whose capital is several letters (ß) is one of the rest.
    """
    first = F.substring(F.trim(title), 1, 1)
    # The compatibility form of single consonants is another block, so these stay as they are.
    letter = F.when(F.ascii(first).between(0x3131, 0x314E), first).otherwise(F.upper(F.substring(nfkc(first), 1, 1)))
    code = F.ascii(letter)
    initial = initials(letter)
    folded = initial
    for double, plain in FOLDED.items():
        folded = F.when(initial == double, plain).otherwise(folded)
    return (
        F.when(code.between(FIRST, LAST) | code.between(0x3131, 0x314E), folded).when(code.between(65, 90) & (F.length(letter) == 1), letter)
        .when(code.between(0x3040, 0x30FF), "kana").when(code.between(0x3400, 0x4DBF) | code.between(0x4E00, 0x9FFF), "han").otherwise("#")
    )


def suggestion_rank(title: Column, typed: str) -> Column:
    """1 prefix, 2 inside, 3 initials, 4 letters with one slip; null where nothing fits."""
    word = F.lower(F.lit(typed))
    name = F.lower(title)
    near = F.levenshtein(F.substring(jamo(name), F.lit(1), F.length(jamo(word))), jamo(word)) <= 1
    return F.when(F.startswith(name, word), 1).when(F.contains(name, word), 2).when(F.contains(initials(name), word), 3).when(near & (F.length(jamo(word)) > 2), 4)
