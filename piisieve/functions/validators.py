"""Checksum predicates on strings."""

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .patterns import DIGIT, SPACE

# The two-digit code of each first letter, and the weight of each of the eleven digits.
ID_LETTER_CODES = {
    "A": 10, "B": 11, "C": 12, "D": 13, "E": 14, "F": 15, "G": 16, "H": 17, "I": 34,
    "J": 18, "K": 19, "L": 20, "M": 21, "N": 22, "O": 35, "P": 23, "Q": 24, "R": 25,
    "S": 26, "T": 27, "U": 28, "V": 29, "W": 32, "X": 30, "Y": 31, "Z": 33,
}
ID_WEIGHTS = [1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1]
LUHN_LENGTHS = (13, 19)


@cache
def _digit_table() -> tuple[str, str]:
    """Every non-ASCII decimal digit, and the ASCII digit of the same value."""
    digits = [
        chr(code)
        for code in range(128, sys.maxunicode + 1)
        if unicodedata.category(chr(code)) == "Nd"
    ]
    return "".join(digits), "".join(str(unicodedata.decimal(d)) for d in digits)


# What upper-cases to one of the letters A to Z, and those letters.
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyzıſ", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS"


def ascii_digits(text: Column) -> Column:
    """Replace decimal digits of any script by 0-9."""
    return F.translate(text, *_digit_table())


def strip(text: Column) -> Column:
    """Drop Unicode whitespace at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_not_blank(text: Column) -> Column:
    return text.rlike(rf"[^{SPACE}]")


def luhn_valid(text: Column) -> Column:
    """13 to 19 digits, other characters aside, that pass the Luhn check; false for NULL."""
    digits = let(
        F.regexp_replace(text, rf"[^{DIGIT}]", ""), lambda d: F.when(d.rlike(r"^[0-9]*\z"), d).otherwise(ascii_digits(d))
    )
    valid = let(digits, lambda d: F.length(d).between(*LUHN_LENGTHS) & F.call_function("luhn_check", d))
    return F.coalesce(valid, F.lit(False))


def national_id_valid(text: Column) -> Column:
    """One letter, 1 or 2, eight digits, and a weighted digit sum divisible by ten; false for NULL.

    The text is put into plain letters and digits once, and its digit string is built once, each bound by `let`: written out, the
    sum would repeat patterns and `translate` for each of its digits. Of all characters only those of `_LOWER` upper-case to one
    letter A to Z, so `translate` does it without the full case mapping, which costs more than all the rest.
    """
    letter_codes = F.create_map(
        *[F.lit(part) for letter, code in ID_LETTER_CODES.items() for part in (letter, str(code))]
    )

    def divisible(of: Column) -> Column:
        total = F.lit(0)
        for k, weight in enumerate(ID_WEIGHTS):
            total = total + F.substring(of, k + 1, 1).cast("int") * weight
        return total % 10 == 0

    def checked(number: Column) -> Column:
        code = letter_codes[F.substring(number, 1, 1)]
        return F.when(number.rlike(r"^[A-Z][12][0-9]{8}\z"), let(F.concat(code, F.substring(number, 2, 9)), divisible))

    digits, plain = _digit_table()

    def number(of: Column) -> Column:
        folded = F.translate(strip(of), digits + _LOWER, plain + _UPPER)
        return F.when(of.rlike(r"^[A-Z][12][0-9]{8}\z"), of).otherwise(folded)

    return F.coalesce(let(let(text, number), checked), F.lit(False))
