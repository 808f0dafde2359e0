"""Column functions: encoding of nucleotide texts, meta-symbols, integer helpers.

Letters are digits, in symbol order: TERM 0, A 1, C 2, T 3, G 4. Binary string order of the
digits is then the order of the symbols, and a group of d letters reads as an octal number.
Null gives null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters in symbol order and their digits.
LETTERS, DIGITS = "ACTG", "1234"
MOST_D = 8


def check_d(d: int) -> int:
    """Meta-symbols have 1 to 8 letters."""
    if not 1 <= d <= MOST_D:
        raise ValueError(f"d must be in 1..{MOST_D}")
    return d


def encode(letters: Column) -> Column:
    """ACTG to 1234; a zero byte is a terminator."""
    return F.translate(letters, LETTERS + "\x00", DIGITS + "0")


def decode(enc: Column) -> Column:
    """Digits to letters; a terminator prints as backslash and 0."""
    return F.replace(F.translate(enc, DIGITS, LETTERS), F.lit("0"), F.lit("\\0"))


def terminated(enc: Column) -> Column:
    """enc with one terminator at its end, unless it has one."""
    return F.when(enc.endswith("0"), enc).otherwise(F.concat(enc, F.lit("0")))


def fasta_normalise(raw: Column) -> Column:
    """Headers (from any > to the end of its line) and all but ACTG and zero bytes dropped, encoded, terminated."""
    body = F.regexp_replace(F.regexp_replace(raw, ">[^\\n]*(\\n|$)", ""), "[^ACGT\\x00]", "")
    return terminated(encode(body))


def zero_terminated(text: Column) -> Column:
    """text with a zero byte at its end, unless it has one."""
    return F.when(text.endswith("\x00"), text).otherwise(F.concat(text, F.lit("\x00")))


def checked_pattern(pattern: Column, strict: bool = False) -> Column:
    """A pattern's digits; null, or an error if strict, where it has other letters than ACTG."""
    other = F.raise_error(F.lit("a pattern may hold A, C, T, G only")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(pattern.rlike("^[ACGT\\x00]*\\z"), encode(pattern)).when(pattern.isNotNull(), other)


def octal(digits: Column) -> Column:
    """The number that octal digits spell; the first is the highest. At most 20 digits."""
    return F.conv(digits, 8, 10).cast("long")


def packed(enc: Column) -> Column:
    """3 bits a symbol, high bits first, as lower-case hexadecimal, filled with zeros to whole bytes."""
    n = F.length(enc)
    # A text is cut in one pass: substring() would count from its begin for each group.
    groups = F.transform(F.regexp_extract_all(enc, F.lit(".{1,8}"), F.lit(0)), lambda g: F.lower(F.lpad(F.conv(F.rpad(g, 8, "0"), 8, 16), 6, "0")))
    return F.when(n == 0, F.lit("")).otherwise(F.substring(F.array_join(groups, ""), F.lit(1), 2 * F.ceil(3 * n / 8).cast("int")))


def unpacked(hexed: Column, n: Column) -> Column:
    """The first n symbols of packed hexadecimal."""
    groups = F.transform(F.regexp_extract_all(hexed, F.lit(".{1,6}"), F.lit(0)), lambda g: F.lpad(F.conv(F.rpad(g, 6, "0"), 16, 8), 8, "0"))
    return F.when(n == 0, F.lit("")).otherwise(F.substring(F.array_join(groups, ""), F.lit(1), n.cast("int")))


def slice_of(enc: Column, begin: Column, end: Column) -> Column:
    """Symbols [begin, end)."""
    return F.substring(enc, (begin + 1).cast("int"), (end - begin).cast("int"))


def meta_padded(enc: Column, d: int) -> Column:
    """enc filled with terminators to a multiple of d, so that no tail is lost."""
    return F.rpad(enc, (F.ceil(F.length(enc) / d) * d).cast("int"), F.lit("0"))


def meta_symbols(enc: Column, d: int) -> Column:
    """The groups of d symbols, as an array of digit strings."""
    check_d(d)
    return F.regexp_extract_all(meta_padded(enc, d), F.lit(f".{{{d}}}"), F.lit(0))


def div_up(a: Column, b: Column) -> Column:
    """a / b, rounded up."""
    return F.floor((a + b - 1) / b).cast("long")


def bit_length(v: Column) -> Column:
    """Number of binary digits: 15 has 4, 16 has 5, 0 has none."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v))).cast("long")


def align8(v: Column) -> Column:
    """The next multiple of 8."""
    return (8 * F.floor((v + 7) / 8)).cast("long")


def bits_reversed(v: Column, bits: int) -> Column:
    """The low bits of v in reverse."""
    low = v.cast("long").bitwiseAND((1 << bits) - 1)  # lpad() would keep the high ones
    return F.conv(F.reverse(F.lpad(F.bin(low), bits, "0")), 2, 10).cast("long")


def node_capacity(d: int, leaf: bool) -> int:
    """Suffixes that fit a 4096-byte tree node: 5-byte trie nodes, branches of one symbol and a 2-byte
    place, and 4 bytes a suffix in a leaf or two fences and a child for every two in an inner node."""
    check_d(d)
    symbol = 1 if d == 1 else -(-3 * d // 8)
    step = (5 + 2 * (symbol + 2)) * 2 + (4 * 2 if leaf else 12)  # what two more suffixes take
    return 2 * (4096 - 5 - 30) // step
