"""Column functions on sequence text.

All of them count characters, not bytes, and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes and their complements, position by
# position.  U is read as T, so it complements to A.
IUPAC_CODES = "ATUGCYRSWKMBDHVN-~"
IUPAC_COMPLEMENTS = "TAACGRYSWMKVHDBN-~"

# The FNV parameters of the 32-bit and 64-bit fingerprint.
FNV32_OFFSET = 2166136261
FNV32_PRIME = 16777619
FNV64_OFFSET = 14695981039346656037
FNV64_PRIME = 1099511628211


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


LOWER = "abcdefghijklmnopqrstuvwxyz"


def normalize(seq: Column | str) -> Column:
    """Upper-case a-z and nothing else, so that every position stays.

    Full Unicode upper-casing may lengthen a text (one letter becoming two).
    Where all characters are ASCII the two agree and ``upper`` is the faster.
    """
    seq = _col(seq)
    ascii_only = F.length(seq) == F.octet_length(seq)
    return F.when(ascii_only, F.upper(seq)).otherwise(F.translate(seq, LOWER, LOWER.upper()))


def complement(seq: Column | str) -> Column:
    return F.translate(_col(seq), IUPAC_CODES, IUPAC_COMPLEMENTS)


def is_nucleotide_text(seq: Column | str) -> Column:
    return _col(seq).rlike("^[ACGTUYRSWKMBDHVN~-]*$")


def reverse_complement(seq: Column | str, strict: bool = True) -> Column:
    """Reverse complement; ``strict`` raises on any character outside IUPAC."""
    seq = _col(seq)
    flipped = F.reverse(complement(seq))
    if not strict:
        return flipped
    return F.when(seq.isNull() | is_nucleotide_text(seq), flipped).otherwise(
        F.raise_error(F.concat(F.lit("unknown nucleotide in sequence: "), F.substring(seq, 1, 80)))
    )


def extract_accession(header: Column | str) -> Column:
    """Header text after an optional ``>`` up to the first blank."""
    return F.regexp_extract(_col(header), r"^>?(\S+)", 1)


def pieces(seq: Column | str, size: int) -> Column:
    """Cut text into consecutive pieces of ``size`` characters.

    One regular-expression pass is linear in the text; a ``substr`` per piece
    would walk the text from its start each time.
    """
    return F.regexp_extract_all(_col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def overlapping_pieces(seq: Column | str, size: int, overlap: int) -> Column:
    """Pieces starting every ``size`` characters, each ``overlap`` longer."""
    pattern = f"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"
    return F.regexp_extract_all(_col(seq), F.lit(pattern), F.lit(1))


def kmers_of(text: Column | str, k: int) -> Column:
    """Every substring of length ``k``, stride one, as an array."""
    return F.regexp_extract_all(_col(text), F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def common_prefix_length(a: Column | str, b: Column | str, limit: int) -> Column:
    """Length of the longest common prefix, at most ``limit``.

    Texts that agree as far as both go are settled by one comparison.  For the
    rest, prefix equality is monotone, so counting equal prefixes gives the
    length.  (A chain of projections that halves the range would be shorter to
    run, but a filter pushed through it multiplies the expression.)
    """
    a, b = _col(a), _col(b)
    shared = F.least(F.length(a), F.length(b), F.lit(limit))
    start = F.lit(1)
    equal_prefixes = F.filter(
        F.sequence(F.lit(1), F.lit(limit)),
        lambda i: (i <= shared) & (a.substr(start, i) == b.substr(start, i)),
    )
    return F.when(a.substr(start, shared) == b.substr(start, shared), shared).otherwise(F.size(equal_prefixes))


def fingerprint(kmer: Column | str, k: int, bits: int = 28) -> Column:
    """FNV fingerprint of a k-mer, folded to ``bits`` (16, 24, 28, 32 or 64).

    The 32-bit form multiplies and masks in BIGINT, so no step overflows; it
    unrolls over the ``k`` characters and stays in generated code.  The 64-bit
    form keeps the two 32-bit halves apart for the same reason and returns the
    unsigned value's two's-complement BIGINT.
    """
    kmer = _col(kmer)
    if bits == 64:
        return _fingerprint64(kmer, k)
    if bits not in (16, 24, 28, 32):
        raise ValueError(f"unsupported fingerprint width: {bits}")
    mask32 = F.lit(0xFFFFFFFF)
    h = F.lit(FNV32_OFFSET)
    for i in range(1, k + 1):
        h = ((h * F.lit(FNV32_PRIME)).bitwiseAND(mask32)).bitwiseXOR(
            F.ascii(kmer.substr(i, 1)).cast("bigint")
        )
    if bits == 32:
        return h
    return F.shiftright(h, bits).bitwiseXOR(h).bitwiseAND(F.lit((1 << bits) - 1))


def _fingerprint64(kmer: Column, k: int) -> Column:
    low32 = F.lit(0xFFFFFFFF)
    prime_low = FNV64_PRIME & 0xFFFFFFFF
    prime_shift = (FNV64_PRIME >> 32).bit_length() - 1  # the prime is 2**40 + prime_low

    def advance(state: Column, byte: Column) -> Column:
        lo_product = state["lo"] * F.lit(prime_low)
        hi = (
            state["hi"] * F.lit(prime_low)
            + F.shiftright(lo_product, 32)
            + F.shiftleft(state["lo"], prime_shift)
        ).bitwiseAND(low32)
        lo = lo_product.bitwiseAND(low32).bitwiseXOR(byte)
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    start = F.struct(
        F.lit(FNV64_OFFSET >> 32).cast("bigint").alias("hi"),
        F.lit(FNV64_OFFSET & 0xFFFFFFFF).cast("bigint").alias("lo"),
    )
    characters = F.transform(
        F.sequence(F.lit(1), F.lit(k)),
        lambda i: F.ascii(kmer.substr(i, F.lit(1))).cast("bigint"),
    )
    return F.aggregate(
        characters,
        start,
        advance,
        lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]),
    )
