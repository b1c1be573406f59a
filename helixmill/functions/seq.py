"""Column functions over bases, identifiers and numbers. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substitution codes 0-3 of a read base against each reference base, in the order of the codes.
SUBSTITUTES = {"A": "CGTN", "C": "AGTN", "G": "TACN", "T": "GCAN", "N": "ACGT"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(c: Column | str) -> Column:
    """Reverse complement; letters other than A, C, G, T stay as they are."""
    return F.reverse(F.translate(_col(c), "ACGT", "TGCA"))


def has_n(c: Column | str) -> Column:
    return F.contains(_col(c), F.lit("N"))


def base_digits(c: Column | str, order: str = "ACGT") -> Column:
    """Bases as digits 0-3 in the given order (``AGCT`` for read order keys, ``ACGT`` for packing)."""
    return F.translate(_col(c), order, "0123")


def base_code(c: Column | str, order: str = "ACGT") -> Column:
    """Number of at most 31 bases, first base highest, 2 bits each."""
    return F.conv(base_digits(c, order), 4, 10).cast("bigint")


def window_key(c: Column | str, start: int, end: int) -> Column:
    """Letters ``start`` to ``end`` (0-based, inclusive)."""
    return F.substring(_col(c), start + 1, end - start + 1)


def dictionary_windows(max_len: int) -> list[tuple[int, int]]:
    """The two index windows around the middle of the longest read (inclusive bounds)."""
    half = max_len // 2
    width = 32 if max_len > 100 else max_len * 32 // 100
    return [(half - width, half - 1), (half, half + width - 1)]


def canonical(c: Column | str) -> Column:
    """The smaller of a string of bases and its reverse complement."""
    return F.least(_col(c), revcomp(c))


def kmers(c: Column | str, k: int) -> Column:
    """All windows of ``k`` letters in order; an empty array for shorter strings."""
    name = _col(c)
    n = F.length(name)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(k)))
    return F.when(n >= k, every).otherwise(F.array().cast("array<string>"))


def letters(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), ""), lambda x: x != "")


def noise(read: Column | str, ref: Column | str) -> Column:
    """Differences of a read from its reference of equal length: array of (dpos, code), positions as steps."""
    read, ref = _col(read), _col(ref)
    code = F.create_map(*[F.lit(x) for r, subs in SUBSTITUTES.items() for i, s in enumerate(subs) for x in (r + s, str(i))])
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.length(read) - 1, F.lit(0))), lambda i: F.substr(read, i + 1, F.lit(1)) != F.substr(ref, i + 1, F.lit(1)))
    before = F.concat(F.array(F.lit(0)), at)
    return F.transform(at, lambda p, i: F.struct((p - F.get(before, i)).alias("dpos"), F.element_at(code, F.concat(F.substr(ref, p + 1, F.lit(1)), F.substr(read, p + 1, F.lit(1)))).alias("code")))


def apply_noise(ref: Column | str, diffs: Column | str) -> Column:
    """The read that ``noise`` was taken from."""
    ref, diffs = _col(ref), _col(diffs)
    base = F.create_map(*[F.lit(x) for r, subs in SUBSTITUTES.items() for i, s in enumerate(subs) for x in (r + str(i), s)])
    start = F.struct(ref.alias("s"), F.lit(0).alias("p"))

    def step(a, d):
        p = a["p"] + d["dpos"]
        new = F.element_at(base, F.concat(F.substr(ref, p + 1, F.lit(1)), d["code"]))
        return F.struct(F.overlay(a["s"], new, p + 1, F.lit(1)).alias("s"), p.alias("p"))

    return F.aggregate(diffs, start, step, lambda a: a["s"])


def bit_cost(a: Column | str, b: Column | str, wide: bool) -> Column:
    """Distance of two strings of equal length in differing code bits: 2-bit codes, or 3-bit codes with N if ``wide``.

    Fixed values: A=00 C=01 G=10 T=11, and A=000 C=001 G=010 T=011 N=100.
    """
    a, b = _col(a), _col(b)
    code = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4} if wide else {"A": 0, "C": 1, "G": 2, "T": 3}
    price = F.create_map(*[F.lit(x) for p, i in code.items() for q, j in code.items() if p != q for x in (p + q, (i ^ j).bit_count())])
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.aggregate(differ, F.lit(0), lambda t, i: t + F.element_at(price, F.concat(F.substr(a, i, F.lit(1)), F.substr(b, i, F.lit(1)))))


def mate_pattern(a: Column | str, b: Column | str) -> Column:
    """How the ids of two mates relate: 2 equal; 1 last letter 1 and 2; 3 '1' and '2' after every blank; 0 otherwise."""
    a, b = _col(a), _col(b)
    same_length = F.length(a) == F.length(b)
    ends = a.endswith("1") & b.endswith("2") & (F.substr(a, F.lit(1), F.length(a) - 1) == F.substr(b, F.lit(1), F.length(b) - 1))
    blanks = (F.regexp_replace(a, " 1", " 2") == b) & ~F.regexp_like(a, F.lit(" ([^1]|$)"))
    return F.when(~same_length, 0).when(a == b, 2).when(ends, 1).when(blanks, 3).otherwise(0)


def fits_pattern(a: Column | str, b: Column | str, code: Column | int) -> Column:
    """Whether a pair obeys a pattern chosen elsewhere; under 3, equal ids without a blank do too."""
    a, b, code = _col(a), _col(b), F.lit(code) if isinstance(code, int) else code
    own = mate_pattern(a, b)
    ends = (F.length(a) == F.length(b)) & a.endswith("1") & b.endswith("2") & (F.substr(a, F.lit(1), F.length(a) - 1) == F.substr(b, F.lit(1), F.length(b) - 1))
    blanks = (F.length(a) == F.length(b)) & (F.regexp_replace(a, " 1", " 2") == b) & ~F.regexp_like(a, F.lit(" ([^1]|$)"))
    return F.when(code == 1, ends).when(code == 2, own == 2).when(code == 3, blanks | ((a == b) & ~F.contains(a, F.lit(" ")))).otherwise(F.lit(False))


def mate_id(a: Column | str, code: Column | int) -> Column:
    """Id of mate 2 from that of mate 1."""
    a, code = _col(a), F.lit(code) if isinstance(code, int) else code
    blank = F.instr(a, " ")
    return F.when(code == 2, a).when(code == 1, F.concat(F.substr(a, F.lit(1), F.length(a) - 1), F.lit("2"))).when((code == 3) & (blank > 0), F.overlay(a, F.lit("2"), blank + 1, F.lit(1))).otherwise(a)


def fake_id(pair: Column | str, mate: Column | str) -> Column:
    """Id given to reads whose ids were dropped: ``@<1-based pair>/<mate>``."""
    return F.concat(F.lit("@"), (_col(pair) + 1).cast("string"), F.lit("/"), _col(mate).cast("string"))


#: Nine-digit numbers below 2^28.
_SMALL9 = "1[0-9]{8}|2[0-5][0-9]{7}|26[0-7][0-9]{6}|268[0-3][0-9]{5}|2684[0-2][0-9]{4}|26843[0-4][0-9]{3}|268435[0-3][0-9]{2}|2684354[0-4][0-9]|26843545[0-5]"
ID_TOKEN = f"[A-Za-z]+|0+|(?:{_SMALL9})[0-9]?|[1-9][0-9]{{0,8}}|[^A-Za-z0-9]"


def id_tokens(c: Column | str) -> Column:
    """Tokens of an id: letters; a run of zeros; a number without leading zero; any other character.

    A number takes further digits while its value is below 2^28; what follows is the next token.
    """
    return F.regexp_extract_all(_col(c), F.lit(f"(?s){ID_TOKEN}"), F.lit(0))


def token_type(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.regexp_like(c, F.lit("^[A-Za-z]")), "alpha").when(F.regexp_like(c, F.lit("^0")), "zeros").when(F.regexp_like(c, F.lit("^[1-9]")), "digit").otherwise("char")


def zigzag(c: Column | str) -> Column:
    c = _col(c).cast("bigint")
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def unzigzag(c: Column | str) -> Column:
    c = _col(c).cast("bigint")
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-c.bitwiseAND(F.lit(1)))


def varint_bytes(c: Column | str) -> Column:
    """Bytes a number takes as a zigzag varint of 7 bits a byte."""
    z = zigzag(c)
    return F.lit(1) + sum((F.when(F.shiftrightunsigned(z, 7 * k) != 0, 1).otherwise(0) for k in range(1, 10)), F.lit(0))


def digits(c: Column | str) -> Column:
    return F.length(F.abs(_col(c)).cast("string"))


def xlog2x(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def binary_entropy(p: Column) -> Column:
    return -xlog2x(p) - xlog2x(1 - p)
