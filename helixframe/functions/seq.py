"""Sequence and string expressions: built-in functions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases in order, complements, ambiguity rule.
BASES = "ACGT"
COMPLEMENT = ("ACGTacgtNn", "TGCAtgcaNn")
NOT_BASE = "[^ACGTN]"
#: Bytes that are letters at once.
TOKENS = 4096


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_upper(s: str | Column) -> Column:
    """A-Z only: upper() would turn one letter into two in some alphabets."""
    return F.translate(_col(s), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def dna_of_rna(s: str | Column) -> Column:
    return F.translate(_col(s), "Uu", "Tt")


def ambiguity_to_n(s: str | Column) -> Column:
    return F.regexp_replace(_col(s), NOT_BASE, "N")


def is_clean(s: str | Column, alphabet: str = "ACGTN") -> Column:
    return _col(s).rlike(f"^[{alphabet}]+$")


def reverse_complement(s: str | Column) -> Column:
    return F.reverse(F.translate(_col(s), *COMPLEMENT))


def share_of(s: str | Column, letters: str) -> Column:
    """Share of the characters that are one of the letters; 0 for an empty string."""
    c = _col(s)
    return F.length(F.regexp_replace(c, f"[^{letters}]", "")) / F.greatest(F.length(c), F.lit(1))


def gc_fraction(s: str | Column) -> Column:
    return share_of(s, "GC")


def n_fraction(s: str | Column) -> Column:
    return share_of(s, "N")


def slice_of(s: str | Column, start: str | Column, end: str | Column) -> Column:
    """Half-open, from 0."""
    return _col(s).substr(_col(start) + 1, _col(end) - _col(start))


def strip_to(s: str | Column, alphabet: str, at_most: int) -> Column:
    return F.substring(F.regexp_replace(_col(s), f"[^{alphabet}]", ""), 1, at_most)


#: Letters that stand for one base or several.
IUPAC = "ACGTNRYSWKMBDHV"


def checked(s: str | Column, key: str | Column, most: int, alphabet: str | None = None) -> Column:
    """The sequence, or an error that names the key: if it is empty, over `most` letters long, or has a letter outside the alphabet."""
    c, k = _col(s), _col(key).cast("string")
    fail = lambda text: F.raise_error(F.concat(F.lit("sequence "), F.coalesce(k, F.lit("null")), F.lit(text)))
    out = F.when(c.isNull() | (F.length(c) == 0), fail(" is empty")).when(F.length(c) > most, fail(f" is longer than {most}"))
    if alphabet is not None:
        out = out.when(~c.rlike(f"^[{alphabet}]+$"), fail(f" has letters other than {alphabet}"))
    return out.otherwise(c)


def layer_parts(name: str | Column) -> Column:
    """Struct of a layer's block number (null without one) and the path below it."""
    c = _col(name)
    block = F.regexp_extract(c, r"^blocks\.(\d+)", 1).try_cast("int")
    return F.struct(block.alias("block"), F.regexp_replace(c, r"^blocks\.\d+\.?", "").alias("sublayer"))


def decoded(s: str | Column) -> Column:
    """Bytes of base64."""
    return F.unbase64(_col(s))


def byte_tokens(s: str | Column) -> Column:
    """The UTF-8 bytes of a string, as numbers: as letters of one byte each, in blocks, so the work grows with the length."""
    letters = F.decode(F.encode(_col(s), "UTF-8"), "ISO-8859-1")
    blocks = F.regexp_extract_all(letters, F.lit(f"(?s).{{1,{TOKENS}}}"), F.lit(0))
    return F.flatten(F.transform(blocks, lambda block: F.transform(F.split(block, ""), lambda x: F.ascii(x))))


def resolve_n(s: str | Column, key: str | Column, seed: int = 42) -> Column:
    """Every N becomes a base that a hash of key, position and seed picks, so the result is repeatable."""
    c = _col(s)
    pick = lambda i: F.substring(F.lit(BASES), F.pmod(F.xxhash64(_col(key), i, F.lit(seed)), F.lit(4)).cast("int") + 1, F.lit(1))
    letters = F.transform(F.split(c, ""), lambda x, i: F.when(x == "N", pick(i)).otherwise(x))
    return F.when(c.contains("N"), F.array_join(letters, "")).otherwise(c)


def safe_name(s: str | Column) -> Column:
    return F.substring(F.replace(_col(s), F.lit("/"), F.lit("_")), 1, 80)


def window_id(seq: str | Column, start: str | Column, end: str | Column) -> Column:
    return F.concat_ws(":", _col(seq), _col(start).cast("string"), _col(end).cast("string"))


def wrap(s: str | Column, width: int = 80) -> Column:
    """Line breaks after every `width` characters, of which a line break is one, but the last line's; 0: none."""
    return F.regexp_replace(_col(s), rf"(?s)(.{{{width}}})(?!\z)", "$1\n") if width else _col(s)


def entropy(counts: Column) -> Column:
    """Bits of a map of counts."""
    values = F.map_values(counts)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(values, F.lit(0.0), lambda s, x: s - (x / total) * F.log2(x / total))


def contains_any(text: str | Column, terms: list[str]) -> Column:
    lower = F.lower(_col(text))
    return F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(lower, t))
