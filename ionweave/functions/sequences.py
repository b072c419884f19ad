"""Peptide sequences: notation, fragment annotations, digestion and mass, sort keys; column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Monoisotopic residue masses, water and proton in dalton (fixed values).
MONOISOTOPIC = {
    "A": 71.03711379, "C": 103.00918496, "D": 115.02694303, "E": 129.04259309, "F": 147.06841391,
    "G": 57.02146374, "H": 137.05891186, "I": 113.08406398, "K": 128.09496302, "L": 113.08406398,
    "M": 131.04048509, "N": 114.04292744, "P": 97.05276385, "Q": 128.05857751, "R": 156.10111102,
    "S": 87.03202841, "T": 101.04767847, "V": 99.06841391, "W": 186.07931295, "Y": 163.06332853,
    "U": 150.95363559, "O": 237.14772687,
}
WATER, PROTON = 18.0105646942, 1.00727646687
#: Ion types by the number that stores them (fixed values).
ION_TYPES = {"a": 1, "b": 2, "c": 3, "x": 4, "y": 5, "z": 6, "I": 7, "m": 8, "p": 9, "r": 10}


def mgf_to_proforma(seq: Column) -> Column:
    """Masses behind residues go into brackets; leading masses become a terminal or unlocalised modification."""
    bracketed = F.regexp_replace(seq, r"([A-Z])([+-]?\d+\.\d+)", "$1[$2]")
    two = F.regexp_replace(bracketed, r"^([+-]?\d+\.\d+)([+-]\d+\.\d+)([A-Z])", "[$1]?[$2]-$3")
    return F.regexp_replace(two, r"^([+-]?\d+\.\d+)([A-Z])", "[$1]-$2")


def sptxt_to_proforma(seq: Column, mods: Column) -> Column:
    """``mods`` is ``n/pos,residue,name/...``; a null or ``0`` leaves the sequence as it is. Position -1 is the N-terminus."""
    listed = F.filter(F.split(F.coalesce(mods, F.lit("0")), "/"), lambda m: F.size(F.split(m, ",")) >= 3)
    name_at = lambda i: F.try_element_at(F.transform(F.filter(listed, lambda m: F.element_at(F.split(m, ","), 1).cast("int") == i), lambda m: F.element_at(F.split(m, ","), 3)), F.lit(1))
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    marked = F.transform(letters, lambda c, i: F.when(name_at(i).isNotNull(), F.concat(c, F.lit("["), name_at(i), F.lit("]"))).otherwise(c))
    front = F.when(name_at(F.lit(-1)).isNotNull(), F.concat(F.lit("["), name_at(F.lit(-1)), F.lit("]-"))).otherwise(F.lit(""))
    return F.concat(front, F.array_join(marked, ""))


def fragment_annotation(text: Column, types: str = "abyp") -> Column:
    """``y7^2/0.1`` or ``y7+2`` as (ion_type, ion_index, charge); null for anything else, also for losses."""
    pattern = rf"^([{types}])(\d+)(?:\^(\d+)|\+(\d+))?(?:/.*|,.*|\s.*|$)"
    part = lambda k: F.regexp_extract(text, pattern, k)
    charge = F.coalesce(F.nullif(part(3), F.lit("")), F.nullif(part(4), F.lit("")), F.lit("1")).cast("int")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("ion_type"), part(2).cast("int").alias("ion_index"), charge.alias("charge")))


def encode_ion_type(ion: Column) -> Column:
    """The number of an ion type; 0 for any other."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in ION_TYPES.items() for v in kv])[ion], F.lit(0))


def decode_ion_type(number: Column) -> Column:
    """The ion type of a number; ``_`` for any other."""
    return F.coalesce(F.create_map(*[F.lit(v) for k, n in ION_TYPES.items() for v in (n, k)])[number], F.lit("_"))


def natural_key(text: Column) -> Column:
    """A sort key: digit runs by value, other runs in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), 0)
    return F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), F.lpad(r, 20, "0")).otherwise(F.lower(r)))


def plain(seq: Column) -> Column:
    """Without modification masses, isoleucine written as leucine."""
    return F.translate(F.regexp_replace(seq, r"n?\[[^\]]*\]-?", ""), "I", "L")


def edit_distance(a: Column, b: Column, normalised: bool = False) -> Column:
    """Levenshtein distance; over the longer length if ``normalised``; infinite if either is null."""
    d = F.levenshtein(a, b).cast("double")
    d = d / F.greatest(F.length(a), F.length(b)) if normalised else d
    return F.coalesce(d, F.lit(float("inf")))


def cleave(proteins: DataFrame, sequence: str = "sequence", missed: int = 0, shortest: int = 6, longest: int = 50) -> DataFrame:
    """Distinct tryptic ``peptide`` of all proteins: cut after K or R unless P follows, up to ``missed`` cuts left out."""
    pieces = proteins.select(F.filter(F.split(F.col(sequence), r"(?<=[KR])(?!P)"), lambda s: s != "").alias("s"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.transform(F.sequence(i, F.least(i + missed, F.size("s"))), lambda j: F.array_join(F.slice("s", i, j - i + 1), ""))))
    out = pieces.where(F.size("s") > 0).select(F.explode(spans).alias("peptide")).distinct()
    return out.where(F.length("peptide").between(shortest, longest) & ~F.col("peptide").rlike("[^A-Z]|[BJXZ]"))


def mass(peptide: Column) -> Column:
    """Monoisotopic mass of a plain sequence."""
    table = F.create_map(*[F.lit(v) for kv in MONOISOTOPIC.items() for v in kv])
    return F.aggregate(F.filter(F.split(peptide, ""), lambda c: c != ""), F.lit(WATER), lambda a, c: a + F.coalesce(table[c], F.lit(0.0)))


def precursor_mz(peptide: Column, charge: Column) -> Column:
    return mass(peptide) / charge + PROTON
