"""Column functions: ids and headers of proteins, letters of paralogs, kinds of sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the accession pattern of headers.
ACCESSION = r"^(?:sp|tr)\|([^|]+)\|"


def header_transformer(kind: str) -> Callable[[Column], Column]:
    """An expression factory for protein ids out of headers: noop or accession."""
    if kind == "noop":
        return lambda header: header
    if kind == "accession":
        return lambda header: F.when(header.rlike(ACCESSION), F.regexp_extract(header, ACCESSION, 1)).otherwise(header)
    raise ValueError(f"unknown header transformer: {kind}")


def root_id(group_id: Column) -> Column:
    """The root of a placement's group id: what stands before the first dot and behind the colon."""
    return F.split_part(F.split_part(group_id, F.lit("."), F.lit(1)), F.lit(":"), F.lit(2))


def letters(number: Column) -> Column:
    """0 to a, 25 to z, 26 to aa, 702 to aaa: the letters of a paralog's place, as in numbered lists of letters."""
    # A 64-bit number has 14 letters at most.
    start = F.struct(number.cast("long").alias("n"), F.lit("").alias("s"))
    step = lambda acc, _: F.when(acc["n"] >= 0, F.struct((F.floor(acc["n"] / 26) - 1).cast("long").alias("n"), F.concat(F.chr(F.lit(97) + acc["n"] % 26), acc["s"]).alias("s"))).otherwise(acc)
    return F.aggregate(F.array_repeat(F.lit(0), 14), start, step, lambda acc: acc["s"])


def header_parts(header: Column) -> dict[str, Column]:
    """The parts of a protein header such as "gene||SPECI||12": id, species and number, and the id cut to what tools take."""
    parts = {name: F.split_part(header, F.lit("||"), F.lit(i)) for i, name in enumerate(("protein", "species", "number"), 1)}
    return parts | {"short": F.substring(header, 1, 230)}


def is_dna(sequence: Column) -> Column:
    """Whether all letters but gaps and X are nucleotides, ambiguous ones included."""
    return ~F.upper(sequence).rlike("[^ACGTRYSWKMBDHVN?X-]")


def is_species_code(text: Column) -> Column:
    """Whether a text begins with a five-letter species code."""
    return text.rlike("^[A-Z][A-Z0-9]{4}")
