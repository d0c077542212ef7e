"""Genetic codes: translation tables by number, and proteins of coding sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard code, its codons in the order of TCAG, and what the other tables change (codon, amino acid), with their start codons.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CHANGES = {
    1: "",
    2: "AGA* AGG* ATAM TGAW",
    3: "ATAM CTTT CTCT CTAT CTGT TGAW",
    4: "TGAW",
    5: "AGAS AGGS ATAM TGAW",
    6: "TAAQ TAGQ",
    9: "AAAN AGAS AGGS TGAW",
    10: "TGAC",
    11: "",
    12: "CTGS",
    13: "AGAG AGGG ATAM TGAW",
    14: "AAAN AGAS AGGS TAAY TGAW",
    15: "TAGQ",
    16: "TAGL",
    21: "TGAW ATAM AGAS AGGS AAAN",
    22: "TCA* TAGL",
    23: "TTA*",
    24: "AGAS AGGK TGAW",
    25: "TGAG",
}
STARTS = {
    1: "TTG CTG ATG",
    2: "ATT ATC ATA ATG GTG",
    3: "ATA ATG GTG",
    4: "TTA TTG CTG ATT ATC ATA ATG GTG",
    5: "TTG ATT ATC ATA ATG GTG",
    6: "ATG",
    9: "ATG GTG",
    10: "ATG",
    11: "TTG CTG ATT ATC ATA ATG GTG",
    12: "CTG ATG",
    13: "TTG ATA ATG GTG",
    14: "ATG",
    15: "ATG",
    16: "ATG",
    21: "ATG GTG",
    22: "ATG",
    23: "ATT ATG GTG",
    24: "TTG CTG ATG GTG",
    25: "TTG ATG GTG",
}
#: The table that 0 stands for.
DEFAULT = 11


def table(number: int) -> dict[str, str]:
    """Codon -> amino acid ('*' for stops) of a translation table."""
    number = number or DEFAULT
    if number not in CHANGES:
        raise ValueError(f"there is no translation table {number}")
    own = {a + b + c: STANDARD[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    return own | {x[:3]: x[3] for x in CHANGES[number].split()}


def stops(number: int) -> set[str]:
    return {c for c, a in table(number).items() if a == "*"}


def starts(number: int) -> set[str]:
    return set(STARTS[number or DEFAULT].split())


def protein(cds: Column, number: int = DEFAULT, whole_start: bool = True) -> Column:
    """The protein of a coding sequence: codons with other letters are X, an incomplete last codon is left out, a stop at the end is not written.

    With ``whole_start`` a start codon in front is M.
    """
    letters = F.translate(F.upper(cds), "U", "T")
    codons = F.regexp_extract_all(letters, F.lit("(...)"), 1)
    code = F.create_map(*(F.lit(x) for pair in sorted(table(number).items()) for x in pair))
    amino = F.transform(codons, lambda c: F.coalesce(F.element_at(code, c), F.lit("X")))
    text = F.regexp_replace(F.array_join(amino, ""), r"\*$", "")
    if not whole_start:
        return text
    return F.when(F.get(codons, F.lit(0)).isin(*sorted(starts(number))), F.concat(F.lit("M"), F.substring(text, 2, 1 << 30))).otherwise(text)
