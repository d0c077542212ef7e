"""Functions of sequences and their text formats, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue token ids.
RESIDUE_TOKENS = {"L": 4, "A": 5, "G": 6, "V": 7, "S": 8, "E": 9, "R": 10, "T": 11, "I": 12, "D": 13, "P": 14, "K": 15, "Q": 16, "N": 17, "F": 18, "Y": 19, "M": 20, "H": 21, "W": 22, "C": 23, "X": 24, "B": 25, "U": 26, "Z": 27, "O": 28, ".": 29, "-": 30}
CLS, PAD, EOS, UNKNOWN = 0, 1, 2, 3
MAX_RESIDUES, QUANTUM = 1022, 128
# Bytes that a GFF attribute value escapes, beside everything outside 0x20 to 0x7e.
GFF_ESCAPED = ("%", "\t", "\n", "\r", ";", "=", "&", ",", "#", "?")


def reverse_complement(s: Column) -> Column:
    """Upper case, reversed, with A-T, C-G and U-A exchanged; every other letter stays."""
    return F.reverse(F.translate(F.upper(s), "ACGTU", "TGCAA"))


def canonical(s: Column) -> Column:
    return F.least(s, reverse_complement(s))


def gc_content(s: Column) -> Column:
    n = F.length(s)
    return F.when(n > 0, F.length(F.regexp_replace(s, "[^GCgc]", "")) / n).otherwise(F.lit(0.0))


def clean_length(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"\s", "")).cast("long")


def wrapped(s: Column, width: int = 80) -> Column:
    return F.regexp_replace(s, f"([^\\n]{{{width}}})(?=[^\\n])", "$1\n")


def coding_sequence(contig: Column, begin: Column, end: Column, strand: Column) -> Column:
    """The part of a contig between two 1-based inclusive coordinates, clipped to it; reverse-complemented on '-'; null if empty."""
    first, last = F.greatest(F.least(begin, end), F.lit(1)), F.least(F.greatest(begin, end), F.length(contig))
    cut = F.substring(contig, first.cast("int"), (last - first + 1).cast("int"))
    return F.when(last >= first, F.when(strand == "-", reverse_complement(cut)).otherwise(F.upper(cut)))


def gff_id(attributes: Column) -> Column:
    """The value of the first ID attribute, or null."""
    return F.nullif(F.regexp_extract(attributes, r"(?:^|;)(ID=[^;]*)", 1), F.lit("")).substr(F.lit(4), F.lit(1 << 30))


def gff_escape(s: Column) -> Column:
    """Percent escapes, byte by byte, for what a GFF attribute may not hold."""
    out = s
    for c in GFF_ESCAPED:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    # what is left outside printable ASCII, as its UTF-8 bytes
    plain = out.rlike(r"^[\x20-\x7e]*$")
    by_byte = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(c.rlike(r"^[\x20-\x7e]?$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")
    return F.when(s.isNull(), s).when(plain, out).otherwise(by_byte)


def append_attributes(attributes: Column, added: Column) -> Column:
    base = F.regexp_replace(attributes, ";+$", "")
    return F.concat(base, F.when(base == "", F.lit("")).otherwise(F.lit(";")), added)


def residues(s: Column) -> Column:
    """White space and one closing stop mark dropped, in upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(s, r"\s", ""), r"\*$", ""))


def residue_tokens(s: Column, most: int = MAX_RESIDUES) -> Column:
    """cls, the ids of the first ``most`` residues, eos. ``s`` is clean."""
    known = F.create_map(*(F.lit(x) for pair in RESIDUE_TOKENS.items() for x in pair))
    letters = F.filter(F.split(F.substring(s, 1, most), ""), lambda c: c != "")
    return F.concat(F.array(F.lit(CLS)), F.transform(letters, lambda c: F.coalesce(F.try_element_at(known, c), F.lit(UNKNOWN))), F.array(F.lit(EOS)))


def truncated(s: Column, most: int = MAX_RESIDUES) -> Column:
    return F.length(s) > most


def padded_length(n: Column, quantum: int = QUANTUM) -> Column:
    return (F.ceil((n + 2) / quantum) * quantum).cast("long")


def batch_cap(padded: Column, budget: int, heads: int, most: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(budget) / (F.lit(heads) * padded * padded)))).cast("long")


def padded_to(tokens: Column, n: Column) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(PAD), (n - F.size(tokens)).cast("int")))


def sample_name(file_name: Column) -> Column:
    """A read file's sample: its name without mate number and format extension."""
    return F.regexp_replace(file_name, r"(_[12])?\.(fastq|fasta|fna|fnq|faa|fas|pep|fq|fa)(\.gz)?$", "")


def without_extensions(name: Column) -> Column:
    return F.regexp_replace(name, r"(?:\.[^.]+)+$", "")


def column_state(reference: Column, mapped: Column) -> Column:
    """'-' where a mapped base equals the reference's, ' ' where there is none, else the base; case does not matter."""
    return F.when(F.upper(mapped) == F.upper(reference), F.lit("-")).when(mapped == "-", F.lit(" ")).otherwise(F.upper(mapped))


def masked_ambiguous(seq: Column) -> Column:
    return F.regexp_replace(seq, "[^ACGTUacgtu-]", "N")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def duration(seconds: Column) -> Column:
    return F.format_string("%.1f s", seconds)


def byte_size(n: Column) -> Column:
    return F.when(n >= 1e9, F.format_string("%.1f GB", n / 1e9)).otherwise(F.format_string("%.1f MB", n / 1e6))


def looks_like_protein(seq: Column, letters: int = 50) -> Column:
    """Whether the first letters hold one that is no nucleotide: IUPAC's ambiguity codes count as nucleotides."""
    return F.upper(F.substring(seq, 1, letters)).rlike("[EFILPQXZJO]")


def looks_like_alignment(text: Column) -> Column:
    return F.substring(text, 1, 2000).rlike(r"(?m)^>\S")


def first_of_keys(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def fnv1a(s: Column) -> Column:
    """FNV-1a, 64 bits, of ASCII text, as decimal(20,0). Every step is exact decimal arithmetic."""
    mod, prime = F.lit("18446744073709551616").cast("decimal(20,0)"), F.lit("1099511628211").cast("decimal(13,0)")
    start = F.lit("14695981039346656037").cast("decimal(20,0)")

    def step(h: Column, c: Column) -> Column:
        low = F.pmod(h, F.lit(256).cast("decimal(20,0)")).cast("int")
        mixed = (h - low.cast("decimal(20,0)") + low.bitwiseXOR(F.ascii(c)).cast("decimal(20,0)")).cast("decimal(20,0)")
        # prime = 2^40 + 435; both parts stay within 38 digits
        high = F.pmod(mixed, F.lit("16777216").cast("decimal(20,0)")).cast("decimal(8,0)") * F.lit("1099511627776").cast("decimal(13,0)")
        return F.pmod((high.cast("decimal(38,0)") + (mixed.cast("decimal(20,0)") * F.lit(435).cast("decimal(3,0)")).cast("decimal(38,0)")), mod.cast("decimal(38,0)")).cast("decimal(20,0)")

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), start, step)


def to_precision(x: Column, digits: int = 7) -> Column:
    """A number in so many significant digits, as text: positional for exponents from -6 to below ``digits``, else with an exponent as in 1.5e+9. Null stays null."""
    x = x.cast("double")
    scientific = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).try_cast("int")
    positional = F.printf(F.concat(F.lit("%."), F.greatest(digits - 1 - exponent, F.lit(0)).cast("string"), F.lit("f")), x)
    return F.when(x.isNull(), F.lit(None).cast("string")).when(exponent.between(-6, digits - 1), positional).otherwise(F.regexp_replace(scientific, r"e([+-])0+(?=\d)", "e$1"))


def quality_cased(seq: Column, qual: Column, least: int) -> Column:
    """Bases of a quality (Phred+33) of ``least`` or more in upper case, the others in lower case; null if the texts are not equally long."""
    marked = F.array_join(F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda c, q: F.when(F.ascii(q) - 33 >= least, F.upper(c)).otherwise(F.lower(c))), "")
    return F.when(F.length(seq) == F.length(qual), marked)
