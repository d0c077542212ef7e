"""FASTA and FASTQ: readers from files or text columns, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Name endings of sequence files.
READS, GENOMES, PROTEINS = ("fastq", "fq", "fnq"), ("fa", "fna", "fasta"), ("faa", "fa", "fasta", "fas", "pep")


def has_format(name: Column, endings: tuple[str, ...]) -> Column:
    return F.lower(name).rlike(rf"\.(?:{'|'.join(endings)})(?:\.gz)?$")


def check_inputs(n_files: int, least: int = 1, most: int = 2) -> int:
    if not least <= n_files <= most:
        raise ValueError(f"{least} to {most} files are needed, not {n_files}")
    return n_files


def fasta_records(texts: DataFrame, text: str = "text") -> DataFrame:
    """The other columns with ``ord``, ``header`` (the whole line) and ``seq`` of each record of FASTA texts.

    A record begins at '>' at a line's start only; line ends, CR too, are dropped; records without letters are kept; what
    stands before the first record is ignored.
    """
    others = [c for c in texts.columns if c != text]
    whole = F.concat(F.lit("\n"), F.regexp_replace(text, "\r", ""))
    pieces = texts.select(*others, F.posexplode(F.slice(F.split(whole, "\n>"), 2, 1 << 30)).alias("ord", "record"))
    cut = F.instr("record", "\n")
    header = F.when(cut > 0, F.col("record").substr(F.lit(1), cut - 1)).otherwise(F.col("record"))
    body = F.when(cut > 0, F.col("record").substr(cut + 1, F.length("record"))).otherwise(F.lit(""))
    return pieces.select(*others, F.col("ord").cast("long").alias("ord"), header.alias("header"), F.replace(body, F.lit("\n"), F.lit("")).alias("seq"))


def protein_records(texts: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """The other columns with ``ord``, ``id``, ``desc`` and ``seq``. Lines that begin with ';' and blank ones are dropped.

    Strict reading fails on letters before the first header, on an empty id and on a text without records.
    """
    others = [c for c in texts.columns if c != text]
    plain = F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), text), "\r", ""), r"\n;[^\n]*", "")
    checked = plain
    if strict:
        head = F.trim(F.regexp_replace(F.element_at(F.split(F.concat(plain, F.lit("\n")), "\n>"), 1), r"\s", ""))
        checked = F.when(head != "", F.raise_error(F.lit("FASTA: letters before the first header"))).when(~plain.contains("\n>"), F.raise_error(F.lit("FASTA: no records"))).otherwise(plain)
    records = fasta_records(texts.select(*others, checked.alias("fasta_")), "fasta_")
    id_ = F.regexp_extract("header", r"^\s*(\S*)", 1)
    if strict:
        id_ = F.when(id_ == "", F.raise_error(F.lit("FASTA: a header without an id"))).otherwise(id_)
    return records.select(*others, "ord", id_.alias("id"), F.trim(F.regexp_extract("header", r"^\s*\S*\s*(.*)$", 1)).alias("desc"), F.regexp_replace("seq", r"\s", "").alias("seq"))


def alignment_records(texts: DataFrame, text: str = "text") -> DataFrame:
    """The other columns with ``ord``, ``id`` (the whole trimmed header) and ``sequence`` of aligned FASTA; text before the first header is ignored."""
    return fasta_records(texts, text).select(*[c for c in texts.columns if c != text], "ord", F.trim("header").alias("id"), F.regexp_replace("seq", r"\s", "").alias("sequence"))


def fastq_records(texts: DataFrame, text: str = "text") -> DataFrame:
    """The other columns with ``ord``, ``header``, ``seq`` and ``qual`` of FASTQ texts: four lines a record, blank lines between records skipped.

    A header without '@', a third line without '+', unequal lengths and a partial last record fail.
    """
    others = [c for c in texts.columns if c != text]
    # each record's four lines are taken off the front, blank lines before it are skipped
    clean = F.regexp_replace(F.regexp_replace(text, "\r", ""), r"\n+\z", "")
    record = r"(?:\A|\n)\n*([^\n]+\n[^\n]*\n[^\n]+\n[^\n]*)"
    rows = texts.select(*others, clean.alias("t_")).where("t_ <> ''")
    found = F.regexp_extract_all("t_", F.lit(record), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace("t_", record, ""), r"\s", "")
    whole = F.when(rest != "", F.raise_error(F.lit("FASTQ: a partial record"))).otherwise(found)
    lines = rows.select(*others, F.posexplode(whole).alias("ord", "r")).select(*others, "ord", F.split("r", "\n").alias("l"))
    bad = F.when(~F.col("l")[0].startswith("@"), F.lit("FASTQ: a header without @")).when(~F.col("l")[2].startswith("+"), F.lit("FASTQ: a third line without +")).when(F.length(F.col("l")[1]) != F.length(F.col("l")[3]), F.lit("FASTQ: sequence and quality of unequal length"))
    header = F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("l")[0].substr(F.lit(2), F.lit(1 << 30)))
    return lines.select(*others, F.col("ord").cast("long").alias("ord"), header.alias("header"), F.col("l")[1].alias("seq"), F.col("l")[3].alias("qual"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, seq) of FASTA files. Records are the reader's lines, so one file is split among tasks; .gz files are read whole."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\A>", "").alias("record")).where(F.trim("record") != "")
    cut = F.instr("record", "\n")
    header = F.when(cut > 0, F.col("record").substr(F.lit(1), cut - 1)).otherwise(F.col("record"))
    return rows.select("file", header.alias("header"), F.when(cut > 0, F.regexp_replace(F.col("record").substr(cut + 1, F.length("record")), r"\n", "")).otherwise("").alias("seq"))


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, header, seq, qual) of files in either format, told by the first letter: '@' or '>'. qual is null for FASTA."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    first = F.substring(F.regexp_replace("text", r"\A[\r\n]+", ""), 1, 1)
    known = texts.withColumn("kind_", F.when(first.isin("@", ">", ""), first).otherwise(F.raise_error(F.lit("neither FASTA nor FASTQ"))))
    fastq = fastq_records(known.where("kind_ = '@'").select("file", "text"))
    fasta = fasta_records(known.where("kind_ = '>'").select("file", "text")).withColumn("qual", F.lit(None).cast("string"))
    return fastq.unionByName(fasta)


def fastq_text(header: Column, seq: Column, qual: Column) -> Column:
    """A record's text, without its last line end; FASTA where there is no quality."""
    return F.when(qual.isNull(), F.concat(F.lit(">"), header, F.lit("\n"), seq)).otherwise(F.concat(F.lit("@"), header, F.lit("\n"), seq, F.lit("\n+\n"), qual))


def write_reads(reads: DataFrame, path: str, compression: str = "gzip") -> None:
    """Reads (header, seq, qual) as compressed text files."""
    reads.select(fastq_text(F.col("header"), F.col("seq"), F.col("qual")).alias("value")).write.option("compression", compression).text(path)


def write_cds(records: DataFrame, path: str, header: str = "header", seq: str = "cds", width: int = 80) -> None:
    from ..functions.sequence import wrapped

    records.select(F.concat(F.lit(">"), header, F.lit("\n"), wrapped(F.col(seq), width)).alias("value")).write.text(path)


def fai_index(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ord, name, length, offset, linebases, linewidth) of each record of FASTA texts with LF line ends.

    Lengths and offsets are in bytes; line widths are those of a record's first line of letters.
    """
    split = F.split(F.concat(F.lit("\n"), F.col(text)), "\n>")
    # bytes before a record: all earlier pieces of its text with their separators, less the line feed put before the text
    pieces = texts.withColumn("text_", F.monotonically_increasing_id()).select(key, "text_", F.posexplode(split).alias("ord", "record"))
    before = Window.partitionBy("text_").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start_", F.sum((F.octet_length("record") + 2).cast("long")).over(before) - 1)
    records = placed.select(key, "ord", "record", "start_").where("ord > 0")
    header = F.element_at(F.split("record", "\n"), 1)
    body = F.when(F.instr("record", "\n") > 0, F.substring("record", F.instr("record", "\n") + 1, F.length("record"))).otherwise("")
    first = F.element_at(F.split(F.concat(body, F.lit("\n")), "\n"), 1)
    has_end = F.instr(body, "\n") > 0
    bases = lambda c: F.octet_length(F.regexp_replace(c, "[^!-~]", "")).cast("long")
    return records.select(key, (F.col("ord") - 1).cast("long").alias("ord"), F.regexp_extract(header, r"^(\S*)", 1).alias("name"), bases(body).alias("length"), (F.col("start_") + F.octet_length(header) + 1).cast("long").alias("offset"), bases(first).alias("linebases"), (F.octet_length(first) + has_end.cast("int")).cast("long").alias("linewidth"))
