"""Operator 8: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get numbers 0..n-1 in the order of (doc_id, crc32 of the text, size). A Feistel network with modular
addition permutes the numbers of a rectangle a x b that just covers n; numbers that land outside are permuted
again until they are inside (cycle walking). The place p of a row gives its shard p mod k and its slot p div k,
so shard sizes differ by one row at most, slots have no gap, and place, shard and slot of any row number can be
computed without the data.

Only ids, sizes and checksums are shuffled, once, by ranges; texts stay where they are read. All of it is
DataFrame and SQL work.

Defined results: a null text has size 8 and the checksum of no bytes. Null ids come first. Equal rows get
numbers of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import written

#: Multipliers and offsets of the rounds, and the two primes of the round function.
ROUNDS = ((104729, 7919, 130363, 1299709), (611953, 15485863, 224737, 32452843), (350377, 49979687, 746773, 67867967), (1020379, 86028121, 479909, 104395301), (742211, 122949823, 999331, 141650939), (899981, 160481183, 524287, 179424673))
PRIME, MODULUS = 1073741789, 2147483647
#: Walks at most; see walk_bound.
WALKS = 40


def rectangle(n: int) -> tuple[int, int]:
    """The sides of the smallest rectangle with one side ceil(sqrt(n)) that covers n."""
    a = isqrt(max(n - 1, 0)) + 1
    return a, -(-n // a) if n else 1


def walk_bound(n: int) -> bool:
    """Whether WALKS walks are surely enough: fewer numbers lie outside than walks are done.

    Beyond that n the chance that a number is still outside is below (1/sqrt(n))**WALKS, under 1e-120; a row
    that were would raise an error, not be lost.
    """
    a, b = rectangle(n)
    return a * b - n < WALKS


def place(number: int, n: int, seed: int = 0) -> int:
    """The permuted place of a row number, in plain Python."""
    a, b = rectangle(n)
    while True:
        left, right = divmod(number, b)
        for i, (m1, c1, m2, c2) in enumerate(ROUNDS):
            left, right = right, (left + ((right * m1 + c1 + seed) % PRIME) * ((right * m2 + c2 + seed) % PRIME) % MODULUS) % (b if i % 2 else a)
        number = left * b + right
        if number < n:
            return number


def place_sql(number: str, n: int, seed: int = 0) -> str:
    """``place`` as a Spark SQL expression."""
    a, b = rectangle(n)
    rounds = ", ".join(f"named_struct('m1', {m1}L, 'c1', {c1 + seed}L, 'm2', {m2}L, 'c2', {c2 + seed}L, 'm', {b if i % 2 else a}L)" for i, (m1, c1, m2, c2) in enumerate(ROUNDS))
    once = lambda x: f"aggregate(array({rounds}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L), (s, c) -> named_struct('l', s.r, 'r', (s.l + ((s.r * c.m1 + c.c1) % {PRIME}L) * ((s.r * c.m2 + c.c2) % {PRIME}L) % {MODULUS}L) % c.m), s -> s.l * {b}L + s.r)"
    walked = f"aggregate(sequence(2, {WALKS}), {once(number)}, (x, _) -> if(x < {n}L, x, {once('x')}))"
    return f"transform(array({walked}), p -> if(p < {n}L, p, cast(raise_error('the walk did not end') as bigint)))[0]"


def numbered(df: DataFrame, order: list[str], label: str) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` 0..n-1 in the given order, and n. Spark writes it as a table in between.

    One range shuffle; then a prefix sum over one count for each partition.
    """
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id()), label)
    part = F.shiftright("place_", 33)
    counts = rows.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    starts = counts.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("start_"))
    out = rows.withColumn("part_", part).join(starts, "part_")
    return out.withColumn("row_number", F.col("start_") + F.col("place_").bitwiseAND((1 << 33) - 1)).drop("place_", "part_", "start_"), rows.count()


def feistel_shards(documents: DataFrame, shards: int = 24, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    narrow = documents.select(F.col(doc_id).alias("doc_id"), (F.octet_length(text_).cast("long") + 8).alias("size"), F.crc32(F.encode(text_, "UTF-8")).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "text_crc32", "size"], "rows")
    rows = rows.withColumn("p_", F.expr(place_sql("row_number", n, seed)) if n else F.lit(0).cast("long"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p_") % shards).cast("int").alias("shard"), F.expr(f"p_ div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def feistel_shards_sql(shards: int = 24, seed: int = 0) -> str:
    """The same in DuckDB SQL, over a table documents. DuckDB has no crc32, so text_crc32 is computed bit by bit
    from a table of 256 remainders."""
    rounds = " UNION ALL ".join(f"SELECT {i} AS i, {m1}::BIGINT AS m1, {c1 + seed}::BIGINT AS c1, {m2}::BIGINT AS m2, {c2 + seed}::BIGINT AS c2" for i, (m1, c1, m2, c2) in enumerate(ROUNDS))
    return f"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT b, 0, b FROM (SELECT unnest(range(256))::BIGINT AS b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
docs AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
sums AS (SELECT doc_id, size, CASE WHEN size = 8 THEN 0::BIGINT ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    [(strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 for i in range(size - 8)]),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) END AS text_crc32 FROM docs, crc_table),
rows AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS rn, count(*) OVER () AS n FROM sums),
sides AS (SELECT rows.*, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM rows),
rounds AS ({rounds}),
walk(rn, i, a, b, n, l, r) AS (
  SELECT rn, 0, a, b, n, rn // b, rn % b FROM sides
  UNION ALL
  SELECT rn, w.i + 1, a, b, n, r, (l + ((r * m1 + c1) % {PRIME}) * ((r * m2 + c2) % {PRIME}) % {MODULUS}) % (CASE WHEN w.i % 2 = 1 THEN b ELSE a END)
  FROM walk w JOIN rounds ON rounds.i = w.i % {len(ROUNDS)}
  WHERE w.i = 0 OR w.i % {len(ROUNDS)} > 0 OR l * b + r >= n),
ended AS (SELECT rn, l * b + r AS p FROM walk WHERE i > 0 AND i % {len(ROUNDS)} = 0 AND l * b + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INTEGER AS shard, (p // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM sides JOIN ended USING (rn)"""
