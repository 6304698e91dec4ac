"""Shards by jump consistent hashing, in DataFrame expressions only.

A key alone and the number of shards decide a row's shard; no ring or table of places is kept.
The key seeds a 64-bit linear congruential generator whose numbers make the key jump from shard to
later shard; the last jump below the number of shards is where it stays. So with one more
shard a row stays or moves to the new one, and 1 in (shards + 1) moves. Both the shard and the
grown shard come from one run of jumps: the grown one is the last jump below shards + 1.

Slots number the rows of a shard from 0 without gaps, by key (see ``numbering``: no task gets
a whole shard). ``write`` lays rows out as one folder per shard, cut in files by a hash of the row.

Defined results: a null key counts as 0; equal keys share a shard whatever else differs, in
consecutive slots by checksum and size of the text; a null text has no bytes and the checksum of
nothing; long texts need no special care (a checksum and a length are all that leaves the
scan); an empty table gives an empty table. ``place`` carries no other columns, ``write`` carries
all; their names may be any, but ``shard`` is replaced by ``write``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.numbering import numbered
from lattica.llm.shared import table

SHARDS = 24
OVERHEAD = 8  # bytes that a row takes besides its text
MULTIPLIER = 2862933555777941757  # of the generator (fixed value)
JUMPS = 64  # the jumps of a key grow with the logarithm of the shards; keys with more go on in a second loop
_A = [MULTIPLIER >> 16 * k & 0xFFFF for k in range(4)]
_HALF = 0xFFFFFFFF


def _next(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64, in 16-bit steps of the multiplier: no sum leaves a long."""
    low, high = key.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(key, 32)

    def up(x: Column) -> Column:
        return F.shiftleft(x.bitwiseAND(F.lit(0xFFFF)), 16)

    first = low * F.lit(_A[0]) + up(low * F.lit(_A[1])) + F.lit(1)
    top = F.shiftright(first, 32) + F.shiftright(low * F.lit(_A[1]), 16) + high * F.lit(_A[0]) + up(high * F.lit(_A[1])) + low * F.lit(_A[2]) + up(low * F.lit(_A[3]))
    return F.shiftleft(top.bitwiseAND(F.lit(_HALF)), 32).bitwiseOR(first.bitwiseAND(F.lit(_HALF)))


def _jump(s: Column, shards: int) -> Column:
    """One jump, unless the next shard lies beyond ``shards`` + 1. A state is the generator's key,
    the shard before, the shard, and the next one."""
    key = _next(s["key"])
    onward = (s["to"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(key, 33) + F.lit(1)).cast("double"))
    moved = F.struct(key.alias("key"), s["at"].alias("before"), s["to"].alias("at"), onward.cast("long").alias("to"))
    return F.when(s["to"] > F.lit(shards), s).otherwise(moved)


def with_shards(rows: DataFrame, key: str, shards: int, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``rows`` with the shard of column ``key`` (a whole number) among ``shards``, and among one more."""
    if shards < 1:
        raise ValueError("at least one shard")
    seed = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    nowhere = F.lit(-1).cast("long")
    start = F.struct(seed.alias("key"), nowhere.alias("before"), nowhere.alias("at"), F.lit(0).cast("long").alias("to"))
    steps = min(shards + 2, JUMPS)
    out = rows.withColumn("_jumps", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: _jump(s, shards)))
    if shards + 2 > JUMPS:
        rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 2)), F.col("_jumps"), lambda s, _: _jump(s, shards))
        out = out.withColumn("_jumps", F.when(F.col("_jumps.to") > shards, F.col("_jumps")).otherwise(rest))
    at = F.col("_jumps.at")
    here = F.when(at < shards, at).otherwise(F.col("_jumps.before"))
    return out.withColumns({shard: here.cast("int"), grown: at.cast("int")}).drop("_jumps")


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = table(with_shards(rows, "doc_id", shards).withColumn("_row", F.monotonically_increasing_id()), "shards")
    out = numbered(rows, [F.col(c) for c in ("doc_id", "text_crc32", "size", "_row")], "slot", "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def balance(placed: DataFrame) -> DataFrame:
    """(shard, rows, bytes, leaving) of each shard that has rows, from ``place``: ``leaving`` go to the new one where one is added."""
    leaves = F.count_if(F.col("grown_shard") != F.col("shard"))
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), leaves.alias("leaving"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 4) -> None:
    """Whole rows in folders ``shard=0``, ``shard=1``... of Parquet, each shard in up to ``files`` files.

    Rows go to a shard's files by a hash of key and text and a salt of the scan, so equal keys don't meet in one.
    """
    docs = docs.drop("shard")
    salt = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(files))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"), salt.alias("file"))
    rows = with_shards(rows, "key", shards).repartition(shards * files, "shard", "file")
    rows.select("row.*", "shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: a CTE with the 256 remainders of a byte, for checksums in SQL; ``t`` is a list of them
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of a string's UTF-8 bytes, where ``crc_table`` is joined."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


ORACLE_SQL = f"""WITH RECURSIVE {CRC_TABLE},
jumps(doc_id, key, bef, cur, nxt) AS (
  SELECT DISTINCT doc_id, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::HUGEINT, -1::BIGINT, -1::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, k, cur, nxt, floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM jumps WHERE nxt <= {SHARDS})),
placed AS (SELECT doc_id, CASE WHEN cur < {SHARDS} THEN cur ELSE bef END::INT AS shard, cur::INT AS grown_shard FROM jumps WHERE nxt > {SHARDS}),
sized AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + {OVERHEAD} AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table)
SELECT s.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM sized s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id"""
