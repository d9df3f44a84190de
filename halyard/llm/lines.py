"""Line dedup with content-defined chunks, in DataFrame operations only.

A text is its lines (split at U+000A). Every line has a hash, and a rolling
hash over the hashes of a line and the one before it, taken modulo a prime,
ends a chunk wherever it is divisible by AVERAGE; so an inserted line moves the
boundaries beside it and no others. A run of equal lines is never cut inside,
and one of non-blank lines is a chunk of its own. A chunk of two non-blank lines or more that occurs again
anywhere is kept where it occurs first and removed elsewhere, once the bytes
of its copies have been compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import materialize

#: Lines of a chunk, on average.
AVERAGE = 4
#: The rolling hash is taken modulo this prime, so that all bits of both lines count.
PRIME = 65521


def place() -> Column:
    """An order over (doc_id, no), null doc_id last, that hash aggregation can
    take the least of."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)"))
    return doc * F.lit(1 << 31).cast("decimal(10,0)") + F.col("no").cast("decimal(10,0)")


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def ends_chunk(i: Column, average: int) -> Column:
    """Whether a chunk ends after line i of lines, whose hashes are hashes."""
    at = lambda j: F.coalesce(F.get("hashes", j), F.lit(-1))
    full = lambda j: F.trim(F.get("lines", j)) != ""
    last = i == F.size("hashes") - 1
    rolled = (at(i) != at(i - 1)) & ((at(i) * 31 + at(i - 1)) % PRIME % average == 0)
    run_ends = full(i) & (at(i) == at(i - 1))
    run_begins = full(i + 1) & (at(i + 1) == at(i + 2))
    return last | ((at(i) != at(i + 1)) & (rolled | run_ends | run_begins))


def with_chunks(docs: DataFrame, average: int = AVERAGE) -> DataFrame:
    """docs (doc_id, text) with tkey (a hash of the text), lines, and chunks:
    an array of (no, start, len), start from 0."""
    docs = docs.withColumn("tkey", F.xxhash64("text")).withColumn("lines", F.split("text", "\n", -1))
    docs = docs.withColumn("hashes", F.transform("lines", line_hash))
    ends = F.transform("hashes", lambda h, i: F.when(ends_chunk(i, average), i + 1))
    docs = docs.withColumn("ends", F.filter(ends, lambda e: e.isNotNull())).drop("hashes")
    begin = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
    return docs.withColumn("chunks", F.transform("ends", lambda e, i: F.struct(i.alias("no"), begin(i).alias("start"), (e - begin(i)).alias("len")))).drop("ends")


def chunk_text(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("lines", start + 1, length), "\n")


def repeated_chunks(docs: DataFrame, average: int = AVERAGE) -> DataFrame:
    """(doc_id, tkey, c): the chunks of each document whose hash occurs more
    than once, as an array of (start, len, k1, k2, later); later: it occurs
    before in the corpus."""
    cut = with_chunks(docs, average)
    content = F.transform("chunks", lambda c: F.struct(c["no"].alias("no"), c["start"].alias("start"), c["len"].alias("len"), chunk_text(c["start"], c["len"]).alias("t"), F.size(F.filter(F.slice("lines", c["start"] + 1, c["len"]), lambda x: F.trim(x) != "")).alias("full")))
    keyed = F.transform(F.filter(content, lambda c: c["full"] >= 2), lambda c: F.struct(c["no"].alias("no"), c["start"].alias("start"), c["len"].alias("len"), F.xxhash64(c["t"]).alias("k1"), F.xxhash64(F.lit(1), c["t"]).alias("k2")))
    occurrences = materialize(cut.select("doc_id", "tkey", F.explode(keyed).alias("c")).select("doc_id", "tkey", "c.*").withColumn("at", place()), "chunks")
    repeated = occurrences.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = occurrences.join(repeated, ["k1", "k2"])
    return found.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("start", "len", "k1", "k2", (F.col("at") > F.col("first")).alias("later"))).alias("c"))


def dedup_lines(docs: DataFrame, average: int = AVERAGE) -> DataFrame:
    """docs with n_lines, n_removed (long) and kept (the remaining text).

    The first occurrence is that of the smallest doc_id (null last), then the
    earliest place. Rows of one doc_id and text get one result. Null text: no
    lines, kept null; a text whose lines all go: kept empty; an empty table
    gives an empty one. A very long text is cut like any other. Other columns
    pass through, but for input columns named n_lines, n_removed or kept, which
    the results replace.

    Hashes of chunks meet first. Texts are shuffled once, to their repeated
    chunks, and written with them; copies then meet in an aggregation by their
    bytes, where a chunk in a third of all documents is one row per task."""
    chunks = repeated_chunks(docs.select("doc_id", "text"), average)
    whole = docs.select(F.struct("*").alias("doc_"), F.xxhash64("text").alias("tkey"))
    same = F.col("d.doc_.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.tkey") == F.col("p.tkey"))
    whole = materialize(whole.alias("d").join(chunks.alias("p"), same, "left").select("d.doc_", "p.c"), "texts")
    texts = whole.where("c IS NOT NULL").select(F.split("doc_.text", "\n", -1).alias("lines"), F.explode("c").alias("c"))
    by_bytes = texts.select("c.k1", "c.k2", chunk_text(F.col("c.start"), F.col("c.len")).alias("t")).distinct()
    differing = by_bytes.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    # Chunks of one hash and other bytes (a chance of 2 ** -128 a pair) are left alone.
    differing = materialize(differing.select(F.struct("k1", "k2").alias("k")), "clashes")
    later = F.filter("c", lambda x: x["later"])
    if differing.isEmpty():
        gone = later
    else:
        whole = whole.withColumn("row_", F.monotonically_increasing_id())
        whole = materialize(whole, "numbered")
        held = whole.select("row_", F.explode("c").alias("c")).join(differing, F.struct("c.k1", "c.k2") == F.col("k")).groupBy("row_").agg(F.collect_set("k").alias("not_"))
        whole = whole.join(held, "row_", "left")
        gone = F.filter(later, lambda x: ~F.coalesce(F.array_contains("not_", F.struct(x["k1"], x["k2"])), F.lit(False)))
    whole = whole.select("doc_", F.col("doc_.text").alias("text_"), F.split("doc_.text", "\n", -1).alias("lines_"), F.coalesce(gone, F.array().cast(whole.schema["c"].dataType)).alias("gone_"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines_") - 1), F.flatten(F.transform("gone_", lambda g: F.sequence(g["start"], g["start"] + g["len"] - 1))))
    kept = F.array_join(F.transform(numbers, lambda i: F.get("lines_", i)), "\n")
    count = F.when(F.col("text_").isNull(), F.lit(0)).otherwise(F.size("lines_")).cast("long")
    lost = F.aggregate("gone_", F.lit(0).cast("long"), lambda a, g: a + g["len"])
    others = [F.col(f"doc_.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed", "kept")]
    return whole.select(*others, count.alias("n_lines"), lost.alias("n_removed"), F.when(F.size("gone_") == 0, F.col("text_")).otherwise(kept).alias("kept"))


#: The same in DuckDB's SQL.
ORACLE_SQL = """
WITH lines AS (
  SELECT DISTINCT doc_id, text, unnest(range(len(l))) AS i, unnest(l) AS line
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines
), ended AS (
  SELECT *, h <> after_ AND (h <> before_ AND (h * 31 + before_) % 65521 % 4 = 0
    OR full_line AND h = before_ OR full_after AND after_ = second_) AS stop
  FROM (
    SELECT *, coalesce(lag(h) OVER w, -1) AS before_, coalesce(lead(h) OVER w, -1) AS after_, coalesce(lead(h, 2) OVER w, -1) AS second_,
      trim(line, ' ') <> '' AS full_line, coalesce(trim(lead(line) OVER w, ' ') <> '', false) AS full_after
    FROM hashed WINDOW w AS (PARTITION BY doc_id, text ORDER BY i))
), numbered AS (
  SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ended
), chunks AS (
  SELECT doc_id, text, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t,
    count(*) FILTER (trim(line, ' ') <> '') AS full_ FROM numbered GROUP BY ALL
), judged AS (
  SELECT *, full_ >= 2 AND row_number() OVER (PARTITION BY t, full_ >= 2 ORDER BY doc_id NULLS LAST, no) > 1 AS gone FROM chunks
), kept AS (
  SELECT doc_id, text, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
    sha256(coalesce(string_agg(t, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
  FROM judged GROUP BY doc_id, text
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  coalesce(k.kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text
"""
