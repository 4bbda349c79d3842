"""The registered query of every llm operator, over its whole table."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnscore.llm import decontam, fmindex, jaccard, mix, neighbours, quality, ranking, runs, secrets, shards, suffixes, urls, warc
from txnscore.llm.shared import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(run: Query) -> Query:
    @functools.wraps(run)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return shipped


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# The rules of the registered query: fixed values.
URL_RULES = [
    urls.Rule("com", "/", urls.ALLOW),
    urls.Rule("example.com", "/en/", urls.BLOCK),
    urls.Rule("www.example.com", "/en/", urls.ALLOW),
    urls.Rule("net", "/es/", urls.BLOCK),
    urls.Rule("net", "/fr/", urls.BLOCK),
]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup_bytes(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.dedup_words(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op6_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.link(_table(spark, sf_dir, "embeddings"))


def _joined(spans) -> Column:
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(text, ",")


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def repeated(doc_id: int | None, text: bytes) -> bytes:
    """The words of every tenth document, by the CRC-32 of its id, run in a circle from one of them on."""
    place = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    words = text.split()
    if doc_id is None or place % 10 or not words:
        return text
    n, g = len(words), place // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    rounds = -(-(n - first) // period)
    return b" ".join(words[:first] + (words[first : first + period] * rounds)[: n - first])


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(_table(spark, sf_dir, "documents"), before=repeated)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # Lengths over periods, compared as whole numbers; runs stand by start, then period.
    longer = F.aggregate("runs", none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", longer).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.assign(_table(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


# The CRC-32 by its definition: the remainders of all bytes, then a fold over the text's.
ORACLES["op12_shards"] = """
WITH bits AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b)),
remainders AS (SELECT list(v ORDER BY b) AS t FROM bits),
bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
crcs AS (
  SELECT doc_id, len(b) + 1 AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32
  FROM bytes, remainders),
placed AS (
  SELECT doc_id, size, text_crc32, least(15, ((2 * (sum(size) OVER (ORDER BY doc_id) - size) + size) * 16) // (2 * sum(size) OVER ())) AS shard
  FROM crcs)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed"""


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranking.build(_table(spark, sf_dir, "documents"))
    return ranking.search(index, _table(spark, sf_dir, "benchmark"), k=50)


_TERMS = f"regexp_extract_all(translate(text, '{ranking.UPPER}', '{ranking.LOWER}'), '{ranking.TERM_PATTERN}')"
ORACLES["op13_ranked_search"] = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
uses AS (SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY 1, 2),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM uses, totals GROUP BY 1),
gains AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)) AS gain FROM uses JOIN sizes USING (doc_id), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * gain) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN gains USING (term) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""
