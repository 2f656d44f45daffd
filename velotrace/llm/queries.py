"""Queries of problems 6 to 10 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velotrace.llm.bpe import count_tokens, decode, encode
from velotrace.llm.digests import build, certified, estimates, merge
from velotrace.llm.mixing import mix
from velotrace.llm.runs import overtake_runs, reading_runs
from velotrace.llm.splitting import split, split_documents
from velotrace.sources.tables import READINGS, table

Query = Callable[[SparkSession, str], DataFrame]
SHARES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
#: Clusters of a fine digest.
FINE = 60_000
#: Rank error that every percentile must keep.
BOUND = 0.01
#: Distance of a source's share of tokens from its target.
SHARE_BOUND = 0.005
#: Tokens that a piece repeats at most: 50, and a few as a text that begins elsewhere is divided otherwise.
OVERLAP_BOUND = 54


def clearances(spark: SparkSession, d: str) -> DataFrame:
    """Events once each (copies differ in loaded_at only), with their day."""
    e = table(spark, d, "matched_events").select("event_uid", "edge_class", "min_clearance_cm", "start").distinct()
    return e.withColumn("day", F.to_date("start").cast("string"))


def _percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = clearances(spark, d)
    by_day = build(rows, "min_clearance_cm", ["edge_class", "day"])
    whole = F.to_json(F.from_json("digest_key", "edge_class string, day string").dropFields("day"), {"ignoreNullFields": "false"})
    return certified(rows, "min_clearance_cm", ["edge_class"], estimates(merge(by_day, whole), SHARES), SHARES)


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Digests per class and day, merged to classes."""
    return _percentiles(spark, d)


def p6_certified(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile keeps the bound on its rank error."""
    return _percentiles(spark, d).select("edge_class", "p", "n", (F.col("rank_error") <= BOUND).alias("within_bound"))


def p6_fine(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from digests so fine that values of a class stay alone, up to about a third of FINE of them: exact order statistics."""
    rows = clearances(spark, d)
    by_day = build(rows, "min_clearance_cm", ["edge_class", "day"], FINE)
    whole = F.to_json(F.from_json("digest_key", "edge_class string, day string").dropFields("day"), {"ignoreNullFields": "false"})
    r = certified(rows, "min_clearance_cm", ["edge_class"], estimates(merge(by_day, whole, FINE), SHARES), SHARES)
    return r.select("edge_class", "p", "n", "estimate")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    readings = reading_runs(table(spark, d, READINGS)).withColumn("kind", F.lit("reading"))
    overtakes = overtake_runs(table(spark, d, "overtake_events")).withColumn("kind", F.lit("overtake"))
    return readings.unionByName(overtakes).select("kind", F.col("entity").alias("seq_id"), "start_us", "end_us")


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    readings = reading_runs(table(spark, d, READINGS)).withColumn("kind", F.lit("reading"))
    overtakes = overtake_runs(table(spark, d, "overtake_events")).withColumn("kind", F.lit("overtake"))
    return readings.unionByName(overtakes).select("kind", F.col("entity").alias("seq_id"), "start_us", "end_us", "n", "duration_us")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(table(spark, d, "documents"), "doc_id")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again from their ids: a round trip over all documents."""
    return decode(encode(table(spark, d, "documents")))


def p8_agree(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source: how many there are, how many have no ids, and of how many the count of tokens is the number of ids."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    ids = encode(docs).select("doc_id", F.size("ids").alias("n_ids"))
    both = count_tokens(docs, "doc_id", "source").join(ids, "doc_id")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("n_ids") == 0).alias("n_empty"), F.count_if(F.col("n_ids") == F.col("n_tokens")).alias("n_equal"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per source with a target: its share among the sources that have documents, whether the mix keeps it, and copies over the cap.

    A source is filled to the nearest document, so it may miss its tokens by half its longest one, and the mix by half the longest of each source. A
    share is kept if it is off by no more than that, and SHARE_BOUND.
    """
    docs = table(spark, d, "documents")
    s = mix(docs, table(spark, d, "mix_targets"))[1]
    longest = count_tokens(docs, "source").groupBy("source").agg(F.max("n_tokens").alias("longest"))
    s = s.join(longest, "source", "left")
    here, everything = F.col("n_tokens_available") > 0, Window.partitionBy()  # one row per target
    wanted = F.when(here, F.col("target_share") / F.sum(F.when(here, F.col("target_share"))).over(everything)).otherwise(F.lit(0.0))
    half = F.coalesce(F.col("longest"), F.lit(0)) / 2
    bound = SHARE_BOUND + (half + wanted * F.sum(half).over(everything)) / F.sum("n_tokens_used").over(everything)
    return s.select("source", F.round(wanted, 9).alias("wanted_share"), (F.abs(F.col("actual_share") - wanted) <= bound).alias("share_kept"), F.greatest(F.col("most_copies") - F.col("max_repeats"), F.lit(0)).alias("copies_over"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split(table(spark, d, "documents"))


def p10_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per document: bytes that its pieces cover without gap, gaps, pieces over 1,000 tokens by a count of their own, and overlaps of more than OVERLAP_BOUND tokens."""
    p = split(table(spark, d, "documents"))
    whole = Window.partitionBy("doc_id").orderBy("piece")
    before = F.lag("end_byte").over(whole)
    gap = F.coalesce(F.col("start_byte") > before, F.col("start_byte") != 0)
    p = p.withColumn("gap", gap.cast("int")).withColumn("lap", F.substring(F.col("piece_text").cast("binary"), F.lit(1), F.greatest(before - F.col("start_byte"), F.lit(0))).cast("string"))
    counted = count_tokens(p.select("doc_id", "end_byte", "gap", "lap", F.col("piece_text").alias("text")), "doc_id", "end_byte", "gap", "lap").withColumnsRenamed({"n_tokens": "size", "lap": "text"})
    laps = count_tokens(counted, "doc_id", "end_byte", "gap", "size")
    return laps.groupBy("doc_id").agg(
        F.max("end_byte").cast("long").alias("covered_bytes"), F.sum("gap").alias("n_gaps"), F.count_if(F.col("size") > 1000).alias("n_over_limit"), F.count_if(F.col("n_tokens") > OVERLAP_BOUND).alias("n_long_overlaps"),
    )


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p6_percentiles, p6_certified, p6_fine, p7_found, p7_runs, p8_ids, p8_counts, p8_decoded, p8_agree, p9_mix, p9_shares, p9_kept, p10_found, p10_pieces, p10_checked)}


_EVENTS = 'WITH e AS (SELECT DISTINCT event_uid, edge_class, min_clearance_cm, "start" FROM matched_events)'

_RUNS = """
WITH one AS (
  SELECT boxId, epoch_us(createdAt) AS t, TRY_CAST(value AS DOUBLE) AS v,
    row_number() OVER (PARTITION BY boxId, createdAt ORDER BY row_seq) AS n
  FROM opensensemap_overtaking_distances
  WHERE lat IS NOT NULL AND lon IS NOT NULL AND createdAt IS NOT NULL AND boxId IS NOT NULL),
gaps AS (SELECT boxId, t, v, CASE WHEN t - lag(t) OVER (PARTITION BY boxId ORDER BY t) <= 600000000 THEN 0 ELSE 1 END AS b FROM one WHERE n = 1),
ridden AS (SELECT *, sum(b) OVER (PARTITION BY boxId ORDER BY t) AS ride FROM gaps),
sized AS (SELECT *, count(*) OVER (PARTITION BY boxId, ride) AS size FROM ridden),
numbers AS (SELECT boxId, ride, t, v FROM sized WHERE size >= 5 AND v IS NOT NULL AND NOT isnan(v)),
linked AS (SELECT *, CASE WHEN v > 0 AND lag(v) OVER w > 0 AND abs(v - lag(v) OVER w) <= 3 AND t - lag(t) OVER w <= 3000000 THEN 0 ELSE 1 END AS s
  FROM numbers WINDOW w AS (PARTITION BY boxId, ride ORDER BY t)),
chained AS (SELECT *, sum(s) OVER (PARTITION BY boxId, ride ORDER BY t) AS run FROM linked),
ev AS (SELECT DISTINCT traj_id, epoch_us("start") AS t, event_id, epoch_us("end") AS e, n_samples AS v FROM overtake_events),
ev_linked AS (SELECT *, CASE WHEN v = lag(v) OVER w AND t - lag(e) OVER w <= 20000000 THEN 0 ELSE 1 END AS s FROM ev WINDOW w AS (PARTITION BY traj_id ORDER BY t, event_id)),
ev_chained AS (SELECT *, sum(s) OVER (PARTITION BY traj_id ORDER BY t, event_id) AS run FROM ev_linked),
found AS (
  SELECT 'reading' AS kind, boxId AS seq_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n FROM chained GROUP BY boxId, ride, run HAVING count(*) >= 3 AND min(v) > 0
  UNION ALL
  SELECT 'overtake', traj_id, min(t), arg_max(e, t), count(*) FROM ev_chained GROUP BY traj_id, run HAVING count(*) >= 2)
"""


def oracle_sql() -> dict[str, str]:
    shares = ", ".join(f"({p!r}::DOUBLE)" for p in SHARES)
    return {
        "p6_certified": f"{_EVENTS} SELECT edge_class, p, n, TRUE AS within_bound FROM (SELECT edge_class, count(*) AS n FROM e "
        f"WHERE min_clearance_cm IS NOT NULL AND isfinite(min_clearance_cm) GROUP BY edge_class) g, (VALUES {shares}) s(p)",
        "p6_fine": f"{_EVENTS}, g AS (SELECT edge_class, list_sort(list(min_clearance_cm)) AS v FROM e WHERE isfinite(min_clearance_cm) GROUP BY edge_class) "
        f"SELECT edge_class, p, len(v) AS n, v[greatest(ceil(p * len(v) - 1e-9), 1)::INT] AS estimate FROM g, (VALUES {shares}) s(p)",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_agree": "SELECT source, count(*) AS n_docs, count(*) FILTER (coalesce(text, '') = '') AS n_empty, count(*) AS n_equal FROM documents GROUP BY source",
        "p9_kept": "WITH h AS (SELECT DISTINCT source FROM documents WHERE text <> '') SELECT t.source, round(CASE WHEN h.source IS NULL THEN 0 ELSE target_share / (SELECT sum(target_share) FROM mix_targets SEMI JOIN h USING (source)) END, 9) AS wanted_share, "
        "TRUE AS share_kept, 0 AS copies_over FROM mix_targets t LEFT JOIN h USING (source)",
        "p10_checked": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS covered_bytes, 0 AS n_gaps, 0 AS n_over_limit, 0 AS n_long_overlaps FROM documents",
        "p7_found": _RUNS + "SELECT kind, seq_id, start_us, end_us FROM found",
        "p7_runs": _RUNS + "SELECT kind, seq_id, start_us, end_us, n, end_us - start_us AS duration_us FROM found",
    }
