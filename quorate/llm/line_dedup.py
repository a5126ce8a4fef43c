"""Cross-site line de-duplication (operator 7).

A line that appears on many distinct sites (``source``) is boilerplate, however short it is, if it has a word in it.  A HyperLogLog sketch of
sites per line hash is aggregated, map-side first; lines whose estimate is near the threshold get an exact distinct count; then boilerplate
lines are removed everywhere but in the document with the smallest doc_id that has them, so that a text copied to many sites is not lost
with all its copies.  A line that very many documents have is dealt into parts by its counted number of rows wherever they meet its row.

Defined cases: null texts stay null with n_lines 0; empty texts are one empty line; blank lines are never boilerplate;
null sources count as no site; rows with a null doc_id lose boilerplate lines unless only such rows have them; repeated rows are cleaned
alike, wherever they are; an empty table gives an empty result; of other columns those asked for are kept, and others, whatever their names,
are not read.  Texts may be of any length and have any number of lines: each is split once, and the lines to keep are picked by their place.
Rows are dealt by their place in ``docs``, which should be a table that was written.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, hot_keys, hot_limit, materialize, path_of, read_back

MIN_SITES = 5
#: Estimates within this share of the threshold, and within one of it, are counted exactly; the sketch's standard error is 1.6 percent.
NEAR = 0.1
SKETCH_BITS = 12
#: What separates words.
BLANKS = " \t\n\x0b\x0c\r"
#: Lines whose sketches a task holds before it sorts.
SKETCHES_HELD = 50_000


def _own_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the same settings but for the number of sketches that are held; the caller's stays as it is."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(SKETCHES_HELD))
    return own


def boilerplate_lines(lines: DataFrame, min_sites: int) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, first): the lines on at least min_sites sites, and the smallest doc_id that has each; and the hot lines, boilerplate or not, with
    their parts. ``lines``, made by materialize(), has h1, h2, source, doc_id."""
    spark, key, n_rows = lines.sparkSession, ["h1", "h2"], lines.count()
    own, least = read_back(_own_session(spark), path_of(lines), lines.schema), min(min_sites * (1 - NEAR), min_sites - 1)
    sketched = materialize(
        own.groupBy("h1", "h2").agg(F.hll_sketch_agg("source", SKETCH_BITS).alias("sketch"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .select("h1", "h2", "first", "n", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter((F.col("sites") >= least) | (F.col("n") > hot_limit(n_rows))), "line-sites")
    sketched = read_back(spark, path_of(sketched), sketched.schema)
    hot = hot_keys(sketched, key, "n", n_rows)
    sure = F.col("sites") > max(min_sites * (1 + NEAR), min_sites + 1)
    near = sketched.filter(~sure & (F.col("sites") >= least))
    exact = (dealt_join(lines.select(*key, "source"), near.select(*key), key, hot).filter("source is not null").distinct()
             .groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_sites).select(*key))
    return sketched.filter(sure).select(*key, "first").unionByName(near.select(*key, "first").join(exact, key, "left_semi")), hot


def dedup_lines(docs: DataFrame, *, min_sites: int = MIN_SITES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Operator 7: doc_id, n_lines, n_removed, text (cleaned), and the columns of ``keep`` unchanged."""
    others = tuple(c for c in keep if c not in ("doc_id", "text"))
    me = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("__q_d"), F.col("doc_id").isNull().alias("__q_z"), F.xxhash64("text").alias("__q_t")]
    own = ["__q_d", "__q_z", "__q_t"]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others).select("doc_id", "text", *others, *me)
    # with a limit of -1 nothing is left off at the end
    split = F.split("text", "\n", -1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    # a text is hashed below the explode, not once for each of its lines
    rows = texts.select("doc_id", "source", "text", me[2]).select("doc_id", "source", "__q_t", F.posexplode(split).alias("pos", "line"))
    worded = F.btrim("line", F.lit(BLANKS)) != ""
    lines = materialize(rows.filter(worded).select("doc_id", "source", "__q_t", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")), "lines")
    bad, hot = boilerplate_lines(lines, min_sites)
    hit = (dealt_join(lines, materialize(bad, "boilerplate"), ["h1", "h2"], hot).filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select(*me[:2], "__q_t", "pos")
           .groupBy(*own).agg(F.collect_set("pos").alias("__q_out")))
    n_docs = docs.count()
    same = base.groupBy(*own).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot_limit(n_docs))
    out = dealt_join(base, hit, own, materialize(hot_keys(same, own, "c", n_docs), "same-texts"), "left")
    # each text is split once, and bound to a name in which lines are looked up by place
    picked = F.transform(F.array(split), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__q_out")), lambda i: F.get(parts, i)), "\n"))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.coalesce(F.size("__q_out"), F.lit(0)).cast("long").alias("n_removed"),
                      F.when(F.col("__q_out").isNull(), F.col("text")).otherwise(F.get(picked, F.lit(0))).alias("text"), *others)


ORACLE = rf"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT rid, doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM base),
bad AS (SELECT line, min(doc_id) AS first FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
hit AS (SELECT rid, list(pos) AS gone FROM lines JOIN bad USING (line) WHERE doc_id IS DISTINCT FROM first GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(parts) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(parts, lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text
FROM base LEFT JOIN hit USING (rid)
"""
