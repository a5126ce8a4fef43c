"""Domain relations over the driver's tables, for Spark and, as SQL text, for DuckDB."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Small statements in a formal language, which the tables' prose lacks.
STATEMENTS = [
    (-1, "theorem t1 : 1 = 1 := rfl"),
    (-2, "lemma foo.bar' (x : Nat) -- c\n : x = x := by simp"),
    (-3, "example (a b : ℤ) : a = b where"),
    (-4, "theorem t (n : Nat := 0) : n = n"),
    (-5, "P nowhere Q"),
    (-6, "/- doc -/ theorem z : True"),
    (-7, "(x y : Nat) (h : Prop) (hp : p x) : x = y → ∀ z, z ∧ w"),
    (-8, "(f : ℝ → ℝ) (hf : Continuous.on f) : ∃ c, f c = 0 ∨ c -> c"),
    (-9, "  DEF  f.g'1   : Nat :=\n 3 /- a\nb -/ -- tail"),
    (-10, "text\n```lean\ntheorem a : b = c := by\n  rfl\n```\nmore"),
    (-11, ""),
    (-12, "-- only a comment"),
]


def statements(spark, sf_dir):
    lit = spark.createDataFrame(STATEMENTS, "sid long, text string")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), "text").unionByName(lit)


def line_candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    hit = (F.col("l_returnflag") == "R").cast("int")
    return li.select(
        F.col("l_orderkey").alias("problem_id"), (F.row_number().over(w) - 1).alias("candidate_index"), hit.alias("label"), (F.col("l_linestatus") == "F").alias("typechecks"),
        ((3 * F.round(F.col("l_discount") * 100).cast("long") - F.col("l_quantity").cast("long") + 6 * hit) / F.lit(8.0)).alias("score_a"),
        ((5 * F.round(F.col("l_tax") * 100).cast("long") - F.col("l_linenumber")) / F.lit(4.0)).alias("score_b"), F.col("l_partkey").alias("part"))


def scored_lines(spark, sf_dir, score="score_a"):
    return line_candidates(spark, sf_dir).withColumn("score", F.col(score))


def conv_candidates(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("problem_id"), (F.row_number().over(w) - 1).alias("candidate_index"), F.col("text").alias("candidate"), (F.col("role") == "assistant").cast("int").alias("label"), F.col("turn").alias("row_no"))


def vec_candidates(spark, sf_dir):
    """A problem is a label within 500 vectors, so that problems grow in number with the data and not in size."""
    w = Window.partitionBy("problem_id").orderBy("vec_id")
    vectors = table(spark, sf_dir, "embeddings").withColumn("problem_id", F.col("label") + 1000 * F.expr("vec_id div 500"))
    return vectors.select("problem_id", (F.row_number().over(w) - 1).alias("candidate_index"), "embedding", (F.col("vec_id") % 3 == 0).cast("int").alias("label"), F.col("vec_id"))


#: Documents of a problem that are numbered in one place, about.
DOC_BLOCK = 1000


def doc_candidates(spark, sf_dir, candidate=None):
    """A problem is a source in a language. Blocks of a problem are counted first, so that only a block's own documents are numbered in one place.
    ``candidate``, the text if None, is what is made of a text where it is read; joins and numbering move that alone."""
    candidate = F.col("text") if candidate is None else candidate
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", candidate.alias("candidate"))
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    block = F.coalesce(F.expr(f"doc_id div {DOC_BLOCK}"), F.lit((1 << 63) - 1))
    d = d.select(F.concat_ws("|", "lang", "source").alias("problem_id"), block.alias("block"), "doc_id", "candidate", "quality")
    at = ["problem_id", "block"]
    # one row for each block
    before = F.sum("n").over(Window.partitionBy("problem_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = d.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).select(*at, F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy("doc_id"))
    return d.withColumn("inside", inside).join(blocks, at).select("problem_id", (F.col("before") + F.col("inside") - 1).cast("int").alias("candidate_index"), "candidate", F.coalesce("quality", F.lit(0)).alias("label"), F.col("doc_id").alias("row_no"))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = {
    "statements": "statements AS (SELECT doc_id AS sid, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quote(t)})" for i, t in STATEMENTS) + ") v(sid, text))",
    "line": """lc AS (SELECT l_orderkey AS problem_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INTEGER AS candidate_index,
  (l_returnflag = 'R')::INTEGER AS label, l_linestatus = 'F' AS typechecks,
  (3 * round(l_discount * 100)::BIGINT - l_quantity::BIGINT + 6 * (l_returnflag = 'R')::INTEGER) / 8::DOUBLE AS score_a,
  (5 * round(l_tax * 100)::BIGINT - l_linenumber) / 4::DOUBLE AS score_b, l_partkey AS part FROM lineitem)""",
    "conv": """cc AS (SELECT conv_id AS problem_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS candidate_index, text AS candidate, (role = 'assistant')::INTEGER AS label, turn AS row_no FROM conversations)""",
    "vec": """vc AS (SELECT label + 1000 * (vec_id // 500) AS problem_id, (row_number() OVER (PARTITION BY label, vec_id // 500 ORDER BY vec_id) - 1)::INTEGER AS candidate_index, list_transform(embedding, lambda x: x::DOUBLE) AS embedding, (vec_id % 3 = 0)::INTEGER AS label, vec_id FROM embeddings)""",
    "doc": """dc AS (SELECT lang || '|' || source AS problem_id, (row_number() OVER (PARTITION BY lang, source ORDER BY d.doc_id) - 1)::INTEGER AS candidate_index, text AS candidate, coalesce(quality, 0) AS label, d.doc_id AS row_no FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id)""",
}


# SQL text of scalar operators, as functions of an SQL expression


def sql_comments(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '(?m)--.*?$', '', 'g'), '(?s)/-.*?-/', '', 'g')"


def sql_proof(e: str) -> str:
    return f"(CASE WHEN strpos({e}, ':=') > 0 THEN left({e}, strpos({e}, ':=') - 1) WHEN strpos({e}, 'where') > 0 THEN left({e}, strpos({e}, 'where') - 1) ELSE {e} END)"


_DECL = r"(?i)^\s*(theorem|lemma|example|def|axiom|structure|instance)\s+"


def sql_header(e: str) -> str:
    return f"(CASE WHEN regexp_matches({e}, '{_DECL}') THEN regexp_replace(regexp_replace({e}, '{_DECL}', ''), '^[A-Za-z_][A-Za-z0-9_''.]*\\s*', '') ELSE {e} END)"


def sql_squeeze(e: str) -> str:
    return f"trim(regexp_replace(replace({e}, chr(160), ' '), '\\s+', ' ', 'g'))"


def sql_steps(source: str, cols: str, expr: str = "text") -> str:
    """CTEs s1..s4 that normalise step by step; s4.norm is the normal form."""
    return (f"s1 AS (SELECT {cols}, {sql_comments(expr)} AS t FROM {source}), s2 AS (SELECT {cols}, {sql_proof('t')} AS t FROM s1), s3 AS (SELECT {cols}, {sql_header('t')} AS t FROM s2), "
            f"s4 AS (SELECT {cols}, {sql_squeeze('t')} AS norm FROM s3)")


SQL_TOKEN = "[A-Za-z_][A-Za-z0-9_''.]*|[0-9]+|[^\\s]"


def sql_features(e: str) -> str:
    n = lambda m: f"((length({e}) - length(replace({e}, '{m}', ''))) / {len(m)})::INTEGER"
    b = f"regexp_extract_all({e}, '\\([^)]*:[^)]*\\)')"
    return (f"length({e})::INTEGER AS n_chars, len({b})::INTEGER AS n_binders, ({n('→')} + {n('->')})::INTEGER AS n_arrows, {n('∀')} AS n_forall, {n('∃')} AS n_exists, {n('∧')} AS n_and, {n('∨')} AS n_or, {n('=')} AS n_eq, "
            f"len(list_filter({b}, lambda b: contains(b, ': Prop') OR (regexp_matches(b, ':\\s*[a-z]') AND NOT contains(b, '.'))))::INTEGER AS n_prop")


def sql_wilson(k: str, n: str, end: str) -> str:
    z = "1.959963984540054::DOUBLE"
    p = f"({k} / nullif({n}, 0)::DOUBLE)"
    mid = f"(({p} + {z}*{z}/(2*{n})) / (1 + {z}*{z}/{n}))"
    half = f"({z} * sqrt({p}*(1-{p})/{n} + {z}*{z}/(4*{n}::DOUBLE*{n})) / (1 + {z}*{z}/{n}))"
    return f"(CASE WHEN {n} > 0 THEN greatest(0.0, {mid} - {half}) ELSE 0.0 END)" if end == "low" else f"(CASE WHEN {n} > 0 THEN least(1.0, {mid} + {half}) ELSE 0.0 END)"


def sql_rate(k: str, n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN ({k}) / ({n})::DOUBLE ELSE 0.0 END)"


def sql_sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def sql_sign_test(a: str, b: str) -> str:
    n, k = f"({a} + {b})", f"least({a}, {b})"
    return (f"(CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) - {n} * ln(2.0::DOUBLE))))) END)")
