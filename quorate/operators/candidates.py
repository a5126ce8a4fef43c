"""Candidate relations: grouping, exploding, validating, filtering and joining."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.functions import text as tx


def grouped(flat: DataFrame, order: str, dedupe: bool = False, max_problems: int = 0, check_reference: bool = False) -> DataFrame:
    """Flat rows -> (problem_id, candidates, labels), in row order, optionally the first of equal texts only.

    max_problems keeps the problems that appear first.  With check_reference, differing references in a problem are an error.
    """
    rows = flat
    if dedupe:
        w = Window.partitionBy("problem_id", "candidate").orderBy(order)
        rows = rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    item = F.struct(F.col(order).alias("o"), F.col("candidate").alias("c"), F.col("label").alias("l"))
    aggs = [F.array_sort(F.collect_list(item)).alias("items"), F.min(order).alias("first_row")]
    if check_reference:
        aggs.append(F.assert_true(F.count_distinct("reference") <= 1, "references differ in a problem").alias("__ok"))
    out = rows.groupBy("problem_id").agg(*aggs)
    if max_problems:
        # a top-n over one row per problem
        out = out.orderBy("first_row").limit(max_problems)
    return out.select("problem_id", F.col("items.c").alias("candidates"), F.col("items.l").alias("labels"))


def with_reference_length(flat: DataFrame, order: str) -> DataFrame:
    """(problem_id, ref_len_chars): characters of the normalised reference of each problem's first row."""
    first = F.min_by(F.coalesce("reference", F.lit("")), order)
    return flat.groupBy("problem_id").agg(first.alias("r")).select("problem_id", F.length(tx.normalize(F.col("r"))).alias("ref_len_chars"))


def first_statement(flat: DataFrame, order: str, nl: str = "nl") -> DataFrame:
    """(problem_id, nl): the first non-empty statement; problems without one are left out."""
    ok = F.trim(F.coalesce(F.col(nl), F.lit(""))) != ""
    return flat.filter(ok).groupBy("problem_id").agg(F.min_by(nl, order).alias("nl"))


def long_form(groups: DataFrame, *arrays: str) -> DataFrame:
    """(problem_id, candidate_index, one column per array, singular)."""
    names = {a: a.removesuffix("s") if a != "typechecks" else a for a in arrays}
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return groups.select("problem_id", F.posexplode(zipped).alias("candidate_index", "z")).select("problem_id", "candidate_index", *[F.col(f"z.{a}").alias(n) for a, n in names.items()])


def majority(cands: DataFrame, text_col: str = "candidate") -> DataFrame:
    """(problem_id, candidate_index): the most frequent normalised text, of equals the shorter, then the earlier."""
    norm = cands.select("problem_id", "candidate_index", tx.normalize(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    g = norm.groupBy("problem_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_index").alias("first"))
    return g.groupBy("problem_id").agg(F.max_by("first", F.struct("n", -F.length("norm"), -F.col("first"))).alias("candidate_index"))


def violations(groups: DataFrame, require_labels: bool = True) -> DataFrame:
    """(problem_id, problems): what is wrong with each grouped row; rows without faults are left out."""
    c, l = F.col("candidates"), F.col("labels")
    pid = F.col("problem_id")
    checks = {
        "problem_id missing": pid.isNull(),
        "problem_id empty": pid.isNotNull() & (pid.cast("string") == ""),
        "candidates missing": c.isNull(),
        "candidate is null": F.exists(F.coalesce(c, F.array()), lambda x: x.isNull()),
        "labels missing": l.isNull() if require_labels else F.lit(False),
        "label is null": F.exists(F.coalesce(l, F.array()), lambda x: x.isNull()),
        "label not 0 or 1": F.exists(F.coalesce(l, F.array()), lambda x: ~x.isin(0, 1)),
        "lengths differ": c.isNotNull() & l.isNotNull() & (F.size(c) != F.size(l)),
    }
    faults = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()]), lambda x: x.isNotNull())
    return groups.select("problem_id", faults.alias("problems")).filter(F.size("problems") > 0)


def raw_violations(lines: DataFrame, value: str = "value", require_labels: bool = False) -> DataFrame:
    """(value, problem) of JSON lines: the first of the eleven things that can be wrong with a grouped object; lines without faults are left out.

    Types are read off the JSON text itself, which a schema would have coerced: candidates must be strings, labels integers or booleans.
    """
    v = F.parse_json(F.when(F.try_parse_json(value).isNull(), F.lit("null")).otherwise(F.col(value)))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    missing = lambda path: F.try_variant_get(v, path, "variant").isNull()
    is_array = lambda path: F.coalesce(kind(path).startswith("ARRAY"), F.lit(False))
    items = lambda path: F.coalesce(F.when(is_array(path), F.try_variant_get(v, path, "array<variant>")), F.array().cast("array<variant>"))
    of = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    c, l = items("$.candidates"), items("$.labels")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    fault = (
        F.when(~is_object, "not an object").when(missing("$.problem_id"), "problem_id missing").when(kind("$.problem_id") == "VOID", "problem_id is null").when(F.try_variant_get(v, "$.problem_id", "string") == "", "problem_id empty")
        .when(~is_array("$.candidates"), "candidates are no list").when(F.exists(c, lambda x: of(x) != "STRING"), "candidate is no string")
        .when((missing("$.labels") | (kind("$.labels") == "VOID")) & F.lit(require_labels), "labels missing").when(missing("$.labels") | (kind("$.labels") == "VOID"), F.lit(None)).when(~is_array("$.labels"), "labels are no list")
        .when(F.size(l) != F.size(c), "lengths differ").when(F.exists(l, lambda x: ~of(x).isin("BIGINT", "BOOLEAN")), "label is no integer").when(F.exists(l, lambda x: (of(x) == "BIGINT") & ~F.coalesce(F.try_variant_get(x, "$", "bigint").isin(0, 1), F.lit(False))), "label not 0 or 1"))
    return lines.select(value, fault.alias("problem")).filter("problem is not null")


def require_valid(groups: DataFrame, require_labels: bool = True) -> DataFrame:
    bad = violations(groups, require_labels).limit(1).collect()
    if bad:
        raise ValueError(f"problem {bad[0]['problem_id']}: {', '.join(bad[0]['problems'])}")
    return groups


def drop_blank(cands: DataFrame, text_col: str = "candidate") -> DataFrame:
    return cands.filter(tx.squeeze(F.coalesce(F.col(text_col), F.lit(""))) != "")


def by_ids(df: DataFrame, ids: DataFrame, invert: bool = False) -> DataFrame:
    return df.join(ids.select("problem_id").distinct(), "problem_id", "left_anti" if invert else "left_semi")


def first_problems(df: DataFrame, order: str, n: int) -> DataFrame:
    """The rows of the n problems that appear first."""
    first = df.groupBy("problem_id").agg(F.min(order).alias("o")).orderBy("o", "problem_id").limit(n).select("problem_id")
    return df.join(first, "problem_id", "left_semi")


def typecheck_mask(cands: DataFrame) -> DataFrame:
    """Survivors of each problem, or all its rows, flagged, where none survives."""
    any_tc = cands.groupBy("problem_id").agg(F.max(F.coalesce("typechecks", F.lit(False))).alias("__any"))
    return cands.join(any_tc, "problem_id").filter(F.coalesce("typechecks", F.lit(False)) | ~F.col("__any")).withColumn("no_typecheck_survivors", ~F.col("__any")).drop("__any")


def is_abstention() -> Column:
    """abstained is true or accepted is false; both true is an error."""
    both = F.col("accepted").eqNullSafe(True) & F.col("abstained").eqNullSafe(True)
    return F.when(both, F.raise_error(F.lit("accepted and abstained are both true")).cast("boolean")).otherwise(F.col("abstained").eqNullSafe(True) | F.col("accepted").eqNullSafe(False))


def index_guard(index: Column, n: Column) -> Column:
    return F.when((index < 0) | (index >= n), F.raise_error(F.concat(F.lit("index out of range: "), index.cast("string"))).cast("int")).otherwise(index)


def disjoint_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of selections and abstentions; a shared problem is an error."""
    if not a.join(b.select("problem_id"), "problem_id", "left_semi").isEmpty():
        raise ValueError("a problem is in both relations")
    return a.unionByName(b, allowMissingColumns=True)


def common_to_all(long: DataFrame, k: int) -> DataFrame:
    """(problem_id): problems that every one of k methods has."""
    return long.groupBy("problem_id").agg(F.count_distinct("method").alias("n")).filter(F.col("n") == k).select("problem_id")


def first_match(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    """(problem_id, candidate_index): the first candidate whose text equals the chosen text; null if none does."""
    hit = pool.join(chosen.select("problem_id", F.col("chosen").alias("candidate")), ["problem_id", "candidate"]).groupBy("problem_id").agg(F.min("candidate_index").alias("candidate_index"))
    return chosen.select("problem_id").join(hit, "problem_id", "left")


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """Inner join on problem_id in which over's non-null fields win."""
    shared = [c for c in base.columns if c in over.columns and c != "problem_id"]
    b = base.select("problem_id", *[F.col(c).alias(f"__b_{c}") if c in shared else F.col(c) for c in base.columns if c != "problem_id"])
    j = b.join(over, "problem_id")
    return j.select("problem_id", *[F.coalesce(F.col(c), F.col(f"__b_{c}")).alias(c) for c in shared], *[c for c in base.columns if c not in shared and c != "problem_id"], *[c for c in over.columns if c not in shared and c != "problem_id"])


def lookup_first(df: DataFrame, key: str, order: str, value: str, keep_last: bool = False) -> DataFrame:
    """One value per key: the first row's, or the last's; null counts as an empty text."""
    v = F.coalesce(F.col(value), F.lit(""))
    return df.groupBy(key).agg((F.max_by if keep_last else F.min_by)(v, order).alias(value))


def with_labels01(df: DataFrame) -> DataFrame:
    return df.withColumn("label", st.lax_label(F.col("label")))
