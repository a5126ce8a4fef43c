"""queries() and oracle_sql() of the candidate-selection operators, keyed by operator id.

Every query reads whole tables.  Doubles are rounded to nine digits on both sides, as engines differ in the last bit.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.functions import text as tx
from quorate.operators import calibration as cal
from quorate.operators import candidates as ca
from quorate.operators import etl, graph, leaderboard
from quorate.operators import evaluation as ev
from quorate.operators import pairs as pr
from quorate.operators import selection as se
from quorate.operators import selective as sv
from quorate.plans import fixtures as fx
from quorate.sources import jsonl

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LINE, CONV, VEC, DOC, STMT = (fx.SQL[k] for k in ("line", "conv", "vec", "doc", "statements"))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def r9(df):
    """Doubles to nine digits."""
    return df.select(*[F.round(F.col(c), 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ids(x="problem_id, candidate_index"):
    return x


# --- scalar text -----------------------------------------------------------------------------------------------------------------


def _stmt(name, fn, sql_expr, cols="text"):
    query(name, f"WITH {STMT} SELECT sid, {sql_expr} AS result FROM statements")(lambda s, d: fx.statements(s, d).select("sid", fn(F.col("text")).alias("result")))


_stmt("OP-030_strip_comments", tx.strip_comments, fx.sql_comments("text"))
_stmt("OP-031_strip_proof", tx.strip_proof, fx.sql_proof("text"))
_stmt("OP-032_strip_header", tx.strip_header, fx.sql_header("text"))
_stmt("OP-033_squeeze", tx.squeeze, fx.sql_squeeze("text"))
_stmt("OP-044_shorten", lambda c: tx.shorten(c, 90), "CASE WHEN length(text) <= 90 THEN text ELSE left(text, 87) || '...' END")
_stmt("OP-045_unwrap_fence", tx.unwrap_fence, "CASE WHEN regexp_matches(text, '(?is)```(?:lean)?\\s*(.*?)```') THEN regexp_replace(regexp_extract(text, '(?is)```(?:lean)?\\s*(.*?)```', 1), '^\\s+|\\s+$', '', 'g') ELSE text END")
_stmt("OP-046_sanitize_ident", tx.sanitize_ident, "coalesce(nullif(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_]+|_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'x')".replace("regexp_replace(regexp_replace(text, '[^A-Za-z0-9_]+|_+', '_', 'g')", "regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_]+', '_', 'g'), '_+', '_', 'g')"))


@query("OP-034_normalize", f"WITH {STMT}, {fx.sql_steps('statements', 'sid')} SELECT sid, norm AS result FROM s4")
def _(s, d):
    return fx.statements(s, d).select("sid", tx.normalize(F.col("text")).alias("result"))


@query("OP-035_features", f"WITH {STMT} SELECT sid, {fx.sql_features('text')} FROM statements")
def _(s, d):
    return fx.statements(s, d).select("sid", *[v.alias(k) for k, v in tx.features(F.col("text")).items()])


@query("OP-036_prop_assumptions", f"WITH {STMT}, {fx.sql_steps('statements', 'sid')}, f AS (SELECT sid, {fx.sql_features('norm')} FROM s4) SELECT sid, n_prop FROM f")
def _(s, d):
    return fx.statements(s, d).select("sid", tx.features(tx.normalize(F.col("text")))["n_prop"].alias("n_prop"))


@query("OP-037_feature_prefix", f"""WITH {STMT}, f AS (SELECT sid, {fx.sql_features('text')} FROM statements)
SELECT sid, '[FEATS chars=' || n_chars || ' binders=' || n_binders || ' arrows=' || n_arrows || ' forall=' || n_forall || ' exists=' || n_exists || ' and=' || n_and || ' or=' || n_or || ' eq=' || n_eq || ' propAsm=' || n_prop || ']' AS prefix FROM f""")
def _(s, d):
    return fx.statements(s, d).select("sid", tx.feature_prefix(F.col("text")).alias("prefix"))


@query("OP-038_tokens", f"WITH {STMT} SELECT sid, len(regexp_extract_all(text, '{fx.SQL_TOKEN}'))::INTEGER AS n_tokens, array_to_string(regexp_extract_all(text, '{fx.SQL_TOKEN}'), ' ') AS tokens FROM statements")
def _(s, d):
    t = tx.tokens(F.col("text"))
    return fx.statements(s, d).select("sid", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


_GRAMS = f"""t AS (SELECT problem_id, candidate_index, regexp_extract_all(norm, '{fx.SQL_TOKEN}') AS toks FROM s4),
e AS (SELECT problem_id, candidate_index, n, toks, unnest(range(1, greatest(len(toks) - n + 2, 1))) AS i FROM t, (VALUES (1), (2), (3), (4)) v(n)),
g AS (SELECT problem_id, candidate_index, n, array_to_string(toks[i:i + n - 1], ' ') AS gram, count(*) AS c FROM e GROUP BY ALL)"""
_NORM_CONV = fx.sql_steps("cc", "problem_id, candidate_index", "coalesce(candidate, '')")


@query("OP-039_ngrams", f"WITH {CONV}, {_NORM_CONV}, {_GRAMS} SELECT problem_id, candidate_index, n::INTEGER AS \"order\", count(*) AS n_distinct, sum(c)::BIGINT AS total, max(c) AS most FROM g GROUP BY ALL")
def _(s, d):
    c = fx.conv_candidates(s, d).withColumn("toks", tx.tokens(tx.normalize(F.coalesce("candidate", F.lit("")))))
    return pr.gram_counts(c, "toks").groupBy("problem_id", "candidate_index", "order").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("total"), F.max("c").alias("most"))


_LABELS = [(1, "1"), (2, "true"), (3, " Yes "), (4, "CORRECT"), (5, "ok"), (6, "1.0"), (7, "0"), (8, "False"), (9, "wrong"), (10, "0.0"), (11, "2"), (12, "maybe"), (13, None)]
_LABEL_VALUES = ", ".join(f"({i}, {'NULL' if v is None else repr(v)})" for i, v in _LABELS)


@query("OP-040_labels", f"""WITH x AS (SELECT id, v, lower(trim(v)) AS s FROM (VALUES {_LABEL_VALUES}) t(id, v))
SELECT id, v, (CASE WHEN s IN ('1','true','yes','correct','ok') THEN 1 WHEN s IN ('0','false','no','incorrect','wrong') THEN 0 WHEN try_cast(s AS DOUBLE) = 1 THEN 1 WHEN try_cast(s AS DOUBLE) = 0 THEN 0 END)::INTEGER AS label FROM x""")
def _(s, d):
    return s.createDataFrame(_LABELS, "id int, v string").select("id", "v", st.lax_label(F.col("v")).alias("label"))


@query("OP-042_sigmoid", f"WITH {LINE} SELECT problem_id, candidate_index, round({fx.sql_sigmoid('score_a / 2.5')}, 9) AS p FROM lc")
def _(s, d):
    return r9(fx.line_candidates(s, d).select("problem_id", "candidate_index", st.sigmoid(F.col("score_a") / 2.5).alias("p")))


@query("OP-043_oriented", f"WITH {LINE} SELECT problem_id, candidate_index, -score_a AS o FROM lc")
def _(s, d):
    return fx.line_candidates(s, d).select("problem_id", "candidate_index", st.oriented(F.col("score_a"), True).alias("o"))


@query("OP-047_clean_candidates", f"""WITH {CONV}, u AS (SELECT problem_id, candidate_index, CASE WHEN regexp_matches(candidate, '(?is)```(?:lean)?\\s*(.*?)```') THEN regexp_extract(candidate, '(?is)```(?:lean)?\\s*(.*?)```', 1) ELSE coalesce(candidate, '') END AS text FROM cc),
{fx.sql_steps('u', 'problem_id, candidate_index')}
SELECT problem_id, candidate_index, 'theorem conv_' || problem_id || '_' || candidate_index || ' ' || (CASE WHEN left(norm, 1) IN ('(', '{{', '[', ':') THEN norm ELSE ': ' || norm END) || ' := by' || chr(10) || '  sorry' AS decl FROM s4 WHERE norm <> ''""")
def _(s, d):
    c = fx.conv_candidates(s, d)
    name = F.concat_ws("_", F.lit("conv"), tx.sanitize_ident(F.col("problem_id").cast("string")), F.col("candidate_index").cast("string"))
    return c.select("problem_id", "candidate_index", tx.sorry_decl(tx.signature(F.col("candidate")), name).alias("decl")).filter("decl <> ''")


@query("OP-048_penalty", f"WITH {STMT}, f AS (SELECT sid, {fx.sql_features('text')} FROM statements) SELECT sid, round(0.5 * (n_chars / 100.0::DOUBLE) + 2 * n_binders + 3 * n_prop, 9) AS penalty FROM f")
def _(s, d):
    return r9(fx.statements(s, d).select("sid", tx.penalty(F.col("text"), 0.5, 2.0, 3.0).alias("penalty")))


@query("OP-049_stable_index", f"WITH {LINE}, n AS (SELECT problem_id, count(*) AS n FROM lc GROUP BY 1) SELECT problem_id, (('0x' || left(sha256('7:' || problem_id), 15))::BIGINT % n)::INTEGER AS chosen_index FROM n")
def _(s, d):
    return se.random_choice(fx.line_candidates(s, d), 7)


@query("OP-050_float_tag", "SELECT id, replace(replace(v, '-', 'm'), '.', 'p') AS tag FROM (VALUES (1, '0.5'), (2, '-1.25'), (3, '3.0')) t(id, v)")
def _(s, d):
    return s.createDataFrame([(1, "0.5"), (2, "-1.25"), (3, "3.0")], "id int, v string").select("id", tx.float_tag(F.col("v")).alias("tag"))


# one byte of the text at a time, one bit of a byte at a time
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(problem_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295)"


@query("OP-051_crc_seed", f"WITH {CONV} SELECT problem_id, xor({_CRC}, 17) AS seed FROM (SELECT DISTINCT problem_id FROM cc)")
def _(s, d):
    return fx.conv_candidates(s, d).select("problem_id").distinct().select("problem_id", st.crc_seed(17, F.col("problem_id")).alias("seed"))


# --- validation and filters ------------------------------------------------------------------------------------------------------

_GROUPS = f"g AS (SELECT problem_id, list(candidate ORDER BY row_no) AS candidates, list(label ORDER BY row_no) AS labels, min(row_no) AS first_row FROM cc GROUP BY 1)"


def _groups(s, d):
    return ca.grouped(fx.conv_candidates(s, d), "row_no")


@query("OP-041_violations", f"""WITH {CONV}, {_GROUPS}, x AS (SELECT problem_id, candidates, CASE WHEN problem_id % 3 = 0 THEN NULL WHEN problem_id % 3 = 1 THEN list_append(labels, 2) ELSE labels END AS labels FROM g)
SELECT problem_id, CASE WHEN labels IS NULL THEN 'labels missing' ELSE 'label not 0 or 1,lengths differ' END AS problems FROM x WHERE labels IS NULL OR problem_id % 3 = 1""")
def _(s, d):
    m = F.col("problem_id") % 3
    g = _groups(s, d).withColumn("labels", F.when(m == 0, F.lit(None)).when(m == 1, F.array_append("labels", F.lit(2))).otherwise(F.col("labels")))
    return ca.violations(g).select("problem_id", F.array_join("problems", ",").alias("problems"))


_RAW = [
    ('[1]', "not an object"), ('{"candidates": []}', "problem_id missing"), ('{"problem_id": null, "candidates": []}', "problem_id is null"), ('{"problem_id": "", "candidates": []}', "problem_id empty"),
    ('{"problem_id": "a", "candidates": "x"}', "candidates are no list"), ('{"problem_id": "a"}', "candidates are no list"), ('{"problem_id": "a", "candidates": ["x", 3]}', "candidate is no string"), ('{"problem_id": "a", "candidates": ["x"]}', "labels missing"),
    ('{"problem_id": "a", "candidates": ["x"], "labels": 1}', "labels are no list"), ('{"problem_id": "a", "candidates": ["x"], "labels": [1, 0]}', "lengths differ"), ('{"problem_id": "a", "candidates": ["x"], "labels": [2]}', "label not 0 or 1"),
    ('{"problem_id": "a", "candidates": ["x"], "labels": ["1"]}', "label is no integer"), ('{"problem_id": "a", "candidates": ["x"], "labels": [0.5]}', "label is no integer"), ('{"problem_id": 7, "candidates": ["x", "y"], "labels": [true, 0]}', None), ('{"problem_id": "b", "candidates": [], "labels": []}', None),
]


@query("OP-041_raw_cases", "SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{f}')" for v, f in _RAW if f) + ") t(value, problem)")
def _(s, d):
    return ca.raw_violations(s.createDataFrame([(v,) for v, _ in _RAW], "value string"), require_labels=True)


for _name, _inv in (("OP-060_semi_filter", False), ("OP-060_anti_filter", True)):
    query(_name, f"WITH {LINE} SELECT problem_id, candidate_index FROM lc WHERE problem_id {'NOT ' if _inv else ''}IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")(
        lambda s, d, inv=_inv: ca.by_ids(fx.line_candidates(s, d), fx.table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("problem_id")), inv).select("problem_id", "candidate_index"))


@query("OP-061_drop_blank", f"WITH {STMT} SELECT sid FROM statements WHERE {fx.sql_squeeze('text')} <> ''")
def _(s, d):
    return ca.drop_blank(fx.statements(s, d), "text").select("sid")


@query("OP-062_skip_empty_groups", f"WITH {CONV}, {_GROUPS} SELECT problem_id, len(candidates)::INTEGER AS n FROM g WHERE len(candidates) > 0")
def _(s, d):
    return _groups(s, d).filter(F.size("candidates") > 0).select("problem_id", F.size("candidates").alias("n"))


_MASK = "m AS (SELECT *, NOT max(typechecks) OVER (PARTITION BY problem_id) AS no_survivors FROM lc)"


@query("OP-063_typecheck_mask", f"WITH {LINE}, {_MASK} SELECT problem_id, candidate_index, no_survivors AS no_typecheck_survivors FROM m WHERE typechecks OR no_survivors")
def _(s, d):
    return ca.typecheck_mask(fx.line_candidates(s, d)).select("problem_id", "candidate_index", "no_typecheck_survivors")


_ARGMAX = "pick AS (SELECT problem_id, candidate_index AS chosen_index, score_a AS score, label FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score_a DESC, candidate_index) AS r FROM lc) WHERE r = 1)"
_EXAMPLES = f"""{_ARGMAX}, ru AS (SELECT problem_id, candidate_index, score_a FROM (SELECT lc.*, row_number() OVER (PARTITION BY problem_id ORDER BY score_a DESC, candidate_index) AS r FROM lc) WHERE r = 2),
anyc AS (SELECT problem_id, max(label) AS has_any_correct, count(*) AS n_candidates FROM lc GROUP BY 1),
ex AS (SELECT problem_id, label AS selected_correct, has_any_correct, n_candidates, chosen_index, pick.score AS chosen_score, {fx.sql_sigmoid('pick.score / 2.5')} AS chosen_probability, ru.candidate_index AS runner_up_index, ru.score_a AS runner_up_score,
  pick.score - ru.score_a AS score_margin, {fx.sql_sigmoid('pick.score / 2.5')} - {fx.sql_sigmoid('ru.score_a / 2.5')} AS probability_margin FROM pick JOIN anyc USING (problem_id) LEFT JOIN ru USING (problem_id))"""


def _examples(s, d):
    sc = fx.scored_lines(s, d)
    c = se.confidence(sc, se.arg_max(sc), temperature=2.5)
    lab = ev.label_at(c, sc, name="selected_correct")
    return lab.join(sc.groupBy("problem_id").agg(F.max("label").alias("has_any_correct")), "problem_id")


@query("OP-065_confidence_filter", f"WITH {LINE}, {_EXAMPLES} SELECT problem_id, round(coalesce(probability_margin, 0), 12) >= 0.2 AS accepted FROM ex")
def _(s, d):
    return sv.apply_threshold(sv.with_confidence(_examples(s, d), "probability_margin"), 0.2).select("problem_id", "accepted")


_SELS = f"{_ARGMAX}, sel AS (SELECT problem_id, chosen_index, score, CASE WHEN problem_id % 7 = 0 THEN false WHEN problem_id % 5 = 0 THEN true END AS accepted, CASE WHEN problem_id % 11 = 0 AND problem_id % 5 <> 0 THEN true END AS abstained FROM pick WHERE problem_id % 13 <> 0)"
_CHOICES = _SELS.replace(" WHERE problem_id % 13 <> 0", "")


def _choices(s, d):
    """A choice for every problem, some of them explicit abstentions."""
    p = F.col("problem_id")
    return se.arg_max(fx.scored_lines(s, d)).withColumn("accepted", F.when(p % 7 == 0, False).when(p % 5 == 0, True)).withColumn("abstained", F.when((p % 11 == 0) & (p % 5 != 0), True))


def _selections(s, d):
    """The choices of a partial run, which lacks some problems: for the operators that say what a missing choice means."""
    return _choices(s, d).filter(F.col("problem_id") % 13 != 0)


@query("OP-066_is_abstention", f"WITH {LINE}, {_CHOICES} SELECT problem_id, (coalesce(abstained, false) OR coalesce(NOT accepted, false)) AS is_abstained FROM sel")
def _(s, d):
    return _choices(s, d).select("problem_id", ca.is_abstention().alias("is_abstained"))


@query("OP-067_index_guard", f"WITH {LINE}, {_ARGMAX} SELECT problem_id, chosen_index FROM pick")
def _(s, d):
    c = fx.scored_lines(s, d)
    n = c.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"))
    return se.arg_max(c).join(n, "problem_id").select("problem_id", ca.index_guard(F.col("chosen_index"), F.col("n")).alias("chosen_index"))


@query("OP-068_point_lookup", f"WITH {LINE} SELECT candidate_index, score_a FROM lc WHERE problem_id = 1")
def _(s, d):
    return fx.line_candidates(s, d).filter("problem_id = 1").select("candidate_index", "score_a")


# --- joins -----------------------------------------------------------------------------------------------------------------------


@query("OP-080_inner_join", f"WITH {LINE}, {_CHOICES} SELECT lc.problem_id, candidate_index, chosen_index FROM lc JOIN sel USING (problem_id)")
def _(s, d):
    return fx.line_candidates(s, d).join(_choices(s, d), "problem_id").select("problem_id", "candidate_index", "chosen_index")


@query("OP-081_left_join", f"WITH {LINE}, {_SELS} SELECT a.problem_id, chosen_index, chosen_index IS NULL AS missing FROM (SELECT DISTINCT problem_id FROM lc) a LEFT JOIN sel USING (problem_id)")
def _(s, d):
    return fx.line_candidates(s, d).select("problem_id").distinct().join(_selections(s, d), "problem_id", "left").select("problem_id", "chosen_index", F.col("chosen_index").isNull().alias("missing"))


@query("OP-082_one_sided_ids", "SELECT 'orders_only' AS side, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'lines_only', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(s, d):
    o = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("problem_id"))
    li = fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("problem_id")).distinct()
    return ca.by_ids(o, li, True).agg(F.lit("orders_only").alias("side"), F.count(F.lit(1)).alias("n")).unionByName(ca.by_ids(li, o, True).agg(F.lit("lines_only").alias("side"), F.count(F.lit(1)).alias("n")))


@query("OP-083_three_way", f"WITH {LINE}, {_CHOICES}, b AS (SELECT problem_id, arg_max(candidate_index, (score_b, -candidate_index)) AS b_index FROM lc GROUP BY 1) SELECT a.problem_id, chosen_index, b_index FROM (SELECT DISTINCT problem_id FROM lc) a JOIN sel USING (problem_id) JOIN b USING (problem_id)")
def _(s, d):
    b = se.arg_max(fx.scored_lines(s, d, "score_b")).select("problem_id", F.col("chosen_index").alias("b_index"))
    return fx.line_candidates(s, d).select("problem_id").distinct().join(_choices(s, d), "problem_id").join(b, "problem_id").select("problem_id", "chosen_index", "b_index")


@query("OP-084_four_way", f"WITH {LINE}, {_CHOICES}, b AS (SELECT problem_id, arg_max(candidate_index, (score_b, -candidate_index)) AS b_index FROM lc GROUP BY 1) SELECT sel.problem_id, chosen_index, b_index, o_orderstatus AS outcome FROM sel JOIN b USING (problem_id) JOIN orders ON o_orderkey = problem_id WHERE problem_id IN (SELECT problem_id FROM lc)")
def _(s, d):
    b = se.arg_max(fx.scored_lines(s, d, "score_b")).select("problem_id", F.col("chosen_index").alias("b_index"))
    o = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("problem_id"), F.col("o_orderstatus").alias("outcome"))
    return _choices(s, d).join(b, "problem_id").join(o, "problem_id").select("problem_id", "chosen_index", "b_index", "outcome")


_METHODS = f"""{_SELS}, methods AS (SELECT 'argmax_a' AS method, problem_id, chosen_index, NOT (coalesce(abstained, false) OR coalesce(NOT accepted, false)) AS accepted FROM sel
  UNION ALL SELECT 'argmax_b', problem_id, arg_max(candidate_index, (score_b, -candidate_index)), true FROM lc GROUP BY problem_id
  UNION ALL SELECT 'first', problem_id, 0, true FROM lc GROUP BY problem_id)"""
_DEC = f"""{_METHODS}, dec AS (SELECT m.method, a.problem_id, CASE WHEN accepted THEN label ELSE 0 END AS correct, coalesce(accepted, false) AS accepted, a.any_correct
  FROM (SELECT problem_id, max(label) AS any_correct FROM lc GROUP BY 1) a CROSS JOIN (VALUES ('argmax_a'), ('argmax_b'), ('first')) m(method) LEFT JOIN methods x ON x.method = m.method AND x.problem_id = a.problem_id
  LEFT JOIN lc ON lc.problem_id = a.problem_id AND lc.candidate_index = x.chosen_index), dec0 AS (SELECT method, problem_id, coalesce(correct, 0) AS correct, accepted, any_correct FROM dec)"""


def _methods(s, d):
    a = _selections(s, d).select(F.lit("argmax_a").alias("method"), "problem_id", "chosen_index", (~ca.is_abstention()).alias("accepted"))
    b = se.arg_max(fx.scored_lines(s, d, "score_b")).select(F.lit("argmax_b").alias("method"), "problem_id", "chosen_index", F.lit(True).alias("accepted"))
    f = se.first_candidate(fx.line_candidates(s, d)).select(F.lit("first").alias("method"), "problem_id", "chosen_index", F.lit(True).alias("accepted"))
    return a.unionByName(b).unionByName(f)


def _decisions(s, d):
    return leaderboard.method_decisions(fx.line_candidates(s, d), _methods(s, d), ["argmax_a", "argmax_b", "first"])


@query("OP-085_all_methods", f"WITH {LINE}, {_METHODS} SELECT problem_id FROM methods GROUP BY 1 HAVING count(DISTINCT method) = 3")
def _(s, d):
    return ca.common_to_all(_methods(s, d), 3)


@query("OP-086_disjoint_union", f"WITH {LINE}, {_SELS} SELECT problem_id, chosen_index FROM sel UNION ALL SELECT problem_id, NULL FROM (SELECT DISTINCT problem_id FROM lc) WHERE problem_id % 13 = 0")
def _(s, d):
    rest = fx.line_candidates(s, d).select("problem_id").distinct().filter("problem_id % 13 = 0")
    return ca.disjoint_union(_selections(s, d).select("problem_id", "chosen_index"), rest)


@query("OP-087_label_at", f"WITH {LINE}, {_ARGMAX} SELECT problem_id, chosen_index, label AS chosen_correct FROM pick")
def _(s, d):
    c = fx.scored_lines(s, d)
    return ev.label_at(se.arg_max(c), c).select("problem_id", "chosen_index", "chosen_correct")


@query("OP-088_lookup_join", "SELECT l_orderkey AS problem_id, count(*) AS n, any_value(o_orderpriority) AS nl FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(s, d):
    nl = ca.lookup_first(fx.table(s, d, "orders").select(F.col("o_orderkey").alias("problem_id"), "o_orderdate", F.col("o_orderpriority").alias("nl")), "problem_id", "o_orderdate", "nl")
    return fx.line_candidates(s, d).groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).join(nl, "problem_id")


@query("OP-089_pairs", f"WITH {LINE} SELECT a.problem_id, a.candidate_index AS i, b.candidate_index AS j FROM lc a JOIN lc b ON a.problem_id = b.problem_id AND a.candidate_index < b.candidate_index")
def _(s, d):
    return pr.pair_frame(fx.line_candidates(s, d))


@query("OP-090_correct_incorrect", f"WITH {LINE} SELECT a.problem_id, a.candidate_index AS pos, b.candidate_index AS neg FROM lc a JOIN lc b ON a.problem_id = b.problem_id AND a.label = 1 AND b.label = 0")
def _(s, d):
    return etl.pairwise_examples(fx.line_candidates(s, d))


_COS = "cosp AS (SELECT a.problem_id, a.candidate_index AS i, b.candidate_index AS j, list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding))) AS score FROM vc a JOIN vc b ON a.problem_id = b.problem_id AND a.candidate_index < b.candidate_index)"
_DIRECTED = "dir AS (SELECT problem_id, i AS node, j AS other, round(score, 9) AS score FROM cosp UNION ALL SELECT problem_id, j, i, round(score, 9) FROM cosp), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, node ORDER BY score DESC, other) AS r FROM dir) WHERE r <= 3)"


def _cos(s, d):
    return r9(pr.cosine_pairs(fx.vec_candidates(s, d)))


for _name, _need in (("OP-091_knn_mutual", 2), ("OP-091_knn_union", 1)):
    query(_name, f"WITH {VEC}, {_COS}, {_DIRECTED} SELECT problem_id, least(node, other) AS i, greatest(node, other) AS j, max(score) AS score FROM near GROUP BY 1, 2, 3 HAVING count(*) >= {_need}")(
        lambda s, d, need=_need: pr.near_edges(pr.nearest(fx.vec_candidates(s, d), 3), need == 2))

_T = 0.2
_EDGES = f"ed AS (SELECT problem_id, i, j, round(score, 9) AS score FROM cosp WHERE round(score, 9) >= {_T}), bo AS (SELECT problem_id, i AS node, j AS other, score FROM ed UNION ALL SELECT problem_id, j, i, score FROM ed)"
_TRI = "tri AS (SELECT a.problem_id, a.node AS centre, a.other AS i, b.other AS k, a.score AS s_i, b.score AS s_k FROM bo a JOIN bo b ON a.problem_id = b.problem_id AND a.node = b.node AND a.other < b.other)"


def _edges(s, d):
    return graph.threshold_edges(_cos(s, d), _T)


@query("OP-092_triangles", f"WITH {VEC}, {_COS}, {_EDGES}, {_TRI} SELECT * FROM tri")
def _(s, d):
    return graph.triangles(_edges(s, d))


@query("OP-093_first_match", f"WITH {CONV}, ch AS (SELECT problem_id, max(candidate) AS chosen FROM cc GROUP BY 1) SELECT ch.problem_id, min(candidate_index) AS candidate_index FROM ch LEFT JOIN cc ON cc.problem_id = ch.problem_id AND candidate = chosen GROUP BY 1")
def _(s, d):
    c = fx.conv_candidates(s, d)
    return ca.first_match(c, c.groupBy("problem_id").agg(F.max("candidate").alias("chosen")))


@query("OP-094_overlay", f"WITH {LINE}, {_CHOICES}, b AS (SELECT problem_id, count(*) AS n, max(score_a) AS score FROM lc GROUP BY 1) SELECT b.problem_id, coalesce(sel.score, b.score) AS score, n, chosen_index FROM b JOIN sel USING (problem_id)")
def _(s, d):
    b = fx.line_candidates(s, d).groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.max("score_a").alias("score"))
    return ca.overlay(b, _choices(s, d).select("problem_id", "score", "chosen_index"))


@query("OP-095_split_overlap", "SELECT o_orderkey AS problem_id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def _(s, d):
    return etl.overlap(fx.table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("problem_id")), fx.table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("problem_id")))


# --- grouping --------------------------------------------------------------------------------------------------------------------


@query("OP-100_grouped", f"WITH {CONV}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, candidate ORDER BY row_no) AS r FROM cc) WHERE r = 1) SELECT problem_id, array_to_string(list(candidate ORDER BY row_no), '|') AS candidates, array_to_string(list(label ORDER BY row_no), '|') AS labels FROM f GROUP BY 1")
def _(s, d):
    g = ca.grouped(fx.conv_candidates(s, d), "row_no", dedupe=True)
    return g.select("problem_id", F.array_join("candidates", "|").alias("candidates"), F.array_join(F.transform("labels", lambda x: x.cast("string")), "|").alias("labels"))


@query("OP-101_reference_length", f"WITH {CONV}, r AS (SELECT problem_id, arg_min(candidate, row_no) AS candidate FROM cc GROUP BY 1), {fx.sql_steps('r', 'problem_id', 'candidate')} SELECT problem_id, length(norm)::INTEGER AS ref_len_chars FROM s4")
def _(s, d):
    return ca.with_reference_length(fx.conv_candidates(s, d).withColumn("reference", F.col("candidate")), "row_no")


@query("OP-102_first_statement", f"WITH {CONV} SELECT problem_id, arg_min(candidate, row_no) AS nl FROM cc WHERE trim(coalesce(candidate, '')) <> '' GROUP BY 1")
def _(s, d):
    return ca.first_statement(fx.conv_candidates(s, d), "row_no", "candidate").withColumnRenamed("candidate", "nl")


@query("OP-103_explode", f"WITH {CONV} SELECT problem_id, candidate_index, candidate, label FROM cc")
def _(s, d):
    return ca.long_form(_groups(s, d), "candidates", "labels")


@query("OP-104_majority", f"WITH {DOC}, {fx.sql_steps('dc', 'problem_id, candidate_index', 'candidate')}, g AS (SELECT problem_id, norm, count(*) AS n, min(candidate_index) AS f FROM s4 GROUP BY 1, 2) SELECT problem_id, arg_max(f, (n, -length(norm), -f)) AS candidate_index FROM g GROUP BY 1")
def _(s, d):
    return ca.majority(fx.doc_candidates(s, d))


# --- similarity ------------------------------------------------------------------------------------------------------------------

_BLEU = f"""{CONV}, {_NORM_CONV}, {_GRAMS}, len_of AS (SELECT problem_id, candidate_index, len(toks) AS n FROM t),
ov AS (SELECT a.problem_id, a.candidate_index AS i, b.candidate_index AS j, a.n, sum(least(a.c, b.c)) AS o FROM g a JOIN g b ON a.problem_id = b.problem_id AND a.n = b.n AND a.gram = b.gram AND a.candidate_index < b.candidate_index GROUP BY ALL),
pp AS (SELECT a.problem_id, a.candidate_index AS i, b.candidate_index AS j, a.n AS li, b.n AS lj FROM len_of a JOIN len_of b ON a.problem_id = b.problem_id AND a.candidate_index < b.candidate_index),
lg AS (SELECT problem_id, i, j, li, lj, sum(ln(greatest(1e-12, CASE WHEN li - v.n + 1 > 0 THEN (coalesce(o, 0) + 1) / (li - v.n + 2)::DOUBLE ELSE 0 END)) / 4) AS si, sum(ln(greatest(1e-12, CASE WHEN lj - v.n + 1 > 0 THEN (coalesce(o, 0) + 1) / (lj - v.n + 2)::DOUBLE ELSE 0 END)) / 4) AS sj
  FROM pp CROSS JOIN (VALUES (1), (2), (3), (4)) v(n) LEFT JOIN ov USING (problem_id, i, j, n) GROUP BY ALL),
way AS (SELECT problem_id, i, j, CASE WHEN li = 0 AND lj = 0 THEN 1 WHEN li = 0 THEN 0 ELSE exp(si) * (CASE WHEN li < lj THEN exp(1 - lj / li::DOUBLE) ELSE 1 END) END AS x,
  CASE WHEN li = 0 AND lj = 0 THEN 1 WHEN lj = 0 THEN 0 ELSE exp(sj) * (CASE WHEN lj < li THEN exp(1 - li / lj::DOUBLE) ELSE 1 END) END AS y FROM lg),
bl AS (SELECT problem_id, i, j, 0.5 * (x + y) AS score FROM way)"""
_BLEU_DIR = f"{_BLEU}, bd AS (SELECT problem_id, i AS node, j AS other, score FROM bl UNION ALL SELECT problem_id, j, i, score FROM bl)"
_CENT = f"{_BLEU_DIR}, ce AS (SELECT s4.problem_id, s4.candidate_index, length(norm) AS len, round(coalesce(avg(score), 1), 9) AS centrality FROM s4 LEFT JOIN bd ON bd.problem_id = s4.problem_id AND bd.node = s4.candidate_index GROUP BY 1, 2, 3)"


def _bleu(s, d):
    return pr.bleu_pairs(fx.conv_candidates(s, d))


def _conv_nodes(s, d):
    return fx.conv_candidates(s, d).withColumn("length", F.length(tx.normalize(F.coalesce("candidate", F.lit("")))))


@query("OP-110_bleu_one_way", f"WITH {_BLEU} SELECT problem_id, i AS hyp, j AS ref, round(x, 9) AS score FROM way UNION ALL SELECT problem_id, j, i, round(y, 9) FROM way")
def _(s, d):
    return r9(pr.bleu_directed(fx.conv_candidates(s, d)))


@query("OP-111_sym_bleu", f"WITH {_BLEU} SELECT problem_id, count(*) AS pairs, round(avg(score), 7) AS mean_bleu, round(max(score), 9) AS top FROM bl GROUP BY 1")
def _(s, d):
    return _bleu(s, d).groupBy("problem_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("score"), 7).alias("mean_bleu"), F.round(F.max("score"), 9).alias("top"))


@query("OP-112_bleu_matrix", f"WITH {_BLEU_DIR} SELECT problem_id, node AS i, other AS j, round(score, 9) AS score FROM bd UNION ALL SELECT problem_id, candidate_index, candidate_index, 1.0 FROM cc")
def _(s, d):
    diag = fx.conv_candidates(s, d).select("problem_id", F.col("candidate_index").alias("i"), F.col("candidate_index").alias("j"), F.lit(1.0).alias("score"))
    return r9(pr.both_ways(_bleu(s, d)).select("problem_id", F.col("node").alias("i"), F.col("other").alias("j"), "score").unionByName(diag))


@query("OP-113_bleu_centrality", f"WITH {_CENT} SELECT problem_id, candidate_index, centrality, (row_number() OVER (PARTITION BY problem_id ORDER BY centrality DESC, len, candidate_index))::INTEGER AS place FROM ce")
def _(s, d):
    c = r9(pr.centrality(_conv_nodes(s, d).select("problem_id", "candidate_index", "length"), _bleu(s, d)))
    from quorate.operators.windows import per_problem

    return c.select("problem_id", "candidate_index", "centrality", F.row_number().over(per_problem(F.desc("centrality"), "length", "candidate_index")).alias("place"))


@query("OP-114_scorer_matrix", f"WITH {VEC}, {_COS} SELECT problem_id, i, j, round(score, 9) AS score FROM cosp")
def _(s, d):
    return r9(pr.SCORERS.score("cosine", fx.vec_candidates(s, d)))


@query("OP-115_knn_scored", f"WITH {VEC}, {_COS}, {_DIRECTED}, k AS (SELECT DISTINCT problem_id, least(node, other) AS i, greatest(node, other) AS j FROM near) SELECT c.problem_id, c.i, c.j, CASE WHEN k.i IS NULL THEN 0 ELSE round(c.score, 9) END AS score FROM cosp c LEFT JOIN k ON k.problem_id = c.problem_id AND k.i = c.i AND k.j = c.j")
def _(s, d):
    return pr.knn_scored(_cos(s, d), pr.near_edges(pr.nearest(fx.vec_candidates(s, d), 3), mutual=False))


_JAC = f"""jt AS (SELECT problem_id, candidate_index, list_distinct(regexp_extract_all(coalesce(candidate, ''), '{fx.SQL_TOKEN}')) AS k FROM cc),
ja AS (SELECT a.problem_id, a.candidate_index AS i, b.candidate_index AS j, len(list_intersect(a.k, b.k)) AS o, len(a.k) + len(b.k) AS n FROM jt a JOIN jt b ON a.problem_id = b.problem_id AND a.candidate_index < b.candidate_index),
jj AS (SELECT problem_id, i, j, CASE WHEN n - o > 0 THEN o / (n - o)::DOUBLE ELSE 1 END AS score FROM ja)"""


@query("OP-116_hybrid", f"WITH {_BLEU}, {_JAC} SELECT problem_id, i, j, round(0.7 * jj.score + 0.3 * bl.score, 7) AS score FROM jj JOIN bl USING (problem_id, i, j)")
def _(s, d):
    h = pr.hybrid_pairs(pr.jaccard_pairs(fx.conv_candidates(s, d)), _bleu(s, d), 0.7)
    return h.withColumn("score", F.round("score", 7))


# --- graph -----------------------------------------------------------------------------------------------------------------------

_COMPS = """walk AS (WITH RECURSIVE w(problem_id, node, reach) AS (SELECT problem_id, candidate_index, candidate_index FROM vc UNION SELECT w.problem_id, w.node, bo.other FROM w JOIN bo ON bo.problem_id = w.problem_id AND bo.node = w.reach) SELECT problem_id, node AS candidate_index, min(reach) AS component FROM w GROUP BY 1, 2)"""
_COMPSTAT = "cs AS (SELECT a.problem_id, a.component, list(a.candidate_index ORDER BY a.candidate_index) AS indices FROM walk a GROUP BY 1, 2), ch AS (SELECT a.problem_id, a.component, avg(round(c.score, 9)) AS coh FROM cosp c JOIN walk a ON a.problem_id = c.problem_id AND a.candidate_index = c.i JOIN walk b ON b.problem_id = c.problem_id AND b.candidate_index = c.j AND b.component = a.component GROUP BY 1, 2), cst AS (SELECT cs.problem_id, cs.component, indices, len(indices) AS size, round(coalesce(coh, 1)::DECIMAL(18, 12), 9)::DOUBLE AS cohesion FROM cs LEFT JOIN ch USING (problem_id, component))"


def _nodes(s, d):
    return fx.vec_candidates(s, d).select("problem_id", "candidate_index")


@query("OP-120_threshold_edges", f"WITH {VEC}, {_COS}, {_EDGES} SELECT problem_id, i, j, score FROM ed")
def _(s, d):
    return _edges(s, d)


@query("OP-121_mutual_edges", f"WITH {VEC}, {_COS}, {_DIRECTED}, k AS (SELECT problem_id, least(node, other) AS i, greatest(node, other) AS j, max(score) AS score FROM near GROUP BY 1, 2, 3 HAVING count(*) = 2) SELECT * FROM k WHERE score >= {_T}")
def _(s, d):
    return graph.threshold_edges(_cos(s, d), _T, mutual_k=3)


_PRUNE = f"bad AS (SELECT tri.problem_id, centre, CASE WHEN s_i <= s_k THEN tri.i ELSE k END AS weak FROM tri JOIN cosp f ON f.problem_id = tri.problem_id AND f.i = tri.i AND f.j = tri.k WHERE round(f.score, 9) < {_T} AND least(s_i, s_k) - round(f.score, 9) >= 0.2), drops AS (SELECT DISTINCT problem_id, least(centre, weak) AS i, greatest(centre, weak) AS j FROM bad)"


@query("OP-122_prune_triangles", f"WITH {VEC}, {_COS}, {_EDGES}, {_TRI}, {_PRUNE} SELECT ed.* FROM ed ANTI JOIN drops USING (problem_id, i, j)")
def _(s, d):
    p = _cos(s, d)
    return graph.prune_triangles(graph.threshold_edges(p, _T), p, _T, 0.2)


# a node without edges, in index order, takes its best pair unless it was taken before
_RESCUE = """kept AS (SELECT ed.* FROM ed ANTI JOIN drops USING (problem_id, i, j)), had AS (SELECT problem_id, i AS node FROM kept UNION SELECT problem_id, j FROM kept),
alone AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY node) AS r FROM (SELECT problem_id, node, arg_min(other, (-score, other)) AS other, max(score) AS score FROM bo GROUP BY 1, 2) ANTI JOIN had USING (problem_id, node)),
added AS (WITH RECURSIVE w(problem_id, r, seen, node, other, score) AS (SELECT DISTINCT problem_id, 0::BIGINT, []::INTEGER[], NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE FROM alone
  UNION ALL SELECT w.problem_id, a.r, CASE WHEN list_contains(seen, a.node) THEN seen ELSE list_concat(seen, [a.node, a.other]) END, CASE WHEN NOT list_contains(seen, a.node) THEN a.node END, a.other, a.score FROM w JOIN alone a ON a.problem_id = w.problem_id AND a.r = w.r + 1)
  SELECT problem_id, least(node, other) AS i, greatest(node, other) AS j, score FROM w WHERE node IS NOT NULL)"""


@query("OP-123_rescue_isolates", f"WITH {VEC}, {_COS}, {_EDGES}, {_TRI}, {_PRUNE.replace('>= 0.2)', '>= 0.05)')}, {_RESCUE} SELECT * FROM added")
def _(s, d):
    p = _cos(s, d)
    e = graph.threshold_edges(p, _T)
    return graph.rescue_isolates(_nodes(s, d), graph.prune_triangles(e, p, _T, 0.05), e)


@query("OP-124_components", f"WITH {VEC}, {_COS}, {_EDGES}, {_COMPS} SELECT * FROM walk")
def _(s, d):
    return graph.components(_nodes(s, d), _edges(s, d))


@query("OP-125_graph_counts", f"WITH {VEC}, {_COS}, {_EDGES}, {_COMPS} SELECT problem_id, count(DISTINCT component) AS components_before, count(*) FILTER (candidate_index NOT IN (SELECT node FROM bo WHERE bo.problem_id = walk.problem_id)) AS isolated_before, (SELECT count(*) FROM ed WHERE ed.problem_id = walk.problem_id) AS edges_before FROM walk GROUP BY 1")
def _(s, d):
    n, e = _nodes(s, d), _edges(s, d)
    return graph.graph_counts(n, e, graph.components(n, e), "before")


@query("OP-126_cohesion", f"WITH {VEC}, {_COS}, {_EDGES}, {_COMPS}, {_COMPSTAT} SELECT problem_id, component, size::INTEGER AS size, cohesion, array_to_string(indices, ',') AS indices FROM cst")
def _(s, d):
    p = _cos(s, d)
    c = r9(graph.cohesion(graph.components(_nodes(s, d), _edges(s, d)), p))
    return c.select("problem_id", "component", "size", "cohesion", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"))


for _by, _keys in (("size", "size DESC"), ("cohesion", "cohesion DESC, size DESC"), ("size_times_cohesion", "round(size * cohesion, 9) DESC, size DESC"), ("size_then_cohesion", "size DESC, cohesion DESC")):
    query(f"OP-127_rank_by_{_by}", f"WITH {VEC}, {_COS}, {_EDGES}, {_COMPS}, {_COMPSTAT} SELECT problem_id, component, (row_number() OVER (PARTITION BY problem_id ORDER BY {_keys}, component))::INTEGER AS rank FROM cst")(
        lambda s, d, by=_by: graph.rank_components(r9(graph.cohesion(graph.components(_nodes(s, d), _edges(s, d)), _cos(s, d))), by).select("problem_id", "component", "rank"))


# problems as square tables of scores and links, so that a node's row lies at node * n
_SQUARE = f"""sq AS (SELECT a.problem_id, max(a.candidate_index) OVER (PARTITION BY a.problem_id) + 1 AS n, a.candidate_index AS a, b.candidate_index AS b, CASE WHEN a.candidate_index = b.candidate_index THEN 0.0::DOUBLE ELSE round(c.score, 9) END AS score
  FROM vc a JOIN vc b USING (problem_id) LEFT JOIN cosp c ON c.problem_id = a.problem_id AND c.i = least(a.candidate_index, b.candidate_index) AND c.j = greatest(a.candidate_index, b.candidate_index)),
tab AS (SELECT problem_id, n, list(score ORDER BY a, b) AS s, list(a = b OR score >= {_T} ORDER BY a, b) AS l FROM sq GROUP BY 1, 2)"""


def _thinned(start: str, share: float) -> str:
    """Drops the member with the least support, of equals the smallest, while it is too little; start is (problem_id, seed, members)."""
    weakest = "list_min(list_transform(members, lambda m: {'s': len(list_filter(members, lambda x: l[m * n + x + 1])), 'm': m}))"
    return f"""thin AS (WITH RECURSIVE t(problem_id, seed, members) AS (SELECT problem_id, seed, members FROM {start}
  UNION ALL SELECT problem_id, seed, list_filter(members, lambda m: m <> weak.m) FROM (SELECT t.*, {weakest} AS weak FROM t JOIN tab USING (problem_id) WHERE len(members) >= 2) WHERE weak.s < floor({share} * len(members) + 0.999999))
  SELECT problem_id, seed, arg_min(members, len(members)) AS members FROM t GROUP BY 1, 2)"""


# from each node, the linked enough with the best mean joins; equals by links, then the smaller
_GROWN = """grown AS (WITH RECURSIVE g(problem_id, seed, members) AS (SELECT problem_id, candidate_index, [candidate_index] FROM vc
  UNION ALL SELECT problem_id, seed, list_append(members, best.k) FROM (SELECT g.*, list_max(list_transform(list_filter(range(n), lambda k: NOT list_contains(members, k::INTEGER) AND len(list_filter(members, lambda m: l[k * n + m + 1])) >= floor(0.5 * len(members) + 0.999999)),
      lambda k: {'mean': list_sum(list_transform(members, lambda m: s[k * n + m + 1])) / len(members), 'links': len(list_filter(members, lambda m: l[k * n + m + 1])), 'minus': -k, 'k': k::INTEGER})) AS best FROM g JOIN tab USING (problem_id)) WHERE best IS NOT NULL)
  SELECT problem_id, seed, arg_max(members, len(members)) AS members FROM g GROUP BY 1, 2)"""


def _listed(df):
    return r9(df.withColumn("indices", F.array_join(F.transform("indices", lambda v: v.cast("string")), ",")))


@query("OP-128_support_clusters", f"WITH {VEC}, {_COS}, {_SQUARE}, {_GROWN}, {_thinned('grown', 0.5)}, u AS (SELECT DISTINCT problem_id, list_sort(members) AS x FROM thin) SELECT problem_id, array_to_string(x, ',') AS indices, len(x)::INTEGER AS size, round((CASE WHEN len(x) = 1 THEN 1 ELSE list_sum(list_transform(x, lambda a: list_sum(list_transform(x, lambda b: s[a * n + b + 1])))) / (len(x) * (len(x) - 1)) END)::DECIMAL(18, 12), 9)::DOUBLE AS cohesion FROM u JOIN tab USING (problem_id)")
def _(s, d):
    p = _cos(s, d)
    # a mean may lie halfway between two values of nine digits
    return _listed(graph.support_clusters(_nodes(s, d), graph.threshold_edges(p, _T), p, 0.5).withColumn("cohesion", F.round("cohesion", 12)))


@query("OP-129_densify", f"WITH {VEC}, {_COS}, {_EDGES}, {_COMPS}, {_SQUARE}, cl AS (SELECT problem_id, component AS seed, list(candidate_index ORDER BY candidate_index) AS members FROM walk GROUP BY 1, 2), {_thinned('cl', 0.3)} SELECT problem_id, array_to_string(members, ',') AS indices FROM thin")
def _(s, d):
    e = _edges(s, d)
    comps = graph.components(_nodes(s, d), e).groupBy("problem_id", "component").agg(F.array_sort(F.collect_list("candidate_index")).alias("indices"))
    return _listed(graph.densify(comps, e, 0.3))


@query("OP-130_ranked_components", f"WITH {VEC}, {_COS}, {_EDGES}, {_COMPS}, {_COMPSTAT} SELECT problem_id, array_to_string(indices, ',') AS indices, (row_number() OVER (PARTITION BY problem_id ORDER BY size DESC, cohesion DESC, component))::INTEGER AS rank, size::INTEGER AS size, cohesion FROM cst")
def _(s, d):
    c, _stats = graph.ranked_components(_nodes(s, d), _cos(s, d), _T)
    return r9(c).select("problem_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"), "rank", "size", "cohesion")
