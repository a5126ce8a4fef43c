"""The second half of the catalogue: selection, ranking, evaluation, calibration, selective prediction, leaderboards, training data."""
from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.functions import text as tx
from quorate.operators import calibration as cal
from quorate.operators import candidates as ca
from quorate.operators import etl, graph, grid, leaderboard
from quorate.operators import evaluation as ev
from quorate.operators import pairs as pr
from quorate.operators import selection as se
from quorate.operators import selective as sv
from quorate.operators.windows import cut, global_prefix, per_problem
from quorate.plans import fixtures as fx
from quorate.plans.catalog import (_ARGMAX, _BLEU, _BLEU_DIR, _CENT, _COMPS, _COMPSTAT, _COS, _DEC, _EDGES, _EXAMPLES, _JAC, _METHODS, _RESCUE, _SELS, _T, _TRI, CONV, DOC, LINE, VEC, _bleu, _conv_nodes, _cos, _decisions, _edges, _examples, _methods, _nodes, _selections, query, r9)
from quorate.sources import jsonl

W = fx.sql_wilson
R = fx.sql_rate
SIG = fx.sql_sigmoid

# --- selection -------------------------------------------------------------------------------------------------------------------


@query("OP-140_shortest", f"WITH {CONV}, {fx.sql_steps('cc', 'problem_id, candidate_index', chr(99) + 'oalesce(candidate, ' + chr(39) * 2 + ')')} SELECT problem_id, arg_min(candidate_index, (length(norm), candidate_index)) AS chosen_index FROM s4 GROUP BY 1")
def _(s, d):
    return se.shortest(fx.conv_candidates(s, d))


_MEDOID = "mr AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY centrality DESC, len, candidate_index) AS r, lead(centrality) OVER (PARTITION BY problem_id ORDER BY centrality DESC, len, candidate_index) AS nx FROM ce)"


def _cents(s, d, **kw):
    return r9(pr.centrality(_conv_nodes(s, d).select("problem_id", "candidate_index", "length", "candidate", "label"), _bleu(s, d), **kw))


@query("OP-143_global_medoid", f"WITH {_CENT}, {_MEDOID} SELECT problem_id, candidate_index AS chosen_index, centrality, round(centrality - nx, 9) AS gap FROM mr WHERE r = 1")
def _(s, d):
    return r9(se.medoid(_cents(s, d), "length"))


@query("OP-141_simple_top_k", f"WITH {_CENT}, {_MEDOID}, ft AS (SELECT problem_id, candidate_index, {fx.sql_features('norm')} FROM s4), tk AS (SELECT mr.*, (n_chars / 100.0::DOUBLE + n_binders + n_prop) AS pen, max(centrality) OVER (PARTITION BY problem_id) AS top FROM mr JOIN ft USING (problem_id, candidate_index) WHERE r <= 3) SELECT problem_id, arg_min(candidate_index, (round(pen, 9), -centrality, len, candidate_index)) AS chosen_index FROM tk WHERE round(top - centrality, 12) <= 0.05 GROUP BY 1")
def _(s, d):
    c = _cents(s, d).withColumn("pen", F.round(tx.penalty(tx.normalize(F.coalesce("candidate", F.lit("")))), 9))
    return se.medoid(c, "length", simple_k=3, max_drop=0.05, penalty_col="pen").select("problem_id", "chosen_index")


@query("OP-144_geometric_medoid", f"WITH {_BLEU_DIR}, ge AS (SELECT s4.problem_id, s4.candidate_index, length(norm) AS len, round(coalesce(exp(avg(ln(least(greatest(score, 1e-12), 1)))), 1), 9) AS centrality FROM s4 LEFT JOIN bd ON bd.problem_id = s4.problem_id AND bd.node = s4.candidate_index GROUP BY 1, 2, 3) SELECT problem_id, arg_max(candidate_index, (centrality, -len, -candidate_index)) AS chosen_index, max(centrality) AS centrality FROM ge GROUP BY 1")
def _(s, d):
    return se.medoid(_cents(s, d, mode="geometric"), "length").select("problem_id", "chosen_index", "centrality")


@query("OP-145_knn_medoid", f"WITH {_BLEU_DIR}, nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, node ORDER BY score DESC, other) AS r FROM bd) WHERE r <= 3), kn AS (SELECT s4.problem_id, s4.candidate_index, length(norm) AS len, round(coalesce(avg(score), 1), 9) AS centrality FROM s4 LEFT JOIN nr ON nr.problem_id = s4.problem_id AND nr.node = s4.candidate_index GROUP BY 1, 2, 3) SELECT problem_id, arg_max(candidate_index, (centrality, -len, -candidate_index)) AS chosen_index, max(centrality) AS centrality FROM kn GROUP BY 1")
def _(s, d):
    return se.medoid(_cents(s, d, mode="knn", k=3), "length").select("problem_id", "chosen_index", "centrality")


_REP = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY size DESC, cohesion DESC, component) AS rank FROM cst), tp AS (SELECT problem_id, size, cohesion, unnest(indices) AS candidate_index FROM rk WHERE rank = 1),
din AS (SELECT problem_id, i AS node, j AS other, round(score, 9) AS score FROM cosp UNION ALL SELECT problem_id, j, i, round(score, 9) FROM cosp),
rc AS (SELECT t.problem_id, t.size, t.cohesion, t.candidate_index, round(coalesce(avg(x.score), 1), 9) AS centrality FROM tp t LEFT JOIN (SELECT din.* FROM din JOIN tp o ON o.problem_id = din.problem_id AND o.candidate_index = din.other) x ON x.problem_id = t.problem_id AND x.node = t.candidate_index GROUP BY ALL),
rep AS (SELECT problem_id, size, cohesion, candidate_index AS chosen_index, centrality FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY centrality DESC, candidate_index) AS r FROM rc) WHERE r = 1)"""


def _cluster_choice(s, d, tie="medoid"):
    c, stats = graph.ranked_components(_nodes(s, d), _cos(s, d), _T)
    nodes = _nodes(s, d).withColumn("length", F.lit(0))
    p = se.representatives(r9(c), nodes, _cos(s, d), tie)
    return r9(p).join(r9(c).filter("rank = 1").select("problem_id", "size", "cohesion"), "problem_id"), c


@query("OP-142_cluster_selection", f"WITH {VEC}, {_COS}, {_EDGES}, {_COMPS}, {_COMPSTAT}, {_REP} SELECT problem_id, chosen_index, centrality, size::INTEGER AS size, cohesion FROM rep")
def _(s, d):
    return _cluster_choice(s, d)[0].select("problem_id", "chosen_index", "centrality", "size", "cohesion")


_POOL = "gc AS (SELECT s4.problem_id, count(*)::INTEGER AS size, any_value(a.cohesion) AS cohesion FROM s4 LEFT JOIN (SELECT problem_id, round(avg(score), 7) AS cohesion FROM bl GROUP BY 1) a USING (problem_id) GROUP BY 1)"


def _global_mode(s, d, **kw):
    nodes = _conv_nodes(s, d).withColumn("penalty", F.round(tx.penalty(tx.normalize(F.coalesce("candidate", F.lit("")))), 9))
    return se.global_medoid_mode(nodes.select("problem_id", "candidate_index", "length", "penalty"), _bleu(s, d), digits=9, **kw).withColumn("cohesion", F.round("cohesion", 7))


@query("OP-146_global_medoid_mode", f"WITH {_CENT}, {_MEDOID}, {_POOL} SELECT mr.problem_id, candidate_index AS chosen_index, centrality, round(centrality - nx, 9) AS gap, size, coalesce(cohesion, 1.0) AS cohesion FROM mr JOIN gc USING (problem_id) WHERE r = 1")
def _(s, d):
    return r9(_global_mode(s, d)).select("problem_id", "chosen_index", "centrality", "gap", "size", "cohesion")


@query("OP-146_global_medoid_simple", f"WITH {_CENT}, {_MEDOID}, {_POOL}, ft AS (SELECT problem_id, candidate_index, {fx.sql_features('norm')} FROM s4), tk AS (SELECT mr.*, round(n_chars / 100.0::DOUBLE + n_binders + n_prop, 9) AS pen, max(centrality) OVER (PARTITION BY problem_id) AS top FROM mr JOIN ft USING (problem_id, candidate_index) WHERE r <= 3) SELECT problem_id, arg_min(candidate_index, (pen, -centrality, len, candidate_index)) AS chosen_index, any_value(size) AS size, coalesce(any_value(cohesion), 1.0) AS cohesion FROM tk JOIN gc USING (problem_id) WHERE round(top - centrality, 12) <= 0.05 GROUP BY 1")
def _(s, d):
    return _global_mode(s, d, simple_k=3, max_drop=0.05).select("problem_id", "chosen_index", "size", "cohesion")


@query("OP-147_fallback", f"WITH {VEC}, {_COS}, {_EDGES}, {_COMPS}, {_COMPSTAT}, {_REP} SELECT problem_id, CASE WHEN size < 3 OR cohesion < 0.1 THEN 0 ELSE chosen_index END AS chosen_index, chosen_index AS primary_index, CASE WHEN size < 3 OR cohesion < 0.1 THEN 'first' END AS fallback_used FROM rep")
def _(s, d):
    return se.with_fallback(_cluster_choice(s, d)[0], se.first_candidate(_nodes(s, d)), min_size=3, min_cohesion=0.1, name="first").select("problem_id", "chosen_index", "primary_index", "fallback_used")


#: Clusters of turns by token overlap, which stands in for a critic's scores.
_JT = 0.15
_CONV_REP = f"{_BLEU_DIR}, {_JAC}, vc AS (SELECT problem_id, candidate_index FROM cc), cosp AS (SELECT problem_id, i, j, round(score, 9) AS score FROM jj), {_EDGES.replace(f'>= {_T}', f'>= {_JT}')}, {_COMPS}, {_COMPSTAT}, {_REP}"
_FALL = {
    "bleu_medoid": "SELECT problem_id, node, score FROM bd",
    "critic_medoid": "SELECT problem_id, node, score FROM din",
    "critic_knn_medoid": "SELECT problem_id, node, score FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, node ORDER BY score DESC, other) AS r FROM din) WHERE r <= 3",
}


def _conv_cluster_choice(s, d, sim):
    c, _stats = graph.ranked_components(_conv_nodes(s, d).select("problem_id", "candidate_index"), sim, _JT)
    top = r9(c)
    p = se.representatives(top, _conv_nodes(s, d).select("problem_id", "candidate_index").withColumn("length", F.lit(0)), sim)
    return r9(p).join(top.filter("rank = 1").select("problem_id", "size", "cohesion"), "problem_id")


for _fall, _from in _FALL.items():
    @query(f"OP-147_fallback_{_fall}", f"WITH {_CONV_REP}, fd AS ({_from}), fc AS (SELECT s4.problem_id, s4.candidate_index, length(norm) AS len, round(coalesce(avg(score), 1), 9) AS c FROM s4 LEFT JOIN fd ON fd.problem_id = s4.problem_id AND fd.node = s4.candidate_index GROUP BY 1, 2, 3), fb AS (SELECT problem_id, arg_max(candidate_index, (c, -len, -candidate_index)) AS f FROM fc GROUP BY 1) SELECT problem_id, CASE WHEN size < 3 OR cohesion < 0.2 THEN f ELSE chosen_index END AS chosen_index, chosen_index AS primary_index, CASE WHEN size < 3 OR cohesion < 0.2 THEN '{_fall}' END AS fallback_used FROM rep JOIN fb USING (problem_id)")
    def _(s, d, name=_fall):
        sim = r9(pr.jaccard_pairs(fx.conv_candidates(s, d)))
        f = se.fallback_choice(name, _conv_nodes(s, d).select("problem_id", "candidate_index", "length"), sim, _bleu(s, d), digits=9)
        return se.with_fallback(_conv_cluster_choice(s, d, sim), f, min_size=3, min_cohesion=0.2, name=name).select("problem_id", "chosen_index", "primary_index", "fallback_used")


_LISTS = """pl AS (SELECT problem_id, candidate_index, min(o) AS o FROM (SELECT problem_id, candidate_index, (0, 0) AS o FROM (SELECT problem_id, arg_max(candidate_index, (score_a, -candidate_index)) AS candidate_index FROM lc GROUP BY 1)
  UNION ALL SELECT problem_id, candidate_index, (1, row_number() OVER (PARTITION BY problem_id ORDER BY score_b DESC, candidate_index)) FROM lc UNION ALL SELECT problem_id, candidate_index, (2, candidate_index) FROM lc) GROUP BY 1, 2),
lists AS (SELECT problem_id, list(candidate_index ORDER BY r) AS chosen_indices FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY o, candidate_index) AS r FROM pl) WHERE r <= 3 GROUP BY 1)"""


def _lists(s, d):
    c = fx.line_candidates(s, d)
    ranked = ev.with_rank(c.withColumn("score", F.col("score_b"))).select("problem_id", "candidate_index", F.col("rank").alias("place"))
    return se.top_k_list(se.arg_max(fx.scored_lines(s, d)), ranked, c, 3)


@query("OP-148_top_k_list", f"WITH {LINE}, {_LISTS} SELECT problem_id, array_to_string(chosen_indices, ',') AS chosen_indices FROM lists")
def _(s, d):
    return _lists(s, d).select("problem_id", F.array_join(F.transform("chosen_indices", lambda x: x.cast("string")), ",").alias("chosen_indices"))


def _votes(s, d):
    c, a, b = fx.line_candidates(s, d), se.arg_max(fx.scored_lines(s, d)), se.arg_max(fx.scored_lines(s, d, "score_b"))
    f = se.first_candidate(c)
    one = lambda df, name, size: df.select("problem_id", F.lit(name).alias("member"), "chosen_index", F.lit(size).alias("size"), F.lit(0.5).alias("cohesion"), F.lit(None).cast("double").alias("centrality"))
    return one(a, "a", 2).unionByName(one(b, "b", 3)).unionByName(one(f, "f", 1)), c.withColumn("length", F.col("candidate_index") % 3)


for _how, _w in (("weighted", "greatest(1, size) * 0.5::DOUBLE"), ("majority", "1.0::DOUBLE")):
    query(f"OP-149_vote_{_how}", f"WITH {LINE}, v AS (SELECT problem_id, arg_max(candidate_index, (score_a, -candidate_index)) AS chosen_index, 2 AS size FROM lc GROUP BY 1 UNION ALL SELECT problem_id, arg_max(candidate_index, (score_b, -candidate_index)), 3 FROM lc GROUP BY 1 UNION ALL SELECT problem_id, 0, 1 FROM lc GROUP BY 1), t AS (SELECT problem_id, chosen_index, sum({_w}) AS weight, count(*) AS votes FROM v GROUP BY 1, 2) SELECT problem_id, chosen_index, weight, votes FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY weight DESC, votes DESC, chosen_index % 3, chosen_index) AS r FROM t) WHERE r = 1")(
        lambda s, d, how=_how: se.vote(*_votes(s, d), how))


@query("OP-150_arg_max", f"WITH {LINE}, {_ARGMAX} SELECT problem_id, chosen_index, score FROM pick")
def _(s, d):
    return se.arg_max(fx.scored_lines(s, d))


@query("OP-150_arg_min_of_mean", f"WITH {LINE}, m AS (SELECT problem_id, candidate_index, (score_a + score_b) / 2 AS score FROM lc) SELECT problem_id, arg_min(candidate_index, (score, candidate_index)) AS chosen_index, min(score) AS score FROM m GROUP BY 1")
def _(s, d):
    two = fx.scored_lines(s, d).select("problem_id", "candidate_index", "score").unionByName(fx.scored_lines(s, d, "score_b").select("problem_id", "candidate_index", "score"))
    return se.arg_max(se.mean_scores(two), minimize=True)


_EX_COLS = "problem_id, chosen_index, chosen_score, round(chosen_probability, 9) AS chosen_probability, runner_up_index, runner_up_score, score_margin, round(probability_margin, 9) AS probability_margin, n_candidates"


@query("OP-151_confidence", f"WITH {LINE}, {_EXAMPLES} SELECT {_EX_COLS} FROM ex")
def _(s, d):
    return r9(_examples(s, d)).select("problem_id", "chosen_index", "chosen_score", "chosen_probability", "runner_up_index", "runner_up_score", "score_margin", "probability_margin", "n_candidates")


@query("OP-152_typecheck_stats", f"WITH {LINE}, {_EXAMPLES}, x AS (SELECT problem_id, arg_max(typechecks, (score_a, -candidate_index)) AS top1, max(typechecks) AS any_tc FROM lc GROUP BY 1) SELECT count(*) AS problems, count(*) FILTER (top1) AS top1_ok, round(count(*) FILTER (top1) / count(*)::DOUBLE, 9) AS top1_rate, count(*) FILTER (NOT top1 AND any_tc) AS rescued, count(*) FILTER (NOT any_tc) AS no_survivors, round(avg(chosen_probability), 9) AS mean_chosen_probability, round(avg(probability_margin), 9) AS mean_probability_margin FROM x JOIN ex USING (problem_id)")
def _(s, d):
    return r9(ev.typecheck_stats(fx.scored_lines(s, d), _examples(s, d)))


_CLUSTERS = "rl AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score_a DESC, candidate_index) AS rank, part % 3 AS component FROM lc), tm AS (SELECT * FROM rl WHERE rank <= 6), sl AS (SELECT problem_id, component, list(score_a ORDER BY score_a DESC) AS s, count(*) AS size, min(rank)::INTEGER AS best_rank FROM tm GROUP BY 1, 2)"
for _mode, _expr in (("max", "s[1]"), ("mean_top2", "list_avg(s[1:2])"), ("mean_topk", "list_avg(s[1:3])"), ("logsumexp", "s[1] + ln(list_sum(list_transform(s, lambda x: exp(x - s[1]))))")):
    query(f"OP-153_cluster_{_mode}", f"WITH {LINE}, {_CLUSTERS} SELECT problem_id, component, round({_expr}, 9) AS cluster_score, size, best_rank FROM sl")(
        lambda s, d, mode=_mode: r9(se.cluster_score(ev.with_rank(fx.scored_lines(s, d)).filter("rank <= 6").withColumn("component", F.col("part") % 3), mode)))


def _judged(s, d):
    """Conversations with a stand-in for a verifier's score, and their similarities."""
    c = fx.conv_candidates(s, d).withColumn("score", F.length(F.coalesce("candidate", F.lit(""))) * 37 % 97 / F.lit(97.0))
    return c, r9(pr.jaccard_pairs(fx.conv_candidates(s, d)))


_VC = f"""{_JAC}, {fx.sql_steps('cc', 'problem_id, candidate_index', chr(99) + 'oalesce(candidate, ' + chr(39) * 2 + ')')}, sc AS (SELECT problem_id, candidate_index, length(coalesce(candidate, '')) * 37 % 97 / 97.0::DOUBLE AS score FROM cc),
rk AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, candidate_index) AS rank FROM sc), tm AS (SELECT rk.*, rank - 1 AS place, length(norm) AS len, round(n_chars / 100.0::DOUBLE + 0.5 * n_binders + 0.25 * n_prop, 9) AS pen FROM rk JOIN (SELECT problem_id, candidate_index, norm, {fx.sql_features('norm')} FROM s4) f USING (problem_id, candidate_index) WHERE rank <= 20),
pd AS (SELECT jj.problem_id, a.place AS a, b.place AS b, round(jj.score, 9) AS score FROM jj JOIN tm a ON a.problem_id = jj.problem_id AND a.candidate_index = i JOIN tm b ON b.problem_id = jj.problem_id AND b.candidate_index = j),
pe AS (SELECT problem_id, a, b FROM pd WHERE score >= 0.1 UNION ALL SELECT problem_id, b, a FROM pd WHERE score >= 0.1),
wk AS (WITH RECURSIVE w(problem_id, place, reach) AS (SELECT problem_id, place, place FROM tm UNION SELECT w.problem_id, w.place, pe.b FROM w JOIN pe ON pe.problem_id = w.problem_id AND pe.a = w.reach) SELECT problem_id, place, min(reach) AS first FROM w GROUP BY 1, 2),
cl AS (SELECT problem_id, first, list_avg((list(score ORDER BY score DESC))[1:2]) AS cluster_score, count(*) AS size FROM wk JOIN tm USING (problem_id, place) GROUP BY 1, 2),
bc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY cluster_score DESC, size DESC, first) AS r FROM cl) WHERE r = 1),
co AS (SELECT pd.problem_id, round(avg(score), 9) AS cohesion FROM pd JOIN bc ON bc.problem_id = pd.problem_id JOIN wk x ON x.problem_id = pd.problem_id AND x.place = pd.a AND x.first = bc.first JOIN wk y ON y.problem_id = pd.problem_id AND y.place = pd.b AND y.first = bc.first GROUP BY 1),
ins AS (SELECT tm.*, cluster_score, size, max(score) OVER (PARTITION BY problem_id) AS top FROM tm JOIN wk USING (problem_id, place) JOIN bc USING (problem_id, first))"""
for _rep, _pick in (("best", "SELECT problem_id, arg_min(candidate_index, rank) AS chosen_index, arg_min(score, rank) AS score, any_value(cluster_score) AS cluster_score, any_value(size) AS size FROM ins GROUP BY 1"),
                    ("simple", "SELECT problem_id, arg_min(candidate_index, (pen, -score, len, candidate_index)) AS chosen_index, arg_min(score, (pen, -score, len, candidate_index)) AS score, any_value(cluster_score) AS cluster_score, any_value(size) AS size FROM ins WHERE score >= top - 0.3 GROUP BY 1")):
    @query(f"OP-153_choice_{_rep}", f"WITH {CONV}, {_VC}, pk AS ({_pick}) SELECT problem_id, chosen_index, round(score, 9) AS score, round(cluster_score, 9) AS cluster_score, size, coalesce(cohesion, 1.0) AS cohesion FROM pk LEFT JOIN co USING (problem_id)")
    def _(s, d, rep=_rep):
        return r9(se.verifier_choice(*_judged(s, d), 0.1, rep=rep, delta=0.3))


@query("OP-154_random", f"WITH {LINE}, n AS (SELECT problem_id, count(*) AS n FROM lc GROUP BY 1) SELECT problem_id, (('0x' || left(sha256('123:' || problem_id), 15))::BIGINT % n)::INTEGER AS chosen_index FROM n")
def _(s, d):
    return se.random_choice(fx.line_candidates(s, d), 123)


@query("OP-155_first_and_shortest", f"WITH {DOC}, {fx.sql_steps('dc', 'problem_id, candidate_index', 'candidate')} SELECT problem_id, min(candidate_index) AS first_index, arg_min(candidate_index, (length(norm), candidate_index)) AS shortest_index FROM s4 GROUP BY 1")
def _(s, d):
    return se.first_and_shortest(fx.doc_candidates(s, d, se.statement_length("text")), "candidate")


def _audit(s, d):
    c = fx.vec_candidates(s, d).withColumn("candidate", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    comps, _stats = graph.ranked_components(_nodes(s, d), _cos(s, d), _T)
    return se.audit(c, r9(comps), _cos(s, d))


_AUDIT_RANK = "ak AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY size DESC, cohesion DESC, component) AS rank FROM cst)"


@query("OP-156_audit_components", f"WITH {VEC}, {_COS}, {_EDGES}, {_COMPS}, {_COMPSTAT}, {_AUDIT_RANK} SELECT problem_id, rank::INTEGER AS rank, array_to_string(indices, ',') AS indices, size::INTEGER AS size, cohesion, (SELECT sum(vc.label)::BIGINT FROM vc WHERE vc.problem_id = ak.problem_id AND list_contains(ak.indices, vc.candidate_index)) AS n_labeled_correct FROM ak WHERE rank <= 3")
def _(s, d):
    x = _audit(s, d).select("problem_id", F.explode("components").alias("c")).select("problem_id", "c.*")
    return x.select("problem_id", "rank", F.array_join(F.transform("indices", lambda v: v.cast("string")), ",").alias("indices"), "size", "cohesion", "n_labeled_correct")


@query("OP-156_audit_edges", f"WITH {VEC}, {_COS} SELECT problem_id, r::INTEGER AS r, i, j, score FROM (SELECT problem_id, i, j, round(score, 9) AS score, row_number() OVER (PARTITION BY problem_id ORDER BY round(score, 9) DESC, i, j) AS r FROM cosp) WHERE r <= 5")
def _(s, d):
    return r9(_audit(s, d).select("problem_id", F.explode("top_edges").alias("e")).select("problem_id", "e.*"))


@query("OP-156_audit")
def _(s, d):
    return _audit(s, d).select("problem_id", F.to_json("components").alias("components"), F.to_json("top_edges").alias("top_edges"), F.to_json("candidates").alias("candidates"))


# --- ranking and windows ---------------------------------------------------------------------------------------------------------

_RANKED = "rk AS (SELECT *, (row_number() OVER (PARTITION BY problem_id ORDER BY score_a DESC, candidate_index))::INTEGER AS rank FROM lc)"


def _ranked(s, d):
    return ev.with_rank(fx.scored_lines(s, d))


@query("OP-160_rank", f"WITH {LINE}, {_RANKED} SELECT problem_id, candidate_index, rank FROM rk")
def _(s, d):
    return _ranked(s, d).select("problem_id", "candidate_index", "rank")


@query("OP-161_tie_ranks", f"WITH {LINE}, t AS (SELECT score_a AS score, rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2.0 AS r FROM lc) SELECT score, count(*) AS n_peers, max(r)::DOUBLE AS avg_rank FROM t GROUP BY 1")
def _(s, d):
    return ev.tie_ranks(fx.scored_lines(s, d)).select("score", "n_peers", F.col("avg_rank").cast("double").alias("avg_rank"))


_CURVE = f"""cf AS (SELECT *, round(coalesce(chosen_probability, 0), 12) AS confidence FROM ex),
cv AS (SELECT problem_id, selected_correct, has_any_correct, confidence AS threshold, row_number() OVER o AS accepted, (sum(selected_correct) OVER o)::BIGINT AS correct, count(*) OVER () AS n FROM cf WINDOW o AS (ORDER BY confidence DESC, problem_id ROWS UNBOUNDED PRECEDING)),
cw AS (SELECT *, correct / accepted::DOUBLE AS accuracy, {W('correct', 'accepted', 'low')} AS low, {W('correct', 'accepted', 'high')} AS high FROM cv)"""


def _curve(s, d):
    return sv.prefix_curve(sv.with_confidence(_examples(s, d), "chosen_probability"))


@query("OP-162_running_correct", f"WITH {LINE}, {_EXAMPLES}, {_CURVE} SELECT problem_id, accepted, correct, round(accuracy, 9) AS accuracy, round(threshold, 9) AS threshold FROM cw")
def _(s, d):
    return r9(_curve(s, d)).select("problem_id", F.col("accepted").cast("long").alias("accepted"), "correct", "accuracy", "threshold")


@query("OP-163_running_wilson", f"WITH {LINE}, {_EXAMPLES}, {_CURVE} SELECT accepted, round(low, 9) AS low, round(high, 9) AS high FROM cw")
def _(s, d):
    return r9(_curve(s, d)).select(F.col("accepted").cast("long").alias("accepted"), "low", "high")


_AP = "SELECT round(sum(accuracy) FILTER (selected_correct = 1) / max(correct), 9) AS average_precision FROM cw"


@query("OP-164_average_precision", f"WITH {LINE}, {_EXAMPLES}, {_CURVE} {_AP}")
def _(s, d):
    return r9(sv.ranking_quality(_curve(s, d)).select("average_precision"))


_AREAS = """tot AS (SELECT max(n) AS n, max(correct) AS pos FROM cw), ideal AS (SELECT avg(least(accepted, pos) / accepted::DOUBLE) AS ideal_area, avg(greatest(0, accepted - (tot.n - pos)) / accepted::DOUBLE) AS worst_area FROM cw, tot)"""


@query("OP-165_ideal_areas", f"WITH {LINE}, {_EXAMPLES}, {_CURVE}, {_AREAS} SELECT round(ideal_area, 9) AS ideal_area, round(worst_area, 9) AS worst_area FROM ideal")
def _(s, d):
    return r9(sv.ranking_quality(_curve(s, d)).select("ideal_area", "worst_area"))


@query("OP-166_first_hit", f"WITH {LINE}, {_RANKED} SELECT problem_id, min(rank) FILTER (label = 1) AS first_hit FROM rk GROUP BY 1")
def _(s, d):
    return _ranked(s, d).groupBy("problem_id").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("first_hit"))


@query("OP-167_tertiles", "WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT max(v) FILTER (r = n // 3) AS lo, max(v) FILTER (r = 2 * n // 3) AS hi FROM o")
def _(s, d):
    return ev.tertile_bounds(fx.table(s, d, "orders"), "o_totalprice")


@query("OP-168_upper_median", "WITH o AS (SELECT o_orderpriority AS grp, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT grp, v AS median FROM o WHERE r = n // 2")
def _(s, d):
    return ev.upper_median(fx.table(s, d, "orders").select(F.col("o_orderpriority").alias("grp"), "o_totalprice"), "grp", "o_totalprice")


# --- evaluation ------------------------------------------------------------------------------------------------------------------


@query("OP-170_wilson", f"WITH {LINE}, g AS (SELECT problem_id, sum(label)::BIGINT AS k, count(*) AS n FROM lc GROUP BY 1) SELECT problem_id, round({W('k', 'n', 'low')}, 9) AS low, round({W('k', 'n', 'high')}, 9) AS high FROM g")
def _(s, d):
    g = fx.line_candidates(s, d).groupBy("problem_id").agg(F.sum("label").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = st.wilson(F.col("k"), F.col("n"))
    return r9(g.select("problem_id", low.alias("low"), high.alias("high")))


@query("OP-171_sign_test", f"WITH {LINE}, g AS (SELECT part, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM lc GROUP BY 1) SELECT part, a, b, round({fx.sql_sign_test('a', 'b')}, 9) AS p_value FROM g")
def _(s, d):
    g = fx.line_candidates(s, d).groupBy("part").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    return r9(g.withColumn("p_value", st.sign_test(F.col("a"), F.col("b"))))


_TWO = "two AS (SELECT problem_id, arg_max(label, (score_a, -candidate_index)) AS a, arg_max(label, (score_b, -candidate_index)) AS b FROM lc GROUP BY 1), ct AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS both_correct, count(*) FILTER (a = 1 AND b = 0) AS a_only, count(*) FILTER (a = 0 AND b = 1) AS b_only, count(*) FILTER (a = 0 AND b = 0) AS neither, count(*) AS problems FROM two)"


def _correct(s, d, score):
    c = fx.scored_lines(s, d, score)
    return ev.label_at(se.arg_max(c), c, name="correct").select("problem_id", "correct")


@query("OP-172_paired", f"WITH {LINE}, {_TWO} SELECT both_correct, a_only, b_only, neither, problems, a_only + b_only AS discordant, round((b_only - a_only) / problems::DOUBLE, 9) AS b_minus_a, round({fx.sql_sign_test('a_only', 'b_only')}, 9) AS p_value FROM ct")
def _(s, d):
    return r9(ev.paired(_correct(s, d, "score_a"), _correct(s, d, "score_b")))


_EVAL = f"""dz AS (SELECT a.problem_id, any_correct, first_correct, CASE WHEN sel.problem_id IS NULL THEN true ELSE coalesce(abstained, false) OR coalesce(NOT accepted, false) END AS ab, sel.problem_id IS NULL AS miss, lc.label AS ok
  FROM (SELECT problem_id, max(label) AS any_correct, max(label) FILTER (candidate_index = 0) AS first_correct FROM lc GROUP BY 1) a LEFT JOIN sel USING (problem_id) LEFT JOIN lc ON lc.problem_id = sel.problem_id AND lc.candidate_index = sel.chosen_index),
en AS (SELECT count(*) AS problems, count(*) FILTER (NOT ab) AS accepted, count(*) FILTER (ab) AS abstained, count(*) FILTER (ab AND NOT miss) AS explicit_abstained, count(*) FILTER (miss) AS missing_as_abstained, count(*) FILTER (any_correct = 1) AS has_any, count(*) FILTER (NOT ab AND any_correct = 1) AS accepted_any,
  count(*) FILTER (NOT ab AND ok = 1) AS accepted_correct, count(*) FILTER (NOT ab AND ok = 1 AND any_correct = 1) AS accepted_correct_any, count(*) FILTER (ab AND any_correct = 1) AS abstained_any, count(*) FILTER (ab AND ok IS NOT NULL) AS abstained_with_choice, count(*) FILTER (ab AND ok = 1) AS abstained_correct, count(*) FILTER (first_correct = 1) AS first_correct FROM dz)"""


def _prop_sql(k, n, name):
    return f"round({R(k, n)}, 9) AS {name}_rate, round({W(k, n, 'low')}, 9) AS {name}_low, round({W(k, n, 'high')}, 9) AS {name}_high"


@query("OP-173_evaluate", f"WITH {LINE}, {_SELS}, {_EVAL} SELECT *, {_prop_sql('accepted', 'problems', 'coverage')}, {_prop_sql('has_any', 'problems', 'has_any')}, {_prop_sql('accepted_correct', 'accepted', 'selected')}, {_prop_sql('accepted_correct_any', 'accepted_any', 'selected_given_any')}, {_prop_sql('accepted_correct', 'problems', 'counting_abstentions_incorrect')}, {_prop_sql('(accepted_correct + abstained_correct)', '(accepted + abstained_with_choice)', 'with_abstention_choices')}, {_prop_sql('abstained_any', 'abstained', 'abstained_has_any')}, {_prop_sql('first_correct', 'problems', 'first')} FROM en")
def evaluate(s, d):
    return r9(ev.evaluate(ev.decisions(fx.line_candidates(s, d), _selections(s, d), missing_as_abstain=True)))


@query("OP-174_topk_any_correct", f"WITH {LINE}, {_LISTS}, h AS (SELECT l.problem_id, min(list_position(chosen_indices, candidate_index)) FILTER (label = 1) AS f FROM lists l JOIN lc USING (problem_id) WHERE list_contains(chosen_indices, candidate_index) GROUP BY 1) SELECT k::INTEGER AS k, count(*) FILTER (f <= k) AS hits, count(*) AS problems FROM h, range(1, 4) t(k) GROUP BY 1")
def _(s, d):
    return ev.topk_any_correct(_lists(s, d), fx.line_candidates(s, d), 3)


@query("OP-175_optional_averages", f"WITH {LINE}, {_EXAMPLES} SELECT round(avg(score_margin), 9) AS score_margin, round(avg(runner_up_score), 9) AS runner_up_score, count(score_margin) AS n FROM ex")
def _(s, d):
    return r9(_examples(s, d).agg(F.avg("score_margin").alias("score_margin"), F.avg("runner_up_score").alias("runner_up_score"), F.count("score_margin").alias("n")))


_TIMES = [("select_a_seconds", 1.5), ("select_b_seconds", 2.25), ("other", 9.0)]


def _ab_metrics(s, d):
    t = s.createDataFrame(_TIMES, "name string, value double")
    return ev.ab_metrics(fx.line_candidates(s, d), _correct(s, d, "score_a"), _correct(s, d, "score_b"), t)


@query("OP-176_ab_metrics", f"WITH {LINE}, {_TWO}, n AS (SELECT problem_id, count(*) AS n, max(label) AS anyc FROM lc GROUP BY 1), j AS (SELECT * FROM two JOIN n USING (problem_id)), m AS (SELECT count(*) AS problems, count(*) FILTER (anyc = 1) AS with_any, avg(n) AS cpp, sum(n * (n - 1) // 2)::BIGINT AS total_pairs, 100 * avg(a) AS a_pct, 100 * avg(b) AS b_pct, 100 * avg(a) FILTER (anyc = 1) AS ag, 100 * avg(b) FILTER (anyc = 1) AS bg FROM j) SELECT problems, with_any, round(100 * with_any / problems::DOUBLE, 9) AS with_any_pct, round(cpp, 9) AS candidates_per_problem, total_pairs, round(a_pct, 9) AS a_pct, round(b_pct, 9) AS b_pct, round(ag, 9) AS a_given_any_pct, round(bg, 9) AS b_given_any_pct, round(b_pct - a_pct, 9) AS b_minus_a_pct, round(bg - ag, 9) AS b_minus_a_given_any_pct, 1.5::DOUBLE AS a_seconds, 2.25::DOUBLE AS b_seconds FROM m")
def _(s, d):
    return r9(_ab_metrics(s, d))


@query("OP-177_selection_summary", f"WITH {LINE}, {_SELS}, {_EVAL} SELECT problems, has_any, accepted_correct, round(100.0 * accepted_correct / problems, 7) AS pct, round(100.0 * first_correct / problems, 7) AS first_pct FROM en")
def _(s, d):
    e = ev.evaluate(ev.decisions(fx.line_candidates(s, d), _selections(s, d), missing_as_abstain=True))
    return e.select("problems", "has_any", "accepted_correct", F.round(100.0 * F.col("accepted_correct") / F.col("problems"), 7).alias("pct"), F.round(100.0 * F.col("first_correct") / F.col("problems"), 7).alias("first_pct"))


@query("OP-178_pairwise_wins", f"WITH {LINE}, {_TWO} SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties FROM two")
def _(s, d):
    return leaderboard.pairwise_wins(_correct(s, d, "score_a"), _correct(s, d, "score_b"))


@query("OP-179_ab_contingency", f"WITH {LINE}, {_TWO} SELECT a::BOOLEAN AS a_ok, b::BOOLEAN AS b_ok, count(*) AS n FROM two GROUP BY 1, 2")
def _(s, d):
    j = _correct(s, d, "score_a").withColumnRenamed("correct", "a").join(_correct(s, d, "score_b").withColumnRenamed("correct", "b"), "problem_id")
    return j.groupBy((F.col("a") == 1).alias("a_ok"), (F.col("b") == 1).alias("b_ok")).agg(F.count(F.lit(1)).alias("n"))


@query("OP-180_cross_tab", f"WITH {LINE} SELECT label, typechecks, count(*) AS n, round(avg(score_a), 9) AS mean_value FROM lc GROUP BY 1, 2")
def _(s, d):
    return r9(leaderboard.cross_tab(fx.line_candidates(s, d), "label", "typechecks", "score_a"))


@query("OP-181_oracle_pool", f"WITH {LINE}, {_ARGMAX}, p AS (SELECT lc.problem_id, max(typechecks) AS any_hit, max(typechecks AND candidate_index = chosen_index) AS sel_hit, max(candidate_index = chosen_index) AS in_pool FROM lc JOIN pick USING (problem_id) GROUP BY 1) SELECT count(*) AS problems, count(*) FILTER (any_hit) AS oracle, count(*) FILTER (sel_hit) AS selected, count(*) FILTER (any_hit) - count(*) FILTER (sel_hit) AS gap, count(*) FILTER (NOT in_pool) AS missing_from_pool FROM p")
def _(s, d):
    c = fx.scored_lines(s, d)
    j = c.join(se.arg_max(c).select("problem_id", "chosen_index"), "problem_id")
    return leaderboard.oracle_pool(j.select("problem_id", F.col("typechecks").alias("hit"), (F.col("candidate_index") == F.col("chosen_index")).alias("selected")))


_GRID = [(0, 1.0, 0.0), (1, 0.75, 0.25), (2, 0.5, 0.5), (3, 0.25, 0.75), (4, 0.0, 1.0), (5, -1.0, 0.5)]
_GRID_SQL = f"cfg AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b}::DOUBLE, {c}::DOUBLE)' for a, b, c in _GRID)}) t(config, wa, wb)), gp AS (SELECT config, problem_id, arg_max(label, (wa * score_a + wb * score_b, -candidate_index)) AS correct, max(label) AS any_correct FROM lc, cfg GROUP BY 1, 2), gr AS (SELECT config, count(*) AS problems, sum(correct)::BIGINT AS n_correct, sum(any_correct)::BIGINT AS n_any FROM gp GROUP BY 1)"


def _grid(s, d):
    return leaderboard.grid(fx.line_candidates(s, d), s.createDataFrame(_GRID, "config int, wa double, wb double"))


@query("OP-182_strategy_grid", f"WITH {LINE}, {_GRID_SQL} SELECT *, round(n_correct / problems::DOUBLE, 9) AS accuracy, round(n_correct / n_any::DOUBLE, 9) AS accuracy_given_any FROM gr")
def _(s, d):
    return r9(_grid(s, d))


@query("OP-183_bucketed_accuracy", f"WITH {LINE}, {_EXAMPLES}, b AS (SELECT CASE WHEN score_margin <= 0.5 THEN 0.5 WHEN score_margin <= 2 THEN 2.0 ELSE 5.0 END::DOUBLE AS bucket, selected_correct, has_any_correct FROM ex WHERE score_margin IS NOT NULL) SELECT bucket, count(*) AS problems, sum(selected_correct)::BIGINT AS correct, sum(has_any_correct)::BIGINT AS with_any, round(avg(selected_correct), 9) AS accuracy, round({R('sum(selected_correct)', 'sum(has_any_correct)')}, 9) AS accuracy_given_any FROM b GROUP BY 1")
def _(s, d):
    e = _examples(s, d).withColumnRenamed("selected_correct", "chosen_correct").withColumnRenamed("has_any_correct", "any_correct")
    return r9(ev.bucketed(e, "score_margin", [0.5, 2.0, 5.0]))


@query("OP-184_top_strategies", f"WITH {LINE}, {_GRID_SQL} SELECT config, n_correct FROM gr ORDER BY n_correct DESC, config LIMIT 3")
def _(s, d):
    return leaderboard.top_configs(_grid(s, d), 3).select("config", "n_correct")


_CONFIGS = [(t, tie, rank, k, m, 0.7) for t in (0.1, 0.3) for tie in ("medoid", "shortest") for rank in ("size_then_cohesion", "cohesion") for k in (0, 2) for m in (0.0, 0.1)]
_GRAPHS = list(dict.fromkeys((c[0], c[3], c[4]) for c in _CONFIGS))
_BOUNDS = {"length": [60, 200], "candidates": [4, 6], "component": [1, 3]}


def _choice_sql(vote: str) -> str:
    """al: what each configuration, baseline and the ensemble chooses. A problem of a graph is 100 * problem + graph, so that the graph queries' steps hold."""
    rows = lambda cols, values: "(VALUES " + ", ".join("(" + ", ".join(map(str, v)) + ")" for v in values) + f") v({cols})"
    graphs = rows("g, thr, mk, mg", [(n, f"{t}::DOUBLE", k, f"{m}::DOUBLE") for n, (t, k, m) in enumerate(_GRAPHS)])
    configs = rows("config, g, tie, rk", [(n, _GRAPHS.index((c[0], c[3], c[4])), f"'{c[1]}'", f"'{c[2]}'") for n, c in enumerate(_CONFIGS)])
    keys = {"size_then_cohesion": "size DESC, cohesion DESC", "cohesion": "cohesion DESC, size DESC"}
    tops = " UNION ALL ".join(f"SELECT *, '{k}' AS rk, row_number() OVER (PARTITION BY problem_id ORDER BY {o}, component) AS r FROM cst" for k, o in keys.items())
    central = lambda name, rel: f"{name} AS (SELECT problem_id, candidate_index AS chosen_index, c AS centrality FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY c DESC, len, candidate_index) AS r FROM (SELECT nd.problem_id, nd.candidate_index, len, round(coalesce(avg(x.score), 1), 9) AS c FROM nd LEFT JOIN {rel} x ON x.problem_id = nd.problem_id AND x.node = nd.candidate_index GROUP BY 1, 2, 3)) WHERE r = 1)"
    weight = "greatest(1, size) * cohesion * coalesce(centrality, 1)"
    one = lambda name, rel, cent="NULL": f"SELECT problem_id, '{name}', NULL, chosen_index, 1, NULL, {cent} FROM {rel}"
    return f"""{_BLEU_DIR}, {_JAC}, ft AS (SELECT problem_id, candidate_index, {fx.sql_features('norm')} FROM s4),
nd AS (SELECT s4.problem_id, s4.candidate_index, length(norm) AS len, label, round(n_chars / 100.0::DOUBLE + n_binders + n_prop, 9) AS pen, norm FROM s4 JOIN cc USING (problem_id, candidate_index) JOIN ft USING (problem_id, candidate_index)),
sim AS (SELECT problem_id, i, j, round(score, 9) AS score FROM jj), sd AS (SELECT problem_id, i AS node, j AS other, score FROM sim UNION ALL SELECT problem_id, j, i, score FROM sim),
sr AS (SELECT *, row_number() OVER (PARTITION BY problem_id, node ORDER BY score DESC, other) AS r FROM sd), wr AS (SELECT problem_id, least(node, other) AS i, greatest(node, other) AS j, max(score) AS score, max(r) AS worst FROM sr GROUP BY 1, 2, 3),
gr AS (SELECT * FROM {graphs}), vc AS (SELECT problem_id * 100 + g AS problem_id, candidate_index FROM nd, gr), cosp AS (SELECT problem_id * 100 + g AS problem_id, i, j, score FROM sim, gr),
ed AS (SELECT problem_id * 100 + g AS problem_id, i, j, score FROM wr, gr WHERE score >= thr AND (mk = 0 OR worst <= mk)), bo AS (SELECT problem_id, i AS node, j AS other, score FROM ed UNION ALL SELECT problem_id, j, i, score FROM ed), {_TRI},
bad AS (SELECT tri.problem_id, centre, CASE WHEN s_i <= s_k THEN tri.i ELSE k END AS weak FROM tri JOIN cosp f ON f.problem_id = tri.problem_id AND f.i = tri.i AND f.j = tri.k JOIN gr ON g = tri.problem_id % 100 WHERE mg > 0 AND f.score < thr AND least(s_i, s_k) - f.score >= mg), drops AS (SELECT DISTINCT problem_id, least(centre, weak) AS i, greatest(centre, weak) AS j FROM bad), {_RESCUE},
ed2 AS (SELECT problem_id, i, j FROM kept UNION ALL SELECT problem_id, i, j FROM added), bo2 AS (SELECT problem_id, i AS node, j AS other FROM ed2 UNION ALL SELECT problem_id, j, i FROM ed2),
{_COMPS.replace('JOIN bo ON', 'JOIN bo2 ON').replace('bo.', 'bo2.')}, {_COMPSTAT}, tops AS ({tops}), mem AS (SELECT problem_id, rk, size, cohesion, unnest(indices) AS candidate_index FROM tops WHERE r = 1),
din AS (SELECT problem_id, i AS node, j AS other, score FROM cosp UNION ALL SELECT problem_id, j, i, score FROM cosp),
ct AS (SELECT m.problem_id, m.rk, m.size, m.cohesion, m.candidate_index, round(coalesce((sum(x.score::DECIMAL(18, 12))::DOUBLE / count(x.score))::DECIMAL(18, 12), 1), 9)::DOUBLE AS centrality FROM mem m LEFT JOIN (SELECT din.*, o.rk FROM din JOIN mem o ON o.problem_id = din.problem_id AND o.candidate_index = din.other) x ON x.problem_id = m.problem_id AND x.rk = m.rk AND x.node = m.candidate_index GROUP BY ALL),
cl AS (SELECT ct.*, len, pen, row_number() OVER w AS r, max(centrality) OVER (PARTITION BY ct.problem_id, rk) AS top FROM ct JOIN nd ON nd.problem_id = ct.problem_id // 100 AND nd.candidate_index = ct.candidate_index WINDOW w AS (PARTITION BY ct.problem_id, rk ORDER BY centrality DESC, len, ct.candidate_index)),
se AS (SELECT problem_id, rk, 'medoid' AS tie, any_value(size) AS size, any_value(cohesion) AS cohesion, arg_min(candidate_index, (pen, -centrality, len, candidate_index)) AS chosen_index, arg_min(centrality, (pen, -centrality, len, candidate_index)) AS centrality FROM cl WHERE r <= 3 AND top - centrality <= 0.05::DOUBLE GROUP BY 1, 2
  UNION ALL SELECT problem_id, rk, 'shortest', any_value(size), any_value(cohesion), arg_min(candidate_index, (len, candidate_index)), NULL FROM cl GROUP BY 1, 2),
cfg AS (SELECT * FROM {configs}), pk AS (SELECT se.problem_id // 100 AS problem_id, config, se.tie, chosen_index, size, cohesion, centrality FROM se JOIN cfg ON cfg.g = se.problem_id % 100 AND cfg.tie = se.tie AND cfg.rk = se.rk),
vo AS (SELECT problem_id, chosen_index, {f"round(sum({weight}), 9)" if vote == "weighted" else "count(*)"} AS weight, count(*) AS votes FROM pk WHERE tie = 'medoid' GROUP BY 1, 2),
vw AS (SELECT problem_id, arg_max(chosen_index, (weight, votes, -len, -chosen_index)) AS chosen_index FROM vo JOIN (SELECT problem_id, candidate_index AS chosen_index, len FROM nd) USING (problem_id, chosen_index) GROUP BY 1),
en AS (SELECT problem_id, chosen_index, arg_max({{'s': size, 'h': cohesion, 'c': centrality}}, (round({weight}, 9), -config)) AS b FROM pk JOIN vw USING (problem_id, chosen_index) WHERE tie = 'medoid' GROUP BY 1, 2),
{central("mbg", "sd")}, {central("mbk", "(SELECT * FROM sr WHERE r <= 3)")}, {central("blm", "bd")},
mj AS (SELECT problem_id, arg_max(f, (n, -len, -f)) AS chosen_index FROM (SELECT problem_id, norm, count(*) AS n, min(candidate_index) AS f, any_value(len) AS len FROM nd GROUP BY 1, 2) GROUP BY 1),
fi AS (SELECT problem_id, min(candidate_index) AS chosen_index, arg_min(candidate_index, (len, candidate_index)) AS sh, count(*) AS n FROM nd GROUP BY 1),
al(problem_id, strategy, config, chosen_index, size, cohesion, centrality) AS (SELECT problem_id, 'selection', config, chosen_index, size, cohesion, centrality FROM pk UNION ALL {one("first", "fi")} UNION ALL SELECT problem_id, 'shortest', NULL, sh, 1, NULL, NULL FROM fi UNION ALL {one("majority", "mj")}
  UNION ALL SELECT problem_id, 'random', NULL, (('0x' || left(sha256('123:' || problem_id), 15))::BIGINT % n), 1, NULL, NULL FROM fi UNION ALL {one("bleu_medoid", "blm", "centrality")} UNION ALL {one("mbr_global", "mbg", "centrality")} UNION ALL {one("mbr_knn", "mbk", "centrality")} UNION ALL SELECT problem_id, 'ensemble', NULL, chosen_index, b.s, b.h, b.c FROM en),
pr AS (SELECT problem_id, max(label) AS any_correct, count(*) AS candidates, max(len) FILTER (candidate_index = 0) AS length FROM nd GROUP BY 1), jn AS (SELECT al.*, label, any_correct, candidates, length FROM al JOIN pr USING (problem_id) JOIN nd ON nd.problem_id = al.problem_id AND nd.candidate_index = al.chosen_index)"""


_MEAN = "round((sum(({0})::DECIMAL(18, 12))::DOUBLE / count({0}))::DECIMAL(18, 12), 9)::DOUBLE"
_SUMS = f"count(*) AS problems, sum(label)::BIGINT AS n_correct, sum(any_correct)::BIGINT AS n_any, round({R('sum(label)', 'count(*)')}, 9) AS accuracy, round({R('sum(label)', 'sum(any_correct)')}, 9) AS accuracy_given_any, round(avg(size), 9) AS avg_size, {_MEAN.format('cohesion')} AS avg_cohesion, {_MEAN.format('coalesce(centrality, 0)')} AS avg_centrality"
_NAMED = "nm AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {c[0]}::DOUBLE, '{c[1]}', '{c[2]}', {c[3]}, {c[4]}::DOUBLE, {c[5]}::DOUBLE)" for n, c in enumerate(_CONFIGS)) + ") v(config, threshold, tie_break, cluster_rank, mutual_k, margin, support))"
_GRID_ROWS = f"WITH {_choice_sql('weighted')}, {_NAMED}, sg AS (SELECT strategy, config, {_SUMS} FROM jn GROUP BY 1, 2) SELECT sg.*, threshold, tie_break, cluster_rank, mutual_k, margin, support FROM sg LEFT JOIN nm USING (config)"
_BUCKET = {r: f"CASE WHEN {v} <= {_BOUNDS[r][0]} THEN 0 WHEN {v} <= {_BOUNDS[r][1]} THEN 1 WHEN {v} IS NOT NULL THEN 2 END" for r, v in (("length", "length"), ("candidates", "candidates"), ("component", "size"))}


def _grid_inputs(s, d):
    nodes, sim = _conv_nodes(s, d), r9(pr.jaccard_pairs(fx.conv_candidates(s, d)))
    nodes = nodes.withColumn("penalty", F.round(tx.penalty(tx.normalize(F.coalesce("candidate", F.lit("")))), 9))
    cents = lambda **kw: r9(pr.centrality(nodes.select("problem_id", "candidate_index", "length"), sim, **kw))
    baselines = {
        "first": se.first_candidate(nodes), "shortest": se.shortest(nodes), "majority": ca.majority(nodes).withColumnRenamed("candidate_index", "chosen_index"), "random": se.random_choice(nodes, 123),
        "bleu_medoid": se.medoid(_cents(s, d), "length"), "mbr_global": se.medoid(cents(), "length"), "mbr_knn": se.medoid(cents(mode="knn", k=3), "length"),
    }
    return nodes.select("problem_id", "candidate_index", "length", "penalty", "label"), sim, baselines


_GRID_OPTIONS = {"ensemble": "medoid", "simple_k": 3, "max_drop": 0.05, "digits": 9}


def _selection_grid(s, d):
    nodes, sim, baselines = _grid_inputs(s, d)
    return leaderboard.selection_grid(nodes, sim, _CONFIGS, baselines, **_GRID_OPTIONS)


@query("OP-182_selection_grid", _GRID_ROWS)
def _(s, d):
    return r9(_selection_grid(s, d))


@query("OP-183_grid_buckets", f"WITH {_choice_sql('majority')}, bk AS (SELECT *, {', '.join(f'{e} AS b_{r}' for r, e in _BUCKET.items())} FROM jn), sg AS (SELECT strategy, config, b_length, b_candidates, b_component, grouping(b_length) AS gl, grouping(b_candidates) AS gc, grouping(b_component) AS gk, {_SUMS} FROM bk GROUP BY GROUPING SETS ((strategy, config), (strategy, config, b_length), (strategy, config, b_candidates), (strategy, config, b_component))) SELECT CASE WHEN gl = 0 THEN 'length' WHEN gc = 0 THEN 'candidates' WHEN gk = 0 THEN 'component' ELSE 'all' END AS report, coalesce(b_length, b_candidates, b_component) AS bucket, * EXCLUDE (gl, gc, gk, b_length, b_candidates, b_component) FROM sg WHERE gl + gc + gk = 3 OR coalesce(b_length, b_candidates, b_component) IS NOT NULL")
def _(s, d):
    nodes, sim, baselines = _grid_inputs(s, d)
    nodes = cut(nodes)
    chosen = grid.choices(nodes, sim, _CONFIGS, baselines, vote="majority", **_GRID_OPTIONS)
    return r9(grid.totals(chosen, nodes, nodes.filter("candidate_index = 0").select("problem_id", "length"), _BOUNDS))


@query("OP-184_top_selections", f"SELECT * FROM ({_GRID_ROWS}) WHERE strategy = 'selection' ORDER BY accuracy_given_any DESC, accuracy DESC, threshold, tie_break, cluster_rank, mutual_k, margin, support LIMIT 3")
def _(s, d):
    return r9(leaderboard.top_selections(_selection_grid(s, d), 3))


_METRICS = "pm AS (SELECT problem_id, min(rank) FILTER (label = 1) AS f, sum(label) AS pos, " + ", ".join(f"coalesce(sum(1 / log2(rank + 1.0)) FILTER (label = 1 AND rank <= {k}), 0) AS d{k}" for k in (1, 3, 5)) + " FROM rk GROUP BY 1)"


@query("OP-185_ranking_metrics", f"WITH {LINE}, {_RANKED}, {_METRICS} SELECT count(*) AS problems, round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) AS mrr, " + ", ".join(f"round(avg(CASE WHEN f <= {k} THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit{k}, round(avg(CASE WHEN pos > 0 THEN d{k} / list_sum(list_transform(range(1, least(pos, {k})::BIGINT + 1), lambda i: 1 / log2(i + 1.0))) ELSE 0 END), 9) AS ndcg{k}" for k in (1, 3, 5)) + " FROM pm")
def _(s, d):
    return r9(ev.ranking_metrics(_ranked(s, d)))


@query("OP-186_within_auc", f"WITH {LINE} SELECT p.problem_id, round(avg(CASE WHEN p.score_a > n.score_a THEN 1.0::DOUBLE WHEN p.score_a = n.score_a THEN 0.5 ELSE 0 END), 9) AS auc FROM (SELECT * FROM lc WHERE label = 1) p JOIN (SELECT * FROM lc WHERE label = 0) n USING (problem_id) GROUP BY 1")
def _(s, d):
    return r9(ev.within_auc(fx.scored_lines(s, d)).filter("auc is not null"))


@query("OP-187_pooled_auc", f"WITH {LINE}, t AS (SELECT label, rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2.0::DOUBLE AS r FROM lc), g AS (SELECT sum(r) FILTER (label = 1) AS s, sum(label)::BIGINT AS p, count(*) AS n FROM t) SELECT round((s - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)), 9) AS auc, p AS positives, n AS rows FROM g")
def _(s, d):
    return r9(ev.pooled_auc(fx.scored_lines(s, d)))


_MISS = "ms AS (SELECT t.problem_id, t.candidate_index AS top_index, t.score_a AS top_score, b.candidate_index AS best_index, b.score_a AS best_score, b.rank AS best_rank, t.score_a - b.score_a AS gap FROM (SELECT * FROM rk WHERE rank = 1 AND label = 0) t JOIN (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY rank) AS q FROM rk WHERE label = 1) b ON b.problem_id = t.problem_id AND b.q = 1)"


@query("OP-188_reachable_misses", f"WITH {LINE}, {_RANKED}, {_MISS} SELECT * FROM ms")
def _(s, d):
    return ev.reachable_misses(_ranked(s, d))


@query("OP-189_miss_buckets", f"WITH {LINE}, {_RANKED}, {_MISS} SELECT CASE WHEN best_rank <= 1 THEN '<=1' WHEN best_rank <= 2 THEN '<=2' WHEN best_rank <= 5 THEN '<=5' WHEN best_rank <= 10 THEN '<=10' WHEN best_rank <= 20 THEN '<=20' ELSE '>20' END AS bucket, count(*) AS n, round(avg(gap), 9) AS mean_gap FROM ms GROUP BY 1")
def _(s, d):
    return r9(ev.miss_buckets(ev.reachable_misses(_ranked(s, d))))


_VMISS = f"""vs AS (SELECT *, vec_id * 37 % 101 / 101.0::DOUBLE AS score, row_number() OVER (PARTITION BY problem_id ORDER BY vec_id * 37 % 101 DESC, candidate_index) AS rank FROM vc),
vm AS (SELECT t.problem_id, t.candidate_index AS top_index, b.rank AS best_rank, t.score - b.score AS gap FROM (SELECT * FROM vs WHERE rank = 1 AND label = 0) t JOIN (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY rank) AS q FROM vs WHERE label = 1) b ON b.problem_id = t.problem_id AND b.q = 1),
nb AS (SELECT vm.problem_id, count(*) AS topk, count(*) FILTER (round(c.score, 9) >= 0.05) AS near, coalesce(round(max(c.score), 9), 0) AS max_sim FROM vm JOIN vs ON vs.problem_id = vm.problem_id AND vs.rank <= 10 LEFT JOIN cosp c ON c.problem_id = vm.problem_id AND c.i = least(vs.candidate_index, top_index) AND c.j = greatest(vs.candidate_index, top_index) GROUP BY 1)"""


def _vec_misses(s, d):
    ranked = ev.with_rank(fx.vec_candidates(s, d).withColumn("score", F.col("vec_id") * 37 % 101 / F.lit(101.0)))
    return ev.miss_neighbours(ev.reachable_misses(ranked), ranked, _cos(s, d), 10, 0.05)


@query("OP-189_miss_neighbours", f"WITH {VEC}, {_COS}, {_VMISS} SELECT problem_id, top_index, best_rank::INTEGER AS best_rank, round(gap, 9) AS gap, topk, near, max_sim FROM vm JOIN nb USING (problem_id)")
def _(s, d):
    return r9(_vec_misses(s, d).select("problem_id", "top_index", "best_rank", "gap", "topk", "near", "max_sim"))


@query("OP-189_miss_summary", f"WITH {LINE}, {_RANKED}, {_MISS} SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (best_rank <= {b}) AS le_{b}" for b in (1, 2, 5, 10, 20)) + ", round(avg(gap), 9) AS mean_gap, (list_sort(list(gap)))[count(*) // 2 + 1] AS median_gap FROM ms")
def _(s, d):
    return r9(ev.miss_summary(ev.reachable_misses(_ranked(s, d))))


@query("OP-190_typecheck_histogram", f"WITH {LINE}, c AS (SELECT problem_id, count(*) FILTER (typechecks) AS n_ok FROM lc GROUP BY 1) SELECT n_ok, count(*) AS problems FROM c GROUP BY 1")
def _(s, d):
    return fx.line_candidates(s, d).groupBy("problem_id").agg(F.count_if("typechecks").alias("n_ok")).groupBy("n_ok").agg(F.count(F.lit(1)).alias("problems"))


@query("OP-191_build_stats", f"WITH {LINE}, p AS (SELECT problem_id, sum(label) AS p, count(*) AS n FROM lc GROUP BY 1) SELECT count(*) AS problems, count(*) FILTER (p = 0) AS no_positive, count(*) FILTER (p = n) AS no_negative, count(*) FILTER (p > 0 AND p < n) AS usable, round(1 - count(*) FILTER (p > 0 AND p < n) / count(*)::DOUBLE, 9) AS skip_rate FROM p")
def _(s, d):
    return r9(etl.build_stats(fx.line_candidates(s, d)))


@query("OP-192_classification", f"WITH {LINE}, c AS (SELECT count(*) FILTER (score_a >= 0 AND label = 1) AS tp, count(*) FILTER (score_a >= 0 AND label = 0) AS fp, count(*) FILTER (score_a < 0 AND label = 1) AS fn, count(*) FILTER (score_a < 0 AND label = 0) AS tn FROM lc) SELECT *, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 9) AS accuracy FROM c")
def _(s, d):
    return r9(ev.classification(fx.line_candidates(s, d), F.col("score_a") >= 0, F.col("label") == 1))


@query("OP-193_label_counts", f"WITH {LINE}, {CONV} SELECT 'line' AS task, label, count(*) AS n FROM lc GROUP BY 2 UNION ALL SELECT 'conv', label, count(*) FROM cc GROUP BY 2")
def _(s, d):
    both = fx.line_candidates(s, d).select(F.lit("line").alias("task"), "label").unionByName(fx.conv_candidates(s, d).select(F.lit("conv").alias("task"), "label"))
    return both.groupBy("task", "label").agg(F.count(F.lit(1)).alias("n"))


# --- calibration -----------------------------------------------------------------------------------------------------------------

_PROB = f"pb AS (SELECT problem_id, candidate_index, label, round({SIG('score_a')}, 12) AS p, score_a FROM lc)"
_NLL = "avg(-(label * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - label) * ln(least(greatest(1 - p, 1e-12), 1 - 1e-12))))"


@query("OP-200_scored", f"WITH {LINE} SELECT problem_id, candidate_index, label, score_a AS score FROM lc")
def _(s, d):
    return cal.finite(fx.scored_lines(s, d)).select("problem_id", "candidate_index", "label", "score")


@query("OP-201_nll", f"WITH {LINE}, {_PROB} SELECT round({_NLL}, 7) AS nll FROM pb")
def _(s, d):
    return cal.losses(fx.scored_lines(s, d)).select(F.round("nll", 7).alias("nll"))


@query("OP-202_brier", f"WITH {LINE}, {_PROB} SELECT round(avg((p - label) ** 2), 9) AS brier FROM pb")
def _(s, d):
    return r9(cal.losses(fx.scored_lines(s, d)).select("brier"))


_REL = "bn AS (SELECT b::INTEGER AS bin, b / 10.0::DOUBLE AS lo, (b + 1) / 10.0::DOUBLE AS hi FROM range(10) t(b)), rl AS (SELECT bin, lo, hi, count(p) AS n, avg(p) AS mean_p, avg(label) AS accuracy, coalesce(abs(avg(p) - avg(label)), 0) AS abs_gap FROM bn LEFT JOIN pb ON p >= lo AND (p < hi OR bin = 9) GROUP BY 1, 2, 3)"


@query("OP-203_reliability", f"WITH {LINE}, {_PROB}, {_REL} SELECT bin, round(lo, 9) AS lo, round(hi, 9) AS hi, n, round(mean_p, 9) AS mean_p, round(accuracy, 9) AS accuracy, round(abs_gap, 9) AS abs_gap FROM rl")
def _(s, d):
    return r9(cal.reliability(fx.scored_lines(s, d)))


@query("OP-204_ece_mce", f"WITH {LINE}, {_PROB}, {_REL} SELECT round(sum(n * abs_gap) / sum(n), 9) AS ece, round(max(abs_gap), 9) AS mce FROM rl")
def _(s, d):
    return r9(cal.ece_mce(cal.reliability(fx.scored_lines(s, d))))


def _sql_fit(score: str) -> str:
    """tf(t): where the log loss of lc's score over T has no slope, by halving ln T."""
    return f"""gl AS (SELECT list({{'s': s, 'n': n, 'p': p}}) AS l FROM (SELECT {score} AS s, count(*) AS n, sum(label) AS p FROM lc GROUP BY 1)),
tf AS (WITH RECURSIVE h(k, a, b) AS (SELECT 0, ln(0.05::DOUBLE), ln(20.0::DOUBLE) UNION ALL SELECT k + 1, CASE WHEN pull > 0 THEN mid ELSE a END, CASE WHEN pull > 0 THEN b ELSE mid END
  FROM (SELECT k, a, b, (a + b) / 2 AS mid, list_sum(list_transform(l, lambda x: x.s * (x.n / (1 + exp(-x.s * exp(-(a + b) / 2))) - x.p))) AS pull FROM h, gl WHERE k < 50)) SELECT exp((a + b) / 2) AS t FROM h WHERE k = 50)"""


@query("OP-205_fit_temperature", f"WITH {LINE}, {_sql_fit('score_a')} SELECT round(t, 6) AS temperature FROM tf")
def _(s, d):
    t = cal.fit_temperature(fx.scored_lines(s, d))
    return s.createDataFrame([(round(t, 6),)], "temperature double")


_LOGIT = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))".format(SIG("score_a"))


@query("OP-206_fit_pair_temperature", f"WITH {LINE}, {_sql_fit(_LOGIT)} SELECT round(t, 6) AS temperature FROM tf")
def _(s, d):
    p = fx.line_candidates(s, d).select("label", st.sigmoid(F.col("score_a")).alias("prob"))
    return s.createDataFrame([(round(cal.fit_pair_temperature(p), 6),)], "temperature double")


_SWEEP = f"""at0 AS (SELECT round({SIG('score_a')}, 9) AS thr, count(*) AS n_at, sum(label) AS pos_at FROM lc GROUP BY 1 UNION ALL SELECT round(i / 100.0::DOUBLE, 9), 0, 0 FROM range(1, 100) t(i)), a2 AS (SELECT thr, sum(n_at) AS n_at, sum(pos_at) AS pos_at FROM at0 GROUP BY 1),
sw AS (SELECT thr, (sum(pos_at) OVER o)::BIGINT AS tp, (sum(n_at) OVER o - sum(pos_at) OVER o)::BIGINT AS fp, (sum(pos_at) OVER () - sum(pos_at) OVER o)::BIGINT AS fn, (sum(n_at) OVER () - sum(pos_at) OVER () - sum(n_at) OVER o + sum(pos_at) OVER o)::BIGINT AS tn FROM a2 WINDOW o AS (ORDER BY thr DESC ROWS UNBOUNDED PRECEDING)),
sm AS (SELECT *, {R('tp', '(tp + fp)')} AS precision, {R('tp', '(tp + fn)')} AS recall, {R('2 * tp', '(2 * tp + fp + fn)')} AS f1, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy FROM sw)"""


@query("OP-207_threshold_sweep", f"WITH {LINE}, {_SWEEP} SELECT thr, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(accuracy, 9) AS accuracy FROM sm")
def _(s, d):
    return r9(cal.threshold_table(fx.scored_lines(s, d)))


@query("OP-207_best_thresholds", f"WITH {LINE}, {_SWEEP}, r AS (SELECT *, row_number() OVER (ORDER BY round(f1, 12) DESC, round(precision, 12) DESC, round(recall, 12) DESC, thr) AS rf, row_number() OVER (ORDER BY round(accuracy, 12) DESC, round(f1, 12) DESC, thr) AS ra FROM sm) SELECT 'best_f1' AS which, thr, round(f1, 9) AS f1, round(accuracy, 9) AS accuracy FROM r WHERE rf = 1 UNION ALL SELECT 'best_accuracy', thr, round(f1, 9), round(accuracy, 9) FROM r WHERE ra = 1 UNION ALL SELECT 'at_half', thr, round(f1, 9), round(accuracy, 9) FROM r WHERE thr = 0.5")
def _(s, d):
    return r9(cal.best_thresholds(cal.threshold_table(fx.scored_lines(s, d))))


_REPORT = f"q AS (SELECT stage, temperature, label, {SIG('score_a / temperature')} AS p FROM lc, st), lo AS (SELECT stage, temperature, {_NLL} AS nll, avg((p - label) ** 2) AS brier FROM q GROUP BY 1, 2), bi AS (SELECT stage, least(floor(round(p, 12) * 10), 9) AS b, count(*) AS n, abs(avg(round(p, 12)) - avg(label)) AS gap FROM q GROUP BY 1, 2), ec AS (SELECT stage, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM bi GROUP BY 1) SELECT stage, temperature, round(nll, 6) AS nll, round(brier, 6) AS brier, round(ece, 6) AS ece, round(mce, 6) AS mce FROM lo JOIN ec USING (stage)"


@query("OP-208_calibration_report", f"WITH {LINE}, {_sql_fit('score_a')}, st AS (SELECT 'before' AS stage, 1.0::DOUBLE AS temperature UNION ALL SELECT 'after', t FROM tf), {_REPORT.replace('SELECT stage, temperature, round(nll', 'SELECT stage, round(temperature, 6) AS temperature, round(nll')}")
def _(s, d):
    x = cal.report(fx.scored_lines(s, d))
    return x.select("stage", *[F.round(c, 6).alias(c) for c in x.columns[1:]])


@query("OP-208_report_at", f"WITH {LINE}, st AS (SELECT * FROM (VALUES ('before', 1.0::DOUBLE), ('after', 2.5)) v(stage, temperature)), {_REPORT}")
def _(s, d):
    x = cal.report(fx.scored_lines(s, d), temperature=2.5)
    return x.select("stage", *[F.round(c, 6).alias(c) for c in x.columns[1:]])


# --- selective prediction --------------------------------------------------------------------------------------------------------


@query("OP-210_examples", f"WITH {LINE}, {_EXAMPLES} SELECT problem_id, selected_correct, has_any_correct, n_candidates FROM ex")
def _(s, d):
    return _examples(s, d).select("problem_id", "selected_correct", "has_any_correct", "n_candidates")


_COV = [0.25, 0.5, 0.75, 1.0]


@query("OP-211_coverage_table", f"WITH {LINE}, {_EXAMPLES}, {_CURVE}, t AS (SELECT * FROM (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) v(target)) SELECT target, accepted, round(accepted / n::DOUBLE, 9) AS coverage, round(accuracy, 9) AS accuracy, round(1 - accuracy, 9) AS risk, round(threshold, 9) AS threshold FROM cw, t WHERE accepted = greatest(1, ceil(target * n))")
def _(s, d):
    return r9(sv.coverage_table(_curve(s, d), _COV)).withColumn("accepted", F.col("accepted").cast("long"))


@query("OP-211_best_prefix", f"WITH {LINE}, {_EXAMPLES}, {_CURVE} SELECT accepted, round(accepted / n::DOUBLE, 9) AS coverage, round(accuracy, 9) AS accuracy, round(threshold, 9) AS threshold FROM cw ORDER BY round(cw.accuracy, 12) DESC, accepted DESC LIMIT 1")
def _(s, d):
    return r9(sv.best_prefix(_curve(s, d))).withColumn("accepted", F.col("accepted").cast("long"))


@query("OP-211_confident_errors", f"WITH {LINE}, {_EXAMPLES}, {_CURVE} SELECT problem_id, round(threshold, 9) AS confidence FROM cw WHERE selected_correct = 0 ORDER BY cw.threshold DESC, problem_id LIMIT 15")
def _(s, d):
    return r9(sv.confident_errors(sv.with_confidence(_examples(s, d), "chosen_probability")).select("problem_id", "confidence"))


_TARGETS = [0.3, 0.6, 0.9, 0.999]


@query("OP-212_recommend", f"""WITH {LINE}, {_EXAMPLES}, {_CURVE}, e AS (SELECT accepted, round(accuracy, 12) AS accuracy, round(low, 12) AS low, threshold FROM cw WHERE accepted >= 5), t AS (SELECT * FROM (VALUES (0.3::DOUBLE), (0.6), (0.9), (0.999)) v(target)),
c AS (SELECT target, max((accepted, low, accuracy, threshold)) AS m FROM e, t WHERE low >= target GROUP BY 1), b AS (SELECT max((low, accuracy, accepted, threshold)) AS m FROM e)
SELECT t.target, c.m IS NOT NULL AS meets_target, coalesce(c.m[1], b.m[3])::BIGINT AS accepted, round(coalesce(c.m[2], b.m[1]), 9) AS low, round(coalesce(c.m[4], b.m[4]), 9) AS threshold FROM t LEFT JOIN c USING (target), b""".replace("c.m[1]", "struct_extract_at(c.m, 1)").replace("c.m[2]", "struct_extract_at(c.m, 2)").replace("c.m[4]", "struct_extract_at(c.m, 4)").replace("b.m[3]", "struct_extract_at(b.m, 3)").replace("b.m[1]", "struct_extract_at(b.m, 1)").replace("b.m[4]", "struct_extract_at(b.m, 4)"))
def _(s, d):
    r = r9(sv.recommend(_curve(s, d), _TARGETS, 5))
    return r.select("target", "meets_target", F.col("accepted").cast("long").alias("accepted"), "low", "threshold")


@query("OP-213_signal_quality", f"WITH {LINE}, {_EXAMPLES}, {_CURVE}, {_AREAS}, q AS (SELECT avg(accuracy) AS auacc, avg(1 - accuracy) AS risk_area, max(correct) / max(n)::DOUBLE AS full_accuracy FROM cw) SELECT round(auacc, 8) AS auacc, round(risk_area, 8) AS risk_area, round(full_accuracy, 8) AS full_accuracy, round(auacc - full_accuracy, 8) AS lift, round((auacc - worst_area) / (ideal_area - worst_area), 8) AS normalized_area FROM q, ideal")
def _(s, d):
    q = sv.ranking_quality(_curve(s, d))
    return q.select(*[F.round(c, 8).alias(c) for c in ("auacc", "risk_area", "full_accuracy", "lift", "normalized_area")])


_KEYS_SQL = f"""kc AS (SELECT problem_id, selected_correct, key, place, round(coalesce(CASE key WHEN 'chosen_probability' THEN chosen_probability WHEN 'probability_margin' THEN probability_margin ELSE score_margin END, 0), 12) AS confidence FROM ex, (VALUES ('chosen_probability', 0), ('probability_margin', 1), ('score_margin', 2)) k(key, place)),
kv AS (SELECT key, place, row_number() OVER o AS accepted, sum(selected_correct) OVER o AS correct, count(*) OVER (PARTITION BY key) AS n FROM kc WINDOW o AS (PARTITION BY key ORDER BY confidence DESC, problem_id ROWS UNBOUNDED PRECEDING)),
kt AS (SELECT target, key, place, round(correct / accepted::DOUBLE, 12) AS accuracy FROM kv, (VALUES {', '.join(f'({x}::DOUBLE)' for x in _COV)}) v(target) WHERE accepted = greatest(1, ceil(target * n)))"""


@query("OP-213_best_key", f"WITH {LINE}, {_EXAMPLES}, {_KEYS_SQL} SELECT target, arg_max(key, (accuracy, -place)) AS best_key, round(max(accuracy), 9) AS accuracy FROM kt GROUP BY 1")
def _(s, d):
    return r9(sv.best_key_per_coverage(_examples(s, d), _COV))


_APPLY = "ap AS (SELECT *, confidence >= 0.7 AS accepted FROM cf)"


def _applied(s, d):
    return sv.apply_threshold(sv.with_confidence(_examples(s, d), "chosen_probability"), 0.7)


@query("OP-214_abstention_report", f"WITH {LINE}, {_EXAMPLES}, {_CURVE}, {_APPLY}, c AS (SELECT count(*) AS problems, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS abstained, count(*) FILTER (accepted AND selected_correct = 1) AS accepted_correct, count(*) FILTER (accepted AND has_any_correct = 1) AS accepted_any, count(*) FILTER (NOT accepted AND selected_correct = 1) AS abstained_correct, count(*) FILTER (NOT accepted AND has_any_correct = 1) AS abstained_any, count(*) FILTER (NOT accepted AND has_any_correct = 1 AND selected_correct = 0) AS abstained_missed, count(*) FILTER (accepted AND has_any_correct = 1 AND selected_correct = 0) AS accepted_missed FROM ap) SELECT *, round({R('accepted', 'problems')}, 9) AS coverage, round({R('accepted_correct', 'accepted')}, 9) AS accuracy, round({W('accepted_correct', 'accepted', 'low')}, 9) AS low, round({W('accepted_correct', 'accepted', 'high')}, 9) AS high FROM c")
def _(s, d):
    return r9(sv.abstention_report(_applied(s, d)))


@query("OP-215_resolve_threshold", f"WITH {LINE}, {_EXAMPLES}, {_CURVE} SELECT 0.6::DOUBLE AS target, round(arg_max(threshold, accepted) FILTER (round(low, 12) >= 0.6 AND accepted >= 5), 9) AS threshold FROM cw")
def _(s, d):
    rows = [r.asDict() for r in sv.recommend(_curve(s, d), _TARGETS, 5).collect()]
    return s.createDataFrame([(0.6, round(sv.resolve_threshold(None, rows, 0.6), 9))], "target double, threshold double")


def _loo_sql() -> str:
    keys = []
    for name, k, ok in (("f", "accepted", "correct"), ("0", "(accepted - 1)", "correct"), ("1", "(accepted - 1)", "(correct - 1)")):
        low, acc = f"round({W(ok, k, 'low')}, 12)", f"round({R(ok, k)}, 12)"
        keys.append(f"CASE WHEN {k} >= 5 AND {low} >= 0.6 THEN struct_pack(k := {k}, low := {low}, acc := {acc}, thr := threshold) END AS c{name}, CASE WHEN {k} >= 5 THEN struct_pack(low := {low}, acc := {acc}, k := {k}, thr := threshold) END AS b{name}")
    before = lambda x: f"max({x}) OVER (ORDER BY accepted ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = lambda x: f"max({x}) OVER (ORDER BY accepted DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    best = lambda a, b: f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} WHEN {a} >= {b} THEN {a} ELSE {b} END"
    return f"""lk AS (SELECT problem_id, selected_correct, threshold, accepted, correct, {', '.join(keys)} FROM cw),
lw AS (SELECT problem_id, selected_correct, threshold, {before('cf')} AS pc, {before('bf')} AS pb, CASE WHEN selected_correct = 1 THEN {after('c1')} ELSE {after('c0')} END AS ac, CASE WHEN selected_correct = 1 THEN {after('b1')} ELSE {after('b0')} END AS ab FROM lk),
lf AS (SELECT problem_id, selected_correct, threshold, {best('pc', 'ac')} AS c, {best('pb', 'ab')} AS b FROM lw),
ll AS (SELECT problem_id AS omitted, selected_correct AS omitted_correct, threshold AS omitted_confidence, c IS NOT NULL AS meets_target, coalesce(c.thr, b.thr) AS loo_threshold FROM lf),
en AS (SELECT threshold, max(accepted) AS accepted, max(correct) AS correct FROM cw GROUP BY 1),
fu AS (SELECT coalesce(max(cf).thr, max(bf).thr) AS full_threshold FROM lk), fn AS (SELECT full_threshold, accepted AS n_full FROM fu JOIN en ON threshold = full_threshold),
folds AS (SELECT omitted, loo_threshold, meets_target, omitted_confidence, omitted_confidence >= loo_threshold AS omitted_accepted, omitted_correct, full_threshold, omitted_confidence >= full_threshold AS full_accepts_omitted, loo_threshold - full_threshold AS threshold_delta, accepted AS full_accepted, correct AS full_correct,
  accepted - (omitted_confidence >= loo_threshold)::INTEGER AS train_accepted, correct - (omitted_confidence >= loo_threshold AND omitted_correct = 1)::INTEGER AS train_correct, accepted - n_full AS accepted_delta, least(accepted, n_full) / greatest(accepted, n_full)::DOUBLE AS jaccard FROM ll LEFT JOIN en ON en.threshold = loo_threshold, fn)"""


_LOO = f"WITH {LINE}, {_EXAMPLES}, {_CURVE}, {_loo_sql()}"
_LOO_ROUND = "* REPLACE (round(loo_threshold, 9) AS loo_threshold, round(omitted_confidence, 9) AS omitted_confidence, round(full_threshold, 9) AS full_threshold, round(threshold_delta, 9) AS threshold_delta, round(jaccard, 9) AS jaccard)"


def _folds(s, d):
    return sv.leave_one_out(sv.with_confidence(_examples(s, d), "chosen_probability"), 0.6)


@query("OP-216_leave_one_out", f"{_LOO} SELECT {_LOO_ROUND} FROM folds")
def _(s, d):
    return r9(_folds(s, d))


@query("OP-216_stability", f"{_LOO} SELECT count(*) AS folds, count(*) FILTER (abs(threshold_delta) > 1e-12) AS changed, count(DISTINCT round(loo_threshold, 12)) AS distinct_thresholds, round(min(loo_threshold), 9) AS threshold_min, round(max(loo_threshold), 9) AS threshold_max, min(train_accepted) AS train_accepted_min, max(train_accepted) AS train_accepted_max, min(full_accepted) AS full_accepted_min, max(full_accepted) AS full_accepted_max, round(min(jaccard), 9) AS jaccard_min, round(avg(jaccard), 7) AS jaccard_mean, count(*) FILTER (meets_target) AS meets_target, count(*) FILTER (omitted_accepted) AS heldout_accepted, count(*) FILTER (omitted_accepted AND omitted_correct = 1) AS heldout_correct FROM folds")
def _(s, d):
    x = sv.stability(_folds(s, d))
    return r9(x.withColumn("jaccard_mean", F.round("jaccard_mean", 7)).drop("threshold_mean", "heldout_rejected", "heldout_accuracy", "heldout_low", "heldout_high", "changed_rate"))


@query("OP-216_sensitive_omissions", f"{_LOO} SELECT omitted, round(threshold_delta, 9) AS threshold_delta, accepted_delta FROM folds ORDER BY abs(folds.threshold_delta) DESC, abs(folds.accepted_delta) DESC, omitted DESC LIMIT 10")
def _(s, d):
    return r9(sv.sensitive_omissions(_folds(s, d)).select("omitted", "threshold_delta", "accepted_delta"))


@query("OP-217_casebook", f"WITH {LINE}, {_EXAMPLES}, {_CURVE}, {_APPLY}, {_RANKED}, bc AS (SELECT problem_id, min(rank) FILTER (label = 1) AS best_rank FROM rk GROUP BY 1) SELECT problem_id, CASE WHEN accepted AND selected_correct = 1 THEN 'accepted_correct' WHEN accepted AND has_any_correct = 1 THEN 'accepted_missed' WHEN accepted THEN 'accepted_no_correct' WHEN selected_correct = 1 THEN 'abstained_correct' WHEN has_any_correct = 1 THEN 'abstained_missed' ELSE 'abstained_no_correct' END AS kind, round(confidence - 0.7, 9) AS distance, best_rank FROM ap JOIN bc USING (problem_id)")
def _(s, d):
    return r9(sv.casebook(_applied(s, d), _ranked(s, d)).select("problem_id", "kind", "distance", F.col("best_correct.rank").alias("best_rank")))


# --- leaderboards ----------------------------------------------------------------------------------------------------------------


@query("OP-220_compare_methods", f"WITH {LINE}, {_TWO} SELECT problems, round({R('both_correct + a_only', 'problems')}, 9) AS a_rate, round({R('both_correct + b_only', 'problems')}, 9) AS b_rate, round({W('(both_correct + a_only)', 'problems', 'low')}, 9) AS a_low, round({W('(both_correct + b_only)', 'problems', 'high')}, 9) AS b_high, round({fx.sql_sign_test('a_only', 'b_only')}, 9) AS p_value FROM ct")
def _(s, d):
    p = ev.paired(_correct(s, d, "score_a"), _correct(s, d, "score_b"))
    a, b, n = F.col("both_correct") + F.col("a_only"), F.col("both_correct") + F.col("b_only"), F.col("problems")
    return r9(p.select("problems", st.rate(a, n).alias("a_rate"), st.rate(b, n).alias("b_rate"), st.wilson(a, n)[0].alias("a_low"), st.wilson(b, n)[1].alias("b_high"), "p_value"))


@query("OP-221_method_decisions", f"WITH {LINE}, {_DEC} SELECT method, problem_id, correct, accepted, any_correct FROM dec0")
def _(s, d):
    return _decisions(s, d)


_SUMMARY = f"sg AS (SELECT method, count(*) AS problems, count(*) FILTER (accepted) AS n_accepted, sum(correct)::BIGINT AS n_correct, count(*) FILTER (any_correct = 1) AS n_any, count(*) FILTER (any_correct = 1 AND correct = 0) AS missed FROM dec0 GROUP BY 1), su AS (SELECT *, {R('n_accepted', 'problems')} AS coverage, {R('n_correct', 'problems')} AS accuracy, {R('n_correct', 'n_accepted')} AS accepted_accuracy FROM sg)"


@query("OP-222_summary", f"WITH {LINE}, {_DEC}, {_SUMMARY} SELECT method, problems, n_accepted, n_correct, n_any, missed, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy, round({W('n_correct', 'problems', 'low')}, 9) AS low, round({W('n_correct', 'problems', 'high')}, 9) AS high, round(accepted_accuracy, 9) AS accepted_accuracy, (row_number() OVER (ORDER BY n_correct DESC, accepted_accuracy DESC, method))::INTEGER AS place FROM su")
def _(s, d):
    return r9(leaderboard.summary(_decisions(s, d)))


@query("OP-223_frontier", f"WITH {LINE}, {_DEC}, {_SUMMARY} SELECT method, round(coverage, 9) AS coverage, round(accepted_accuracy, 9) AS accepted_accuracy FROM su a WHERE n_accepted > 0 AND NOT EXISTS (SELECT 1 FROM su b WHERE b.n_accepted > 0 AND round(b.coverage, 12) >= round(a.coverage, 12) AND round(b.accepted_accuracy, 12) >= round(a.accepted_accuracy, 12) AND (round(b.coverage, 12) > round(a.coverage, 12) OR round(b.accepted_accuracy, 12) > round(a.accepted_accuracy, 12)))")
def _(s, d):
    return r9(leaderboard.frontier(leaderboard.summary(_decisions(s, d))))


@query("OP-224_paired_matrix", f"WITH {LINE}, {_DEC}, m AS (SELECT a.method AS a, b.method AS b, count(*) FILTER (a.correct = 1 AND b.correct = 1) AS both_correct, count(*) FILTER (a.correct = 1 AND b.correct = 0) AS a_only, count(*) FILTER (a.correct = 0 AND b.correct = 1) AS b_only, count(*) FILTER (a.correct = 0 AND b.correct = 0) AS neither FROM dec0 a JOIN dec0 b USING (problem_id) WHERE a.method <> b.method GROUP BY 1, 2) SELECT *, round({fx.sql_sign_test('a_only', 'b_only')}, 9) AS p_value FROM m")
def _(s, d):
    return r9(leaderboard.paired_matrix(_decisions(s, d)))


@query("OP-225_disagreements", f"WITH {LINE}, {_DEC} SELECT method, place::INTEGER AS place, problem_id, best_correct, other_correct FROM (SELECT o.method, row_number() OVER (PARTITION BY o.method ORDER BY o.problem_id) AS place, o.problem_id, b.correct AS best_correct, o.correct AS other_correct FROM dec0 o JOIN dec0 b ON b.problem_id = o.problem_id AND b.method = 'argmax_b' AND o.method <> 'argmax_b' AND b.correct <> o.correct) WHERE place <= 10")
def _(s, d):
    return leaderboard.disagreements(_decisions(s, d), "argmax_b", 10)


# --- training data ---------------------------------------------------------------------------------------------------------------

_H = lambda seed, *k: f"('0x' || left(sha256('{seed}:' || " + " || ':' || ".join(k) + "), 15))::BIGINT"


@query("OP-230_reference_pairs", f"WITH {CONV}, r AS (SELECT problem_id, arg_min(candidate, row_no) AS reference FROM cc GROUP BY 1) SELECT problem_id, candidate_index, candidate AS a, reference AS b, label, 'pred_vs_ref' AS task FROM cc JOIN r USING (problem_id)")
def _(s, d):
    c = fx.conv_candidates(s, d)
    return etl.reference_pairs(c.join(ca.lookup_first(c, "problem_id", "row_no", "candidate").withColumnRenamed("candidate", "reference"), "problem_id"))


_LP = "lp AS (SELECT a.problem_id, a.candidate_index AS i, b.candidate_index AS j, a.label * b.label AS label FROM cc a JOIN cc b ON a.problem_id = b.problem_id AND a.candidate_index < b.candidate_index AND a.label + b.label > 0)"


@query("OP-231_hard_pairs", f"WITH {_BLEU}, {_LP}, h AS (SELECT lp.*, bl.score, row_number() OVER (PARTITION BY problem_id, label ORDER BY CASE WHEN label = 1 THEN round(score, 9) ELSE -round(score, 9) END, {_H(5, 'problem_id', 'i', 'j')}) AS r FROM lp JOIN bl USING (problem_id, i, j)) SELECT problem_id, i, j, label, round(score, 9) AS score FROM h WHERE r <= 2")
def _(s, d):
    p = etl.labelled_pairs(fx.conv_candidates(s, d)).join(_bleu(s, d), ["problem_id", "i", "j"])
    return r9(etl.hard_pairs(p, 2, 5).select("problem_id", "i", "j", "label", "score"))


@query("OP-232_symmetrize", f"WITH {CONV}, {_LP} SELECT problem_id, i, j, label FROM lp UNION ALL SELECT problem_id, j, i, label FROM lp")
def _(s, d):
    return etl.symmetrize(etl.labelled_pairs(fx.conv_candidates(s, d)), "i", "j")


@query("OP-233_pairwise_examples", f"WITH {CONV} SELECT p.problem_id, p.candidate_index AS pos, n.candidate_index AS neg FROM cc p JOIN cc n ON n.problem_id = p.problem_id AND p.label = 1 AND n.label = 0")
def _(s, d):
    return etl.pairwise_examples(fx.conv_candidates(s, d))


@query("OP-234_listwise_examples", f"WITH {LINE}, h AS (SELECT *, {_H(9, 'problem_id', 'candidate_index')} AS h FROM lc), r AS (SELECT *, row_number() OVER (PARTITION BY problem_id, label ORDER BY h, candidate_index) AS r FROM h), k AS (SELECT * FROM r WHERE (label = 1 AND r = 1) OR (label = 0 AND r <= 3)) SELECT problem_id, array_to_string(list(candidate_index ORDER BY label DESC, h, candidate_index), ',') AS sampled, array_to_string(list(label ORDER BY label DESC, h, candidate_index), ',') AS labels FROM k GROUP BY 1 HAVING max(label) = 1 AND min(label) = 0")
def _(s, d):
    e = etl.listwise_examples(fx.line_candidates(s, d), 3, 9)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return e.select("problem_id", join("sampled_indices").alias("sampled"), join("labels").alias("labels"))


@query("OP-235_mined_negatives", f"WITH {LINE}, n AS (SELECT *, {_H(3, 'problem_id', 'candidate_index')} AS h, row_number() OVER (PARTITION BY problem_id ORDER BY score_a DESC, candidate_index) AS s FROM lc WHERE label = 0), e AS (SELECT *, row_number() OVER (PARTITION BY problem_id, s <= 2 ORDER BY h, candidate_index) AS e FROM n), t AS (SELECT *, CASE WHEN s <= 2 THEN 0 WHEN e <= 1 THEN 1 ELSE 2 END AS tier FROM e), p AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY tier, CASE WHEN tier = 1 THEN e ELSE s END) AS place FROM t) SELECT problem_id, candidate_index, tier, place::INTEGER AS place FROM p WHERE place <= 4")
def _(s, d):
    return etl.mined_negatives(fx.scored_lines(s, d), 2, 1, 4, 3)


_IDS = lambda seed: f"i AS (SELECT problem_id, row_number() OVER (ORDER BY {_H(seed, 'problem_id')}, problem_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT problem_id FROM lc))"


@query("OP-236_train_eval", f"WITH {LINE}, {_IDS(4)} SELECT problem_id, CASE WHEN place <= least(greatest(floor(n * 0.1), 1), n - 1) THEN 'eval' ELSE 'train' END AS split FROM i")
def _(s, d):
    return etl.train_eval(fx.line_candidates(s, d), 0.1, 4)


@query("OP-237_three_way_split", f"WITH {LINE}, {_IDS(6)} SELECT problem_id, CASE WHEN place <= floor(n * 0.7) THEN 'train' WHEN place <= floor(n * 0.7) + floor(n * 0.15) THEN 'dev' ELSE 'test' END AS split FROM i")
def _(s, d):
    return etl.split_by_id(fx.line_candidates(s, d), {"train": 0.7, "dev": 0.15, "test": 0.15}, 6)


@query("OP-238_capped_pairs", f"WITH {CONV}, {_LP}, h AS (SELECT *, row_number() OVER (PARTITION BY problem_id, label ORDER BY {_H(8, 'problem_id', 'i', 'j')}, i, j) AS r FROM lp) SELECT problem_id, i, j, label FROM h WHERE r <= 3")
def _(s, d):
    return etl.random_pairs(etl.labelled_pairs(fx.conv_candidates(s, d)), 3, 8)


@query("OP-239_shuffled_subset", f"WITH {LINE}, {_IDS(2)} SELECT problem_id FROM i WHERE place <= 100")
def _(s, d):
    return fx.line_candidates(s, d).select("problem_id").distinct().orderBy(etl.order_hash(2, "problem_id"), "problem_id").limit(100)


@query("OP-240_sweep_pending", "WITH g AS (SELECT (row_number() OVER (ORDER BY a, b) - 1)::INTEGER AS idx, a, b FROM (VALUES (0.1::DOUBLE), (0.2), (0.3)) x(a), (VALUES (1.0::DOUBLE), (2.0)) y(b)) SELECT * FROM g WHERE idx NOT IN (1, 4)")
def _(s, d):
    return etl.pending(etl.sweep(s, a=[0.1, 0.2, 0.3], b=[1.0, 2.0]), s.createDataFrame([(1,), (4,)], "idx int"), "idx").select("idx", "a", "b")


@query("OP-253_critic_table", f"WITH {CONV}, {_LP}, r AS (SELECT problem_id, arg_min(candidate, row_no) AS reference FROM cc GROUP BY 1), x AS (SELECT problem_id, candidate AS a, reference AS b, label, 'pred_vs_ref' AS task FROM cc JOIN r USING (problem_id) UNION ALL SELECT lp.problem_id, p.candidate, q.candidate, lp.label, 'cand_vs_cand' FROM lp JOIN cc p ON p.problem_id = lp.problem_id AND p.candidate_index = i JOIN cc q ON q.problem_id = lp.problem_id AND q.candidate_index = j) SELECT problem_id, a, b, label, task FROM x UNION ALL SELECT problem_id, b, a, label, task FROM x")
def _(s, d):
    c = fx.conv_candidates(s, d)
    ref = etl.reference_pairs(c.join(ca.lookup_first(c, "problem_id", "row_no", "candidate").withColumnRenamed("candidate", "reference"), "problem_id"))
    t = c.select("problem_id", "candidate_index", "candidate")
    pairs = etl.labelled_pairs(c).join(t.select("problem_id", F.col("candidate_index").alias("i"), F.col("candidate").alias("a")), ["problem_id", "i"]).join(t.select("problem_id", F.col("candidate_index").alias("j"), F.col("candidate").alias("b")), ["problem_id", "j"])
    cols = ["problem_id", "a", "b", "label", "task"]
    return etl.symmetrize(ref.select(*cols).unionByName(pairs.withColumn("task", F.lit("cand_vs_cand")).select(*cols))).select(*cols)


@query("OP-254_pairwise_loss", f"WITH {LINE}, x AS (SELECT p.score_a - n.score_a AS d FROM lc p JOIN lc n ON n.problem_id = p.problem_id AND p.label = 1 AND n.label = 0) SELECT count(*) AS pairs, round(avg(CASE WHEN d >= 0 THEN ln(1 + exp(-d)) ELSE -d + ln(1 + exp(d)) END), 8) AS loss, round(avg(d), 9) AS mean_margin, round(avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS rank_acc FROM x")
def _(s, d):
    x = etl.pairwise_loss(fx.scored_lines(s, d))
    return x.select("pairs", F.round("loss", 8).alias("loss"), F.round("mean_margin", 9).alias("mean_margin"), F.round("rank_acc", 9).alias("rank_acc"))


@query("OP-254_listwise_loss", f"WITH {LINE}, z AS (SELECT problem_id, label, exp(score_a - max(score_a) OVER (PARTITION BY problem_id)) AS e FROM lc), g AS (SELECT problem_id, sum(e) AS z, sum(e) FILTER (label = 1) AS p FROM z GROUP BY 1) SELECT count(*) AS problems, round(avg(-ln(p / z)), 8) AS loss FROM g WHERE p IS NOT NULL")
def _(s, d):
    x = etl.listwise_loss(fx.scored_lines(s, d))
    return x.select("problems", F.round("loss", 8).alias("loss"))
