"""Catalogue, third part: sources and sinks, external interfaces with stand-ins, timed steps and streams.

Files are made in scratch space from whole tables and read back by the source under test.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from quorate import reports
from quorate.operators import candidates as ca
from quorate.operators import evaluation as ev
from quorate.operators import graph, scorers
from quorate.operators import selection as se
from quorate.plans import fixtures as fx
from quorate.plans.catalog import _ARGMAX, _COS, CONV, LINE, VEC, _cos, _selections, query, r9
from quorate.plans.steps import Steps
from quorate.scratch import path as scratch
from quorate.sources import cache, jsonl
from quorate.streaming import live


#: Files that a table is written as, where a query needs some.
_PARTS = 4


def _jsonl(s, d):
    """Every conversation turn as a line; conversations are the keys, so all but one line per key are duplicates."""
    path = scratch(s, "jsonl")
    c = fx.conv_candidates(s, d).select("problem_id", "row_no", "candidate")
    # a file for each range of conversations
    c.repartitionByRange(_PARTS, "problem_id").sortWithinPartitions("problem_id", "row_no").write.json(path)
    return path


_SCHEMA = "problem_id long, row_no long, candidate string"


@query("OP-001_jsonl_last_wins", f"WITH {CONV} SELECT problem_id, max(row_no) AS row_no FROM cc GROUP BY 1")
def _(s, d):
    return jsonl.read_keyed(s, _jsonl(s, d), _SCHEMA).select("problem_id", "row_no")


@query("OP-002_jsonl_with_mark", f"WITH {CONV} SELECT problem_id, row_no, candidate FROM cc")
def _(s, d):
    path = scratch(s, "bom")
    fx.conv_candidates(s, d).select(F.concat(F.lit(jsonl.BOM), F.to_json(F.struct("problem_id", "row_no", "candidate"))).alias("value")).write.text(path)
    return jsonl.read_rows(s, path, _SCHEMA).select("problem_id", "row_no", "candidate")


@query("OP-002_faulty_lines", f"WITH {CONV}, n AS (SELECT *, 3 * row_number() OVER (ORDER BY problem_id, row_no) AS line FROM cc) SELECT line, 'problem_id is missing' AS fault FROM n WHERE problem_id % 5 = 0")
def _(s, d):
    """A file in parts, in which a blank line and one of white space stand before each row, and some rows lack their key; its lines are numbered
    from its first part to its last."""
    path = scratch(s, "faults")
    row = F.to_json(F.struct(F.when(F.col("problem_id") % 5 != 0, F.col("problem_id")).alias("problem_id"), "row_no", "candidate"))
    rows = fx.conv_candidates(s, d).repartitionByRange("problem_id", "row_no").sortWithinPartitions("problem_id", "row_no")
    rows.select(F.concat(F.lit("\n \t\u00a0\n"), row).alias("value")).write.text(path)
    return jsonl.faulty_lines(s, path, as_one=True).select("line", "fault")


@query("OP-003_jsonl_rows", f"WITH {CONV} SELECT problem_id, row_no FROM cc")
def _(s, d):
    return jsonl.read_rows(s, _jsonl(s, d), _SCHEMA).select("problem_id", "row_no")


def _folder(s, d, *names, fmt="json"):
    """A folder of split files, one per name, each with the conversations' ids."""
    path = scratch(s, "splits")
    for n in names:
        c = fx.table(s, d, "conversations").select(F.col("conv_id").alias("problem_id"), F.lit(n).alias("split")).distinct()
        (c.write.parquet if fmt == "parquet" else c.write.json)(f"{path}/{n}.{fmt}")
    return path


_SPLIT = lambda name: f"SELECT DISTINCT conv_id AS problem_id, '{name}' AS split FROM conversations"


@query("OP-004_resolve_split", " UNION ALL ".join([_SPLIT("validation"), _SPLIT("test"), "SELECT DISTINCT conv_id AS problem_id, 'cached' AS split FROM conversations"]))
def _(s, d):
    """A published name that a folder stands for, a path below a base, and a name that only a cache has."""
    folder, cached = _folder(s, d, "train", "validation", "test"), scratch(s, "hub")
    base, name = folder.rsplit("/", 1)
    rows = fx.table(s, d, "conversations").select(F.col("conv_id").alias("problem_id"), F.lit("cached").alias("split")).distinct()
    cache.write_cached(rows, cached, "org/other", "r1", "test", ["test"])
    named = jsonl.resolve_split(s, "org/talks", "valid", names={"org/talks": folder}, base=base, cache=cached)
    below = jsonl.resolve_split(s, name, "test", base=base, cache=cached)
    return named.unionByName(below).unionByName(jsonl.resolve_split(s, "org/other", "test", base=base, cache=cached))


@query("OP-005_parquet_folder", _SPLIT("test"))
def _(s, d):
    return jsonl.resolve_split(s, _folder(s, d, "valid", "test", fmt="parquet"), "test")


@query("OP-006_json_folder", _SPLIT("dev"))
def _(s, d):
    return jsonl.resolve_split(s, _folder(s, d, "train", "dev"), "valid")


@query("OP-007_single_file", f"WITH {CONV} SELECT problem_id, row_no, candidate FROM cc")
def _(s, d):
    """Each JSON-lines file of a folder as a split by itself."""
    path = _jsonl(s, d)
    files = sorted(r[0] for r in s.read.text(path).select(F.input_file_name()).distinct().collect())
    out = None
    for f in files:
        one = jsonl.resolve_split(s, f, "train").select("problem_id", "row_no", "candidate")
        out = one if out is None else out.unionByName(one)
    return out


@query("OP-008_arrow_folders", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    path = scratch(s, "cached")
    jsonl.write_arrow_splits({"train": fx.table(s, d, "nation"), "test": fx.table(s, d, "region")}, path)
    return jsonl.resolve_split(s, "org/regions", "test", names={"org/regions": path})


@query("OP-008_arrow_cache", "SELECT o_orderkey, o_orderstatus, 'new' AS revision FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, o_orderstatus, 'old' FROM orders WHERE o_orderkey % 2 = 0")
def _(s, d):
    """Two versions of two sets of one owner; the info files say which is which. Read by the data source, a partition for each batch."""
    root, o = scratch(s, "cache"), fx.table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    cache.write_cached(o.filter("o_orderkey % 2 = 0"), root, "org/orders", "a1", "test", ["test"], 1000)
    cache.write_cached(o.filter("o_orderkey % 2 = 1"), root, "org/orders", "b2", "test", ["test"], 1000)
    cache.write_cached(o.filter("o_orderkey % 3 = 0"), root, "org/orders-more", "b2", "test", ["test"], 1000)
    cache.write_cached(o.limit(5), root, "org/orders-more", "a1", "valid", ["valid"])
    return cache.read_cached(s, root, "org/orders", "test", "b2").withColumn("revision", F.lit("new")).unionByName(cache.read_cached(s, root, "org/orders", "test", "a1").withColumn("revision", F.lit("old")))


@query("OP-010_local_names", "SELECT * FROM (VALUES ('org/set-a', '/data/a'), ('org/other', 'org/other')) t(name, place)")
def _(s, d):
    names = {"org/set-a": "/data/a"}
    return s.createDataFrame([(n, jsonl.local_name(n, names)) for n in ("org/set-a", "org/other")], "name string, place string")


@query("OP-009_train_fallback", _SPLIT("valid"))
def _(s, d):
    return jsonl.resolve_split(s, _folder(s, d, "valid", "test"), "train")


@query("OP-011_first_problems", f"WITH {CONV}, f AS (SELECT problem_id FROM cc GROUP BY 1 ORDER BY min(row_no), problem_id LIMIT 20) SELECT problem_id, row_no FROM cc WHERE problem_id IN (SELECT problem_id FROM f)")
def _(s, d):
    return jsonl.first_ids(fx.conv_candidates(s, d), "row_no", max_problems=20).select("problem_id", "row_no")


@query("OP-012_id_list", "SELECT DISTINCT conv_id::VARCHAR AS problem_id FROM conversations")
def _(s, d):
    path = scratch(s, "ids")
    fx.table(s, d, "conversations").select(F.concat(F.lit("  "), F.col("conv_id").cast("string"), F.lit(" ")).alias("v")).distinct().unionByName(s.createDataFrame([("",), ("  ",)], "v string")).write.text(path)
    return jsonl.read_ids(s, path)


_SETTINGS = [(1, "# total=9"), (2, "a=1.5"), (3, "b=x"), (4, "a=2.5"), (5, "plain"), (6, "c = 3"), (7, "d=1=2")]


@query("OP-013_settings", "SELECT * FROM (VALUES ('a', 2.5::DOUBLE), ('c', 3.0)) t(name, value)")
def _(s, d):
    return jsonl.parse_settings(s.createDataFrame(_SETTINGS, "place int, value string"))


_CONFIGS = [(1, '{"temperature": {"fitted": 2.5, "input": 1.0}}'), (2, '{"temperature": {"input": 3.0}}'), (3, '{"temperature": 4}'), (4, '{"fitted_temperature": 5.5}'), (5, '{"temperature": {"fitted": -1}}'), (6, "{}"), (7, None)]


@query("OP-014_temperature", "SELECT * FROM (VALUES (1, 2.5::DOUBLE), (2, 3.0), (3, 4.0), (4, 5.5), (5, 1.0), (6, 1.0), (7, 1.0)) t(id, temperature)")
def _(s, d):
    return s.createDataFrame(_CONFIGS, "id int, js string").select("id", jsonl.temperature(F.col("js")).alias("temperature"))


@query("OP-015_lookup_first", "SELECT l_orderkey AS k, coalesce(arg_min(l_returnflag || l_linenumber, l_extendedprice * 1000 + l_linenumber), '') AS v FROM lineitem GROUP BY 1")
def _(s, d):
    li = fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("v"), (F.col("l_extendedprice") * 1000 + F.col("l_linenumber")).alias("o"))
    return ca.lookup_first(li, "k", "o", "v")


@query("OP-016_lookup_last", "SELECT l_orderkey AS k, coalesce(arg_max(l_returnflag || l_linenumber, l_extendedprice * 1000 + l_linenumber), '') AS v FROM lineitem GROUP BY 1")
def _(s, d):
    li = fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("v"), (F.col("l_extendedprice") * 1000 + F.col("l_linenumber")).alias("o"))
    return ca.lookup_first(li, "k", "o", "v", keep_last=True)


@query("OP-017_inspect", "WITH f AS (SELECT row_number() OVER () - 1 AS row, * FROM (SELECT * FROM documents LIMIT 3)) " + " UNION ALL ".join(f"SELECT row, '{c}' AS \"column\", '{t}' AS \"type\", left({c}::VARCHAR, 160) AS value FROM f" for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))))
def _(s, d):
    return jsonl.inspect(fx.table(s, d, "documents"), 3, order=jsonl.FILE_ORDER)


@query("OP-018_jsonl_sink", f"WITH {CONV} SELECT problem_id, row_no, candidate FROM cc")
def _(s, d):
    path = scratch(s, "sink")
    jsonl.write_jsonl(fx.conv_candidates(s, d).select("problem_id", "row_no", "candidate"), path)
    return s.read.schema(_SCHEMA).json(path)


@query("OP-019_summary_sink", "SELECT count(*) AS n, 'x' AS name FROM conversations")
def _(s, d):
    path = scratch(s, "summary") + ".json"
    jsonl.write_summary(fx.table(s, d, "conversations").agg(F.count(F.lit(1)).alias("n"), F.lit("x").alias("name")), path)
    return s.read.option("multiLine", "true").schema("n long, name string").json(path)


@query("OP-020_markdown_report", f"WITH {LINE}, t AS (SELECT label, typechecks, count(*) AS n FROM lc GROUP BY 1, 2), r AS (SELECT row_number() OVER (ORDER BY label, typechecks) + 5 AS place, '| ' || label || ' | ' || CASE WHEN typechecks THEN 'yes' ELSE 'no' END || ' | ' || n || ' |' AS line FROM t) SELECT * FROM r UNION ALL SELECT * FROM (VALUES (0, '# Lines'), (1, ''), (2, '## By label'), (3, ''), (4, '| label | typechecks | n |'), (5, '| --- | --- | --- |')) v(place, line)")
def _(s, d):
    counts = fx.line_candidates(s, d).groupBy("label", "typechecks").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "typechecks")
    text = reports.report("Lines", [("By label", counts)])
    return s.createDataFrame(list(enumerate(text.splitlines())), "place long, line string")


_AB_SQL = "SELECT '# a and b' AS title, 8 AS lines, count(*) AS problems FROM (SELECT DISTINCT l_orderkey FROM lineitem)"


@query("OP-020_ab_report", _AB_SQL)
def _(s, d):
    from quorate.plans.catalog2 import _ab_metrics

    m = _ab_metrics(s, d)
    text = reports.ab_metrics(m, "a", "b")
    return s.createDataFrame([(text.splitlines()[0], len([x for x in text.splitlines() if x.startswith("|")]), m.first()["problems"])], "title string, lines int, problems long")


@query("OP-021_resumable_sink", f"WITH {LINE}, {_ARGMAX} SELECT problem_id, chosen_index FROM pick")
def _(s, d):
    path = scratch(s, "resume")
    rows = se.arg_max(fx.scored_lines(s, d)).select("problem_id", "chosen_index")
    jsonl.append_new(s, rows.filter("problem_id % 2 = 0"), path)
    jsonl.append_new(s, rows, path)
    jsonl.append_new(s, rows, path)
    return jsonl.read_sink(s, path, rows.schema)


@query("OP-022_memo_cache", f"WITH {CONV}, k AS (SELECT problem_id, row_no, sha256('h' || chr(10) || chr(10) || coalesce(candidate, '')) AS key FROM cc) SELECT * FROM k WHERE key NOT IN (SELECT key FROM k WHERE problem_id % 2 = 0)")
def _(s, d):
    rows = fx.conv_candidates(s, d).withColumn("header", F.lit("h"))
    store = jsonl.memo_store(s, scratch(s, "memo"))
    store.append_new(jsonl.cache_misses(rows.filter("problem_id % 2 = 0"), store).select("key", F.lit(True).alias("ok")))
    return jsonl.cache_misses(rows, store).select("problem_id", "row_no", "key")


@query("OP-023_id_lists", "SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(o_orderkey::VARCHAR) AS first, max(o_orderkey::VARCHAR) AS last FROM orders GROUP BY 1")
def _(s, d):
    path = scratch(s, "lists")
    jsonl.write_id_lists(fx.table(s, d, "orders").select(F.col("o_orderkey").alias("problem_id"), F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("test").alias("split")), path)
    out = None
    for name in ("train", "test"):
        ids = s.read.text(f"{path}/{name}_ids").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"), F.max("value").alias("last")).select(F.lit(name).alias("split"), "*")
        out = ids if out is None else out.unionByName(ids)
    return out


@query("OP-023_split_writer", "SELECT o_orderkey AS problem_id, CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM orders")
def _(s, d):
    path = scratch(s, "written")
    jsonl.write_splits(fx.table(s, d, "orders").select(F.col("o_orderkey").alias("problem_id"), F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("test").alias("split")), path)
    return s.read.schema("problem_id long, split string").json(path)


@query("OP-024_probe")
def _(s, d):
    return s.createDataFrame(sorted(jsonl.probe(s).items()), "name string, value string")


@query("OP-064_edge_filter", f"WITH {VEC}, {_COS} SELECT problem_id, i, j, round(score, 9) AS score FROM cosp WHERE round(score, 9) >= 0.3")
def _(s, d):
    return graph.threshold_edges(_cos(s, d), 0.3)


@query("OP-069_typecheck_filter", f"WITH {CONV} SELECT problem_id, candidate_index FROM cc WHERE length(coalesce(candidate, '')) % 2 = 0")
def _(s, d):
    good, _bad = scorers.typecheck_filter(fx.conv_candidates(s, d).withColumn("candidate", F.coalesce("candidate", F.lit(""))), lambda c: c.str.len() % 2 == 0)
    return good.select("problem_id", "candidate_index")


@query("OP-250_pair_model", f"WITH {CONV} SELECT a.problem_id, a.candidate_index AS i, b.candidate_index AS j, round(1 / (1 + exp(-(length(a.candidate) - length(b.candidate)) / 200.0::DOUBLE)), 9) AS score FROM cc a JOIN cc b ON a.problem_id = b.problem_id AND a.candidate_index < b.candidate_index")
def _(s, d):
    import pandas as pd

    from quorate.operators.pairs import pair_frame

    p = pair_frame(fx.conv_candidates(s, d), "candidate")
    out = scorers.equivalence_probability(p, "candidate_i", "candidate_j", lambda a, b: pd.DataFrame({0: [0.0] * len(a), 1: (a.str.len() - b.str.len()) / 100.0}), 2.0)
    return r9(out.select("problem_id", "i", "j", "score"))


@query("OP-251_statement_model", f"WITH {CONV} SELECT problem_id, candidate_index, length(candidate) / 7.0::DOUBLE AS score FROM cc")
def _(s, d):
    return scorers.statement_score(fx.conv_candidates(s, d), "candidate", "candidate", lambda a, b: b.str.len() / 7.0).select("problem_id", "candidate_index", "score")


@query("OP-252_embedding_model", f"WITH {CONV} SELECT problem_id, candidate_index, round(length(candidate) / sqrt(length(candidate)::DOUBLE ** 2 + 1), 9) AS x FROM cc")
def _(s, d):
    e = scorers.embed(fx.conv_candidates(s, d), "candidate", lambda t: t.map(lambda v: [float(len(v)), 1.0]))
    return r9(e.select("problem_id", "candidate_index", F.element_at("embedding", 1).alias("x")))


@query("OP-255_proof_model", f"WITH {CONV} SELECT a.problem_id, a.candidate_index AS i, b.candidate_index AS j, a.candidate = b.candidate AS ok FROM cc a JOIN cc b ON a.problem_id = b.problem_id AND a.candidate_index < b.candidate_index")
def _(s, d):
    import pandas as pd

    from quorate.operators.pairs import pair_frame

    p = pair_frame(fx.conv_candidates(s, d), "candidate").withColumnsRenamed({"candidate_i": "a", "candidate_j": "b"})
    return scorers.proof_outcomes(p, lambda a, b: pd.Series([q.startswith(v) for v, q in zip(a, b)])).select("problem_id", "i", "j", "ok")


@query("OP-256_typecheck_model", f"WITH {CONV} SELECT problem_id, candidate_index, length(candidate) % 3 = 0 AS typechecks FROM cc")
def _(s, d):
    c, store = fx.conv_candidates(s, d), jsonl.memo_store(s, scratch(s, "checks"))
    scorers.checked_once(c.filter("problem_id % 2 = 0"), lambda v: v.str.len() % 3 == 0, store)
    return scorers.checked_once(c, lambda v: v.str.len() % 3 == 0, store).select("problem_id", "candidate_index", "typechecks")


@query("OP-257_sampler", "SELECT c.problem_id, i::INTEGER AS candidate_index, 'about ' || c.problem_id || ' by ' || (7 * c.problem_id + i) AS candidate FROM (SELECT DISTINCT conv_id AS problem_id FROM conversations) c, range(3) t(i)")
def _(s, d):
    p = fx.table(s, d, "conversations").select(F.col("conv_id").alias("problem_id")).distinct().withColumn("prompt", F.concat(F.lit("about "), F.col("problem_id").cast("string")))
    # the stand-in for a model answers with its prompt and seed
    return scorers.sample_candidates(p, "prompt", 3, lambda prompt, seed: prompt + " by " + seed.astype(str), seed=lambda i: 7 * F.col("problem_id") + i).select("problem_id", "candidate_index", "candidate")


def _stand_in(prompt, seed):
    """Says what it is asked for; nothing where prompt and seed make a multiple of five, and the same for seeds that share a third."""
    return None if (len(prompt) + seed) % 5 == 0 else f"{prompt} {seed // 3}"


_SAMPLED = "WITH p AS (SELECT conv_id AS problem_id, count(*) AS n, arg_min(role, turn) AS prompt FROM conversations GROUP BY 1), m AS (SELECT problem_id, i, prompt || ' ' || ((problem_id + i) // 3) AS candidate FROM p, range(20) t(i) WHERE i < n AND (length(prompt) + problem_id + i) % 5 <> 0) SELECT problem_id, min(i)::INTEGER AS candidate_index, candidate FROM m GROUP BY problem_id, candidate"


def _prompts(s, d):
    return fx.table(s, d, "conversations").groupBy(F.col("conv_id").alias("problem_id")).agg(F.least(F.count(F.lit(1)), F.lit(20)).cast("int").alias("n"), F.min_by("role", "turn").alias("prompt"))


@query("OP-257_table_function", _SAMPLED)
def _(s, d):
    """As many samples as a conversation has turns, by a lateral join; a repeated or missing answer gives no row."""
    fn = scorers.register_sampler(s, "sampled", _stand_in)
    p = _prompts(s, d)
    return p.lateralJoin(fn(F.col("problem_id").outer(), F.col("prompt").outer(), F.col("n").outer(), F.col("problem_id").cast("int").outer()).select(F.col("problem_id").alias("of"), "candidate_index", "candidate")).select("problem_id", "candidate_index", "candidate")


@query("OP-257_table_function_sql", _SAMPLED)
def _(s, d):
    scorers.register_sampler(s, "sampled", _stand_in)
    _prompts(s, d).createOrReplaceTempView("quorate_prompts")
    return s.sql("SELECT s.* FROM quorate_prompts p, LATERAL sampled(p.problem_id, p.prompt, p.n, CAST(p.problem_id AS INT)) s")


@query("OP-258_timed_steps", f"WITH {LINE}, {_ARGMAX} SELECT 'choose' AS step, count(*) AS rows FROM pick UNION ALL SELECT 'evaluate', 1")
def _(s, d):
    run = Steps(s, scratch(s, "steps"))
    run.run("choose", lambda _: se.arg_max(fx.scored_lines(s, d)))
    run.run("evaluate", lambda r: ev.evaluate(ev.decisions(fx.line_candidates(s, d), r["choose"])))
    return run.timings().select("step", "rows")


# --- streams ---------------------------------------------------------------------------------------------------------------------

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _drain(s, stream, schema, mode="append"):
    """Run a stream over what is there, into a table in scratch space."""
    path, check = scratch(s, "stream"), scratch(s, "stream-state")

    def write(batch, batch_id):
        batch.write.mode("append").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(schema).parquet(path)


@query("STREAM_windowed_accuracy", "WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS method, (value >= 50)::INTEGER AS correct, ts FROM events) SELECT window_start, method, count(*) AS n, sum(correct)::BIGINT AS n_correct FROM e GROUP BY 1, 2 HAVING window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def _(s, d):
    ev_ = live.read_stream(s, f"{d}/events.parquet*", _EVENTS).select("ts", F.col("event_type").alias("method"), (F.col("value") >= 50).cast("int").alias("correct"))
    out = live.windowed_accuracy(ev_, "1 day", "2 hours")
    return _drain(s, out, "window_start timestamp, method string, n long, n_correct long, accuracy double").drop("accuracy")


@query("STREAM_running_choice", "SELECT user_id AS problem_id, arg_max(event_id, (value, -event_id)) AS chosen_index, max(value) AS score FROM events GROUP BY 1")
def _(s, d):
    ev_ = live.read_stream(s, f"{d}/events.parquet*", _EVENTS).select(F.col("user_id").alias("problem_id"), F.col("event_id").cast("int").alias("candidate_index"), F.col("value").alias("score"))
    out = _drain(s, live.running_choice(ev_), "problem_id long, chosen_index int, score double", "update")
    # of a problem's updates the last has the best score
    return out.groupBy("problem_id").agg(F.max_by(F.struct(F.col("chosen_index").cast("long").alias("chosen_index"), "score"), F.struct("score", -F.col("chosen_index"))).alias("b")).select("problem_id", "b.*")


_CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events WHERE event_id % 7 <> 0)"


def _deliveries(s, d):
    """The events in three files: most, those of the last hour, and late ones, ten days older than the newest. A batch drops what is older than the
    watermark that the batch before it began with, so that the third is the first that can."""
    path, e = scratch(s, "deliveries"), fx.table(s, d, "events")
    late = F.col("event_id") % 7 == 0
    newest = F.lit(e.filter(~late).agg(F.max("ts")).first()[0])
    last = F.col("ts") >= newest - F.expr("INTERVAL 1 HOUR")
    for n, part in enumerate((e.filter(~late & ~last), e.filter(~late & last), e.filter(late & (F.col("ts") < newest - F.expr("INTERVAL 10 DAYS"))))):
        part.repartition(1).write.parquet(f"{path}/part={n}")
    return live.read_stream(s, f"{path}/part=*", _EVENTS, files_per_trigger=1)


@query("STREAM_sessions", f"WITH e AS (SELECT user_id, ts FROM events WHERE event_id % 7 <> 0), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM e)) SELECT user_id AS problem_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}")
def _(s, d):
    rows = _deliveries(s, d).select("ts", F.col("user_id").alias("problem_id"))
    return _drain(s, live.sessions(rows, "6 hours", "2 hours"), "problem_id long, session_start timestamp, session_end timestamp, n long")


@query("STREAM_closing_choice", f"WITH e AS (SELECT * FROM events WHERE event_id % 7 <> 0) SELECT user_id AS problem_id, arg_max(event_id, (value, -event_id))::INTEGER AS chosen_index, max(value) AS score, count(*) AS n FROM e GROUP BY 1 HAVING max(ts) + INTERVAL 12 HOUR <= {_CLOSED}")
def _(s, d):
    """Users without an event for twelve hours: their best event, given out once; late events change nothing."""
    own = s.newSession()
    for k, v in {**{"spark.sql.session.timeZone": s.conf.get("spark.sql.session.timeZone"), "spark.sql.shuffle.partitions": s.conf.get("spark.sql.shuffle.partitions")}, **live.STATE_STORE}.items():
        own.conf.set(k, v)
    rows = _deliveries(own, d).select(F.col("user_id").alias("problem_id"), F.col("event_id").cast("int").alias("candidate_index"), F.col("value").alias("score"), "ts")
    out = "problem_id long, chosen_index int, score double, n long"
    path = _drain(own, live.closing_choice(rows, 12 * 60), out).inputFiles()
    return s.read.schema(out).parquet(*path) if path else s.createDataFrame([], out)
