"""Source divergence audit with de-duplicated count columns (operator 12).

How often each source of a language uses each term is a sparse vector of counts for each term.  Terms with identical vectors add the same to
every pair of sources, so terms are grouped by their vector, each distinct vector meets the pairs once, and what it adds is multiplied by
the number of its terms.  Terms that neither source of a pair has are not met at all: a pair begins with what all terms would add if
neither had any, and each vector adds its difference from that.

Sources of a language are numbered and cut into blocks; a tile is a pair of blocks of one language, and a task holds a bounded part of a tile's
distinct vectors as a dense array of at most PART x 2 BLOCK numbers.  So neither many sources nor many terms meet in one place, and nothing
but a table's counted sizes reaches the driver.  The term report ranks the terms themselves.

All arithmetic is whole numbers: shares are billionths, rounded down, plus one.

Defined cases: null texts, languages and sources are empty strings; texts of any length are read in slices between terms; repeated rows are rows;
an (lang, source) group without kept terms, or a language without any, still has its pairs, with the value that the smoothing gives (0
where the language keeps no term); a language with one source has no pairs; ties rank by the item's UTF-8 bytes; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread_join, text_slices

#: A language keeps the terms in at least this many of its documents.
MIN_DOCS = 30
#: Added to every count before shares are taken, and the whole that shares are parts of.
SMOOTH, WHOLE = 5, 1_000_000_000
#: Ranks of the term report.
TOP_TERMS = 50
#: Sources in a block, and distinct vectors in a part of a tile, about.
BLOCK, PART = 256, 4096
#: Terms that a task counts before it passes its counts on, and bytes of a text that are cut into terms at a time.
HELD, SLICE = 400_000, 1 << 20
#: A-Z to a-z, other letters and all bytes of longer signs to themselves, what separates terms to a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(data: bytes, fold: bytes = FOLD, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text, given as bytes, in lists of about ``size`` bytes each, cut between terms."""
    begin = 0
    while begin < len(data):
        end = begin + size
        if end < len(data):
            # to the end of the term that the cut would split
            rest = data[end:end + 4096].translate(fold)
            while (at := rest.find(b" ")) < 0 and end + len(rest) < len(data):
                end += len(rest)
                rest = data[end:end + size].translate(fold)
            end = end + at if at >= 0 else len(data)
        if words := data[begin:end].translate(fold).split():
            yield words
        begin = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, df): occurrences of each term in each group, and documents that have it."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("df", pa.int64())])

    def passed_on(held):
        for (lang, source), (counts, seen) in held.items():
            terms = list(counts)
            for a in range(0, len(terms), 50_000):
                some = terms[a:a + 50_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in some], pa.int64()), pa.array([seen[t] for t in some], pa.int64())], schema=kinds)

    def run(batches):
        held: dict = {}
        for batch in batches:
            for a, texts in text_slices(batch.column(2), 4_000_000):
                for lang, source, text in zip(batch.column(0).slice(a, len(texts)).to_pylist(), batch.column(1).slice(a, len(texts)).to_pylist(), texts):
                    if (lang, source) not in held:
                        held[lang, source] = (Counter(), Counter())
                    counts, seen = held[lang, source]
                    mine: set = set()
                    for words in words_of(text.encode()):
                        counts.update(words)
                        mine.update(words)
                    seen.update(mine)
                if sum(len(c) for c, _ in held.values()) > HELD:
                    yield from passed_on(held)
                    held = {}
        yield from passed_on(held)

    long = rows.mapInArrow(run, "lang string, source string, term string, c long, df long")
    return long.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))


def _share(count: str, n: str, v: str):
    """1 + floor(WHOLE * (count + SMOOTH) / (n + SMOOTH * v)), exactly; null where v is 0."""
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + (cast({count} + {SMOOTH} AS decimal(20,0)) * {WHOLE}) div cast({n} + {SMOOTH} * {v} AS decimal(20,0)) END").cast("long")


def kept_counts(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The counts of kept terms, (lang, source, term, c, total), and the groups, (lang, source, sid, n, v, n_lang, rows): the source's
    number, occurrences of kept terms there, kept terms of the language, their occurrences in it, and the group's rows of counts."""
    counts = materialize(term_counts(docs), "term-counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("c").alias("total"), F.sum("df").alias("df")).filter(F.col("df") >= min_docs).select("lang", "term", "total"), "kept-terms")
    own = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "c", "total"), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = own.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("rows"))
    sid = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sized = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "rows", "v", "n_lang"])
    return own, materialize(sized.withColumn("sid", sid), "groups")


def telling_terms(own: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): each group's terms with a larger share there than in the language, the largest differences first."""
    met = spread_join(own, groups.select("lang", "source", "n", "v", "n_lang", "rows"), ["lang", "source"], "rows", own.count())
    shares = met.select("lang", "source", F.col("term").alias("item"), _share("c", "n", "v").alias("p"), _share("total", "n_lang", "v").alias("q"))
    over = shares.filter("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return over.withColumn("rank", best).filter(F.col("rank") <= top)


def distinct_vectors(own: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(lang, ta, tb, va, vb, m): of each tile the distinct pairs of count vectors over its two blocks, and how many terms have each.

    An entry of a vector is (sid, c, p); vb is null in the tile of a block with itself."""
    blocks = groups.groupBy("lang").agg((F.floor(F.max("sid") / block) + 1).cast("int").alias("blocks"))
    numbered = spread_join(own, groups.select("lang", "source", "sid", "n", "v", "rows"), ["lang", "source"], "rows", own.count())
    entry = F.struct("sid", "c", _share("c", "n", "v").alias("p"))
    vectors = (numbered.select("lang", "term", F.floor(F.col("sid") / block).cast("int").alias("b"), entry.alias("e"))
               .groupBy("lang", "term", "b").agg(F.array_sort(F.collect_list("e")).alias("vec")))
    # a language's number of blocks is one row for each language
    tiled = vectors.join(blocks, "lang").select("lang", "term", "b", "vec", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    a, b = F.least("b", "x").alias("ta"), F.greatest("b", "x").alias("tb")
    sides = tiled.select("lang", "term", a, b, F.when(F.col("b") <= F.col("x"), F.col("vec")).alias("va"), F.when(F.col("b") > F.col("x"), F.col("vec")).alias("vb"))
    each = sides.groupBy("lang", "ta", "tb", "term").agg(F.first("va", True).alias("va"), F.first("vb", True).alias("vb"))
    return each.groupBy("lang", "ta", "tb", "va", "vb").agg(F.count(F.lit(1)).alias("m"))


def _dense(column: pa.Array, base: np.ndarray, first: int) -> np.ndarray:
    """Rows of shares: the entries of a column of vectors, and elsewhere the shares of sources without the term."""
    out = np.tile(base, (len(column), 1))
    counts = np.diff(column.offsets.to_numpy())
    entries = column.flatten()
    counts = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, counts)
    out[np.repeat(np.arange(len(column)), counts), entries.field("sid").to_numpy() - first] = entries.field("p").to_numpy()
    return out


def _tile_sums(key, table: pa.Table, block: int) -> pa.Table:
    """(lang, a, b, value): what a part of a tile's vectors adds to each pair of its sources. One row, the head, names the sources, their shares of a
    term that they lack, and how many terms the pairs begin with."""
    table = table.combine_chunks()
    is_head = pa.compute.is_valid(table["names_a"])
    head, rows = table.filter(is_head).to_pylist()[0], table.filter(pa.compute.invert(is_head)).combine_chunks()
    ta, tb = head["ta"], head["tb"]
    names_a, names_b = head["names_a"], head["names_b"]
    za, zb = np.array(head["za"], np.int64), np.array(head["zb"], np.int64)
    floor = np.abs(za[:, None] - zb[None, :])
    total = floor * head["m"]
    if len(rows):
        column = lambda name: pa.concat_arrays(rows[name].chunks)
        m = rows["m"].to_numpy()
        pa_ = _dense(column("va"), za, ta * block)
        pb = pa_ if ta == tb else _dense(column("vb"), zb, tb * block)
        for i in range(len(za)):
            total[i] += (np.abs(pa_[:, i, None] - pb) * m[:, None]).sum(0) - floor[i] * m.sum()
    i, j = np.triu_indices(len(za), 1) if ta == tb else (x.ravel() for x in np.indices(total.shape))
    take = lambda names, at: pa.array(names, pa.string()).take(pa.array(at, pa.int64()))
    return pa.table([pa.array([head["lang"]] * len(i), pa.string()), take(names_a, i), take(names_b, j), pa.array(total[i, j], pa.int64())], names=["lang", "a", "b", "value"])


def pair_divergence(own: DataFrame, groups: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(lang, source, item, value, rank): for each source the others of its language by the sum of differences of shares over all kept terms."""
    tile = ["lang", "ta", "tb"]
    vectors = materialize(distinct_vectors(own, groups, block), "vectors")
    sides = groups.select("lang", "v", F.floor(F.col("sid") / block).cast("int").alias("b"), F.struct("sid", F.col("source").alias("name"), F.coalesce(_share("0", "n", "v"), F.lit(0)).alias("z")).alias("s"))
    sides = sides.groupBy("lang", "b").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("s")).alias("s"))
    other = sides.select("lang", F.col("b").alias("tb"), F.col("s").alias("s_b"))
    # one row for each block of 256 sources on either side
    pairs = sides.select("lang", F.col("b").alias("ta"), "v", F.col("s").alias("s_a")).join(other, "lang").filter("ta <= tb")
    sizes = vectors.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    heads = pairs.join(sizes, tile, "left").fillna(1, ["parts"])
    head = heads.select(*tile, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.when(F.col("part") == 0, F.col("v")).otherwise(0).alias("m"),
                        F.col("s_a.name").alias("names_a"), F.col("s_b.name").alias("names_b"), F.col("s_a.z").alias("za"), F.col("s_b.z").alias("zb"))
    # a tile's number of parts is one row for each tile
    dealt = vectors.join(heads.select(*tile, "parts"), tile).withColumn("part", F.pmod(F.xxhash64("va", "vb"), F.col("parts")).cast("int")).drop("parts")
    sums = dealt.unionByName(head, allowMissingColumns=True).groupBy(*tile, "part").applyInArrow(lambda k, t: _tile_sums(k, t, block), "lang string, a string, b string, value long")
    total = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = total.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Operator 12: lang, source, part (pair or term), item, value, rank."""
    own, groups = kept_counts(docs, min_docs)
    reports = {"pair": pair_divergence(own, groups, block, part), "term": telling_terms(own, groups, top)}
    a, b = (df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for name, df in reports.items())
    return a.unionByName(b)


_P = f"(1 + ({WHOLE}::HUGEINT * ({{c}} + {SMOOTH})) // ({{n}} + {SMOOTH} * v))::BIGINT"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= {MIN_DOCS}),
lg AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n_lang FROM k GROUP BY 1),
o AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(n_lang, 0) AS n_lang FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c)::BIGINT AS n FROM o GROUP BY ALL) USING (lang, source) LEFT JOIN lg USING (lang)),
f AS (SELECT g.lang, g.source, term, coalesce(c, 0) AS c, {_P.format(c="coalesce(c, 0)", n="n")} AS p, {_P.format(c="total", n="n_lang")} AS q FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
