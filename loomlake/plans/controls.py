"""Registered queries for the control analyses: stability, matched subsamples, offsets, nulls, folds and integrity.

They use the same analogues on the fixture tables as the catalog.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlake.functions import sequences as sq
from loomlake.functions import vectors
from loomlake.functions.alignment import shift
from loomlake.operators import dedup, metrics, ordering, resampling, sampling, structures
from loomlake.plans import catalog as c
from loomlake.plans.catalog import query
from loomlake.scratch import Scratch
from loomlake.session import table

_HEX = "('0x' || substr(md5({}), 1, 13))::BIGINT"
#: The area under the curve by group from mid-ranks, for (g, y, score) rows in r.
_RANKED = "m AS (SELECT g, y, 2 * rank() OVER (PARTITION BY g ORDER BY score) + count(*) OVER (PARTITION BY g, score) - 1 AS r2 FROM r), a AS (SELECT g, sum(r2) FILTER (y = 1) - p * (p + 1) AS u2, p, n FROM (SELECT *, count(*) FILTER (y = 1) OVER (PARTITION BY g) AS p, count(*) FILTER (y = 0) OVER (PARTITION BY g) AS n FROM m) GROUP BY g, p, n), auc AS (SELECT g, u2::DOUBLE / (2 * p * n) AS auc, p, n FROM a WHERE p > 0 AND n > 0)"


_STABLE = f"WITH {c._LONG}, r AS (SELECT {{'draw': draw, 'latent': latent}} AS g, pos::INT AS y, v AS score FROM l, range(0, 10) AS d(draw) WHERE {_HEX.format("'half|' || draw || '|' || vec_id")} % 2 = 0), {_RANKED}, top AS (SELECT g.latent AS latent, 2 * auc - 1 AS delta, row_number() OVER (PARTITION BY g.draw ORDER BY auc DESC, g.latent) AS place FROM auc) SELECT latent, count(*) FILTER (place <= 10) AS n_top, min(delta) AS least, count(*) FILTER (place <= 10) >= 0.75 * 10 AS stable FROM top GROUP BY latent"


@query()
def stability_selection(spark, d):
    """How often each latent is among the ten best of 200 halves; stable where that is three in four and the effect over all rows 0.9 or more."""
    n_draws = 200
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") == 0).cast("int").alias("y"), "embedding")
    auc = Scratch(spark, "stable").write(resampling.half_areas(rows, "vec_id", "embedding", "y", n_draws), "areas")
    delta = auc.where(F.col("draw") == n_draws).select("latent", (2 * F.col("auc") - 1).alias("delta"))
    strong = F.coalesce(F.col("delta") >= 0.9, F.lit(False))
    placed = auc.where(F.col("draw") < n_draws).withColumn("place", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("auc"), "latent")))
    n_top = F.count_if(F.col("place") <= 10)
    often = placed.groupBy("latent").agg(n_top.alias("n_top"), F.min(2 * F.col("auc") - 1).alias("least"), (n_top >= 0.75 * n_draws).alias("often"))
    return often.join(delta, "latent", "left").select("latent", "n_top", "least", "delta", (F.col("often") & strong).alias("stable"))


@query(f"WITH {c.HUB}, chosen AS (SELECT draw, doc_id FROM hub, range(0, 500) AS d(draw) WHERE y = 1 QUALIFY row_number() OVER (PARTITION BY draw ORDER BY {_HEX.format("'size|' || draw || '|' || doc_id")}, doc_id) <= 20), r AS (SELECT draw AS g, 1 AS y, score FROM chosen JOIN hub USING (doc_id) UNION ALL SELECT draw, 0, score FROM hub, range(0, 500) AS d(draw) WHERE y = 0), {_RANKED} SELECT count(*) AS n, quantile_cont(auc, 0.05) AS low, quantile_cont(auc, 0.5) AS middle, quantile_cont(auc, 0.95) AS high FROM auc")
def size_matched_control(spark, d):
    return _size_matched(spark, d, 500)


def _size_matched(spark, d, n_draws):
    h = c.hub(spark, d).select("doc_id", "y", "score", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    order = resampling.hash_number(F.lit("size"), F.col("draw"), F.col("doc_id"))
    some = sampling.top_per_group(h.where("y = 1"), "draw", [order, "doc_id"], 20).drop("place")
    auc = metrics.ranking(some.union(h.where("y = 0").select(*some.columns)), ["draw"])
    return resampling.interval(auc.where("auc is not null"), "auc", 0.9)


@query()
def mean_and_error(spark, d):
    return _mean_and_error(spark, d, 2000)


def _mean_and_error(spark, d, n_draws):
    draws = resampling.bootstrap(c.hub(spark, d), "grp", n_draws)
    return draws.agg(F.count("*").alias("n"), F.round(F.avg("auc"), 9).alias("mean"), F.round(F.stddev_samp("auc") / F.sqrt(F.count("*")), 9).alias("se"))


@query()
def probe_grid(spark, d):
    """Log-loss on the held-out 30 % for each strength of regularisation; the best one is marked."""
    from loomlake.operators.probe import fit_scores

    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("y"))
    p = F.least(F.greatest("score", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = F.avg(-F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p)))
    held = lambda C: fit_scores(rows, "vec_id", "embedding", "y", C).where(F.pmod(F.xxhash64("vec_id"), F.lit(10)) >= 7)
    grid = reduce(lambda a, b: a.union(b), (held(C).agg(F.lit(C).alias("C"), loss.alias("log_loss")) for C in (1e-3, 1e-2, 1e-1, 1.0)))
    return grid.withColumn("best", F.col("log_loss") == F.min("log_loss").over(Window.partitionBy()))


@query(f"WITH {c.HUB}, f AS (SELECT y, {_HEX.format("'outer|' || grp")} % 5 AS outer_fold, {_HEX.format("'inner|' || grp")} % 4 AS inner_fold, grp FROM hub) SELECT outer_fold, inner_fold, count(*) AS n, count(DISTINCT grp) AS n_groups, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0 AS defined FROM f GROUP BY 1, 2")
def nested_group_folds(spark, d):
    fold = lambda name, k: (resampling.hash_number(F.lit(name), F.col("grp")) % k).alias(f"{name}_fold")
    f = c.hub(spark, d).select("y", "grp", fold("outer", 5), fold("inner", 4))
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    return f.groupBy("outer_fold", "inner_fold").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("n_groups"), pos.alias("n_pos"), ((pos > 0) & (neg > 0)).alias("defined"))


_MOTIF = f"s AS (SELECT doc_id, lang, {c.SEQ} AS s FROM documents), p AS (SELECT *, length(regexp_extract(s, '^(.*?)E[STN]H', 1)) AS peak FROM s WHERE regexp_matches(s, 'E[STN]H'))"


def _peaks(spark, d):
    docs = c.docs_(spark, d).where(F.col("seq").rlike("E[STN]H"))
    return docs.select("doc_id", "lang", "seq", (F.regexp_instr("seq", F.lit("E[STN]H")) - 1).alias("peak"))


@query(f"WITH {_MOTIF}, o AS (SELECT lang, length(regexp_extract(s, '^([^A]*)', 1)) - peak AS off, count(*) AS n FROM p GROUP BY 1, 2) SELECT lang, off, n FROM o QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, off) = 1")
def modal_offset(spark, d):
    off = F.length(F.regexp_extract("seq", "^([^A]*)", 1)) - F.col("peak")
    n = _peaks(spark, d).groupBy("lang", off.alias("off")).agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.max_by(F.struct("off", "n"), F.struct("n", -F.col("off"))).alias("m")).select("lang", "m.off", "m.n")


#: Sites of a peak: distance from it and the letters allowed there.
SITES = ((-4, "AEIO"), (5, "RST"), (9, "EN"))
_LETTER = "CASE WHEN peak + {0} BETWEEN 0 AND length(s) - 1 THEN contains('{1}', substr(s, (peak + {0} + 1)::INT, 1)) ELSE false END"
_TIER = "CASE WHEN {exact} THEN 'exact' WHEN {near} THEN 'recovered' ELSE 'miss' END"


def _tier_sql(off, letters):
    slides = [k for k in range(-3, 4) if k]
    return _TIER.format(exact=_LETTER.format(off, letters), near=" OR ".join(_LETTER.format(off + k, letters) for k in slides))


def _tier(off, letters):
    has = lambda k: F.coalesce(sq.letter_at(F.col("seq"), F.col("peak") + k).isin(*letters), F.lit(False))
    near = reduce(lambda a, b: a | b, (has(off + k) for k in range(-3, 4) if k))
    return F.when(has(off), "exact").when(near, "recovered").otherwise("miss")


@query(f"WITH {_MOTIF}, t AS (SELECT doc_id, {', '.join(f'{_tier_sql(*x)} AS t{i}' for i, x in enumerate(SITES))} FROM p), h AS (SELECT *, (t0 = 'exact')::INT + (t1 = 'exact')::INT + (t2 = 'exact')::INT AS hits FROM t) SELECT *, CASE hits WHEN 3 THEN 'all' WHEN 0 THEN 'none' ELSE 'partial' END AS rollup FROM h")
def site_tiers(spark, d):
    t = _peaks(spark, d).select("doc_id", *(_tier(*x).alias(f"t{i}") for i, x in enumerate(SITES)))
    hits = reduce(lambda a, b: a + b, ((F.col(f"t{i}") == "exact").cast("int") for i in range(len(SITES))))
    t = t.withColumn("hits", hits)
    return t.withColumn("rollup", F.when(F.col("hits") == 3, "all").when(F.col("hits") == 0, "none").otherwise("partial"))


@query(f"WITH {c._LONG}, r AS (SELECT latent, count(*) FILTER (pos AND v > 0) AS rate FROM l GROUP BY latent) SELECT a.latent, a.rate, count(*) FILTER (b.rate > a.rate) AS higher, count(*) FILTER (b.rate = a.rate) - 1 AS tied FROM r a, r b GROUP BY 1, 2")
def null_percentile(spark, d):
    r = c._long(spark, d).groupBy("latent").agg(F.count_if(F.col("pos") & (F.col("v") > 0)).alias("rate"))
    same = Window.partitionBy("rate")
    return r.select("latent", "rate", (F.rank().over(Window.orderBy(F.desc("rate"))) - 1).cast("bigint").alias("higher"), (F.count("*").over(same) - 1).alias("tied"))


@query(f"WITH {c.HUB}, r AS (SELECT 'raw' AS g, y, score FROM hub UNION ALL SELECT 'coarse', y, floor(score * 20) FROM hub), {_RANKED} SELECT raw.auc AS raw, coarse.auc AS coarse, coarse.auc / raw.auc AS ratio FROM auc raw, auc coarse WHERE raw.g = 'raw' AND coarse.g = 'coarse'")
def reconstruction_gate(spark, d):
    h = c.hub(spark, d)
    both = h.select("y", "score", F.lit("raw").alias("g")).union(h.select("y", F.floor(F.col("score") * 20).cast("double"), F.lit("coarse")))
    auc = metrics.ranking(both, ["g"])
    one = auc.agg(F.max(F.when(F.col("g") == "raw", F.col("auc"))).alias("raw"), F.max(F.when(F.col("g") == "coarse", F.col("auc"))).alias("coarse"))
    return one.withColumn("ratio", F.try_divide("coarse", "raw"))


@query("SELECT source, count(*) AS n, count(*) AS n_read, 0::BIGINT AS n_lost FROM documents GROUP BY source")
def integrity(spark, d):
    """What a written table holds when read again, against its input: rows, and rows that differ."""
    docs = table(spark, d, "documents")
    return dedup.lost_rows(docs, Scratch(spark, "integrity").write(docs, "documents"), "source")


@query(f"WITH RECURSIVE {c._PAIRS}, {c._EDGES}, {c._ROOTS}, s AS (SELECT doc_id, {c._SPLIT} AS split FROM documents), known AS (SELECT DISTINCT component FROM comp JOIN s USING (doc_id) JOIN labels USING (doc_id) WHERE split = 'train' AND quality = 1) SELECT doc_id, component IN (SELECT component FROM known) AS related FROM comp JOIN s USING (doc_id) WHERE split = 'test'")
def held_out_relatives(spark, d):
    comp = c._components(spark, d).withColumn("split", F.expr(c._SPLIT))
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    known = comp.where("split = 'train'").join(good, "doc_id", "left_semi").select("component").distinct().withColumn("hit", F.lit(True))
    return comp.where("split = 'test'").join(known, "component", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("related"))


@query(f"WITH {c._LONG}, picks AS (SELECT draw, latent FROM range(0, 200) AS d(draw), range(0, 64) AS f(latent) QUALIFY row_number() OVER (PARTITION BY draw ORDER BY {_HEX.format("'features|' || draw || '|' || latent")}, latent) <= 9), r AS (SELECT draw AS g, pos::INT AS y, sum(floor(v * 1000)) AS score FROM l JOIN picks USING (latent) GROUP BY draw, vec_id, pos), {_RANKED} SELECT g AS draw, auc FROM auc")
def random_feature_control(spark, d):
    return _random_features(spark, d, 200)


def _random_features(spark, d, n_draws):
    grid = spark.range(n_draws).withColumnRenamed("id", "draw").withColumn("latent", F.explode(F.sequence(F.lit(0), F.lit(63))))
    order = resampling.hash_number(F.lit("features"), F.col("draw"), F.col("latent"))
    picks = sampling.top_per_group(grid, "draw", [order, "latent"], 9).drop("place")
    # nine rows a draw
    rows = c._long(spark, d).join(F.broadcast(picks), "latent").groupBy("draw", "vec_id", F.col("pos").cast("int").alias("y")).agg(F.sum(F.floor(F.col("v") * 1000)).alias("score"))
    return metrics.ranking(rows, ["draw"]).where("auc is not null").select("draw", "auc")


@query("WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), o AS (SELECT vec_id AS i, x AS a, y AS b, z AS c FROM x ORDER BY vec_id LIMIT 1) SELECT vec_id, round(sqrt((x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c)), 9) AS d3, vec_id - i AS dseq FROM x, o")
def distance_to_site(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")))
    site = x.orderBy("vec_id").limit(1).toDF("i", "a", "b", "c")
    square = lambda p, q: (F.col(p) - F.col(q)) * (F.col(p) - F.col(q))
    return x.crossJoin(F.broadcast(site)).select("vec_id", F.round(F.sqrt(square("x", "a") + square("y", "b") + square("z", "c")), 9).alias("d3"), (F.col("vec_id") - F.col("i")).alias("dseq"))


@query("SELECT p_partkey, (list_sort(list_transform([5, 17, 23, 42], lambda g: {'gap': abs(g - p_size), 'g': g})))[1].g AS nearest, list_min(list_transform([5, 17, 23, 42], lambda g: abs(g - p_size))) <= 1 AS confirmed FROM part")
def nearest_element(spark, d):
    size = F.col("p_size")
    near = sq.nearest(F.array(*map(F.lit, (5, 17, 23, 42))), size)
    return table(spark, d, "part").select("p_partkey", near.alias("nearest"), (F.abs(near - size) <= 1).alias("confirmed"))


@query(f"WITH {c.HUB}, r AS (SELECT tier AS g, y, score FROM hub), {_RANKED} SELECT g AS tier, auc, p AS n_pos, n AS n_neg FROM auc WHERE p >= 3 AND p + n >= 10")
def subset_control(spark, d):
    return metrics.ranking(c.hub(spark, d), ["tier"]).where("auc is not null and n_pos >= 3 and n_pos + n_neg >= 10").select("tier", "auc", "n_pos", "n_neg")


@query()
def shift_alignment(spark, d):
    """The best of all shifts of whole sequences along the first one."""
    docs = c.docs_(spark, d).select("doc_id", F.col("seq").alias("a"))
    first = docs.orderBy("doc_id").limit(1).select(F.col("a").alias("b"))
    both = docs.repartition(spark.sparkContext.defaultParallelism * 4).crossJoin(F.broadcast(first))
    return both.select("doc_id", shift(F.col("a"), F.col("b")).alias("m")).select("doc_id", "m.shift", "m.matches")


@query(f"WITH {_MOTIF}, n AS (SELECT draw, lang, s, peak, row_number() OVER (PARTITION BY draw, lang ORDER BY doc_id) AS i, row_number() OVER (PARTITION BY draw, lang ORDER BY {_HEX.format("'pairing|' || draw || '|' || doc_id")}, doc_id) AS j FROM p, range(0, 200) AS d(draw)), x AS (SELECT a.draw, a.lang, a.s, b.peak FROM n a JOIN n b ON a.draw = b.draw AND a.lang = b.lang AND a.i = b.j) SELECT draw, lang, count(*) AS n, count(*) FILTER ({_LETTER.format(*SITES[1])}) AS hits FROM x GROUP BY draw, lang")
def shuffled_pairing(spark, d):
    """Hits at a site when each sequence gets the peak of another one of its stratum, by 200 random permutations.

    Hashes, places and peaks travel; a sequence meets all the peaks that it gets in one task.
    """
    off, letters = SITES[1]
    return resampling.paired_hits(_peaks(spark, d), "doc_id", "lang", "seq", "peak", off, letters, 200, "pairing").select("draw", "lang", "n", "hits")


@query("WITH u AS (SELECT l_orderkey, l_returnflag, l_linenumber, min(l_partkey) FILTER (l_linestatus = 'F') AS num FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT l_orderkey, l_returnflag, count(num) AS n_matched, count(*) AS length, min(l_linenumber) AS first, coalesce(string_agg(l_linenumber || ':' || num, ',' ORDER BY l_linenumber) FILTER (num IS NOT NULL), '') AS numbers FROM u GROUP BY 1, 2) SELECT l_orderkey, l_returnflag, n_matched, n_matched::DOUBLE / length AS coverage, numbers FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n_matched DESC, first, l_returnflag) = 1")
def best_chain(spark, d):
    """Orders as sequences, return flags as chains, lines as residues."""
    best = structures.best_chain(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", F.col("l_linestatus") == "F")
    as_text = F.transform(F.map_entries("numbers"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return best.withColumn("numbers", F.array_join(as_text, ","))


#: Fixed weights of 8 features over 64 numbers for the query below: 1, -1 or 0 by place.
_WEIGHTS = [[float((i * 7 + j * 3) % 5 % 3 - 1) for j in range(64)] for i in range(8)]
_BIAS = [0.125 * (j % 3) for j in range(64)]
_LIST = "[{}]".format(", ".join("[{}]".format(", ".join(f"{w}::DOUBLE" for w in row)) for row in _WEIGHTS))
_OFFSET = "[{}]".format(", ".join(f"{b}::DOUBLE" for b in _BIAS))


@query(f"WITH w AS (SELECT {_LIST} AS w, {_OFFSET} AS b), z AS (SELECT vec_id, embedding::DOUBLE[] AS x, w, b, list_transform(w, lambda r: greatest(list_sum(list_transform(range(1, 65), lambda j: (embedding[j]::DOUBLE - b[j]) * r[j])), 0)) AS z FROM embeddings, w), y AS (SELECT vec_id, x, z, list_transform(range(1, 65), lambda j: list_sum(list_transform(range(1, 9), lambda i: z[i] * w[i][j])) + b[j]) AS y FROM z) SELECT vec_id, len(list_filter(z, lambda v: v > 0)) AS n_active, round(list_sum(z), 6) AS total, round(list_sum(list_transform(range(1, 65), lambda j: x[j] * y[j])) / (sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(y, lambda v: v * v)))), 6) AS fidelity FROM y")
def sparse_round_trip(spark, d):
    """Features in use and the cosine of each vector to its reconstruction."""
    coded = table(spark, d, "embeddings").withColumn("z", vectors.sparse_code(F.col("embedding"), _WEIGHTS, _BIAS))
    whole = coded.withColumn("y", vectors.sparse_decode(F.col("z"), _WEIGHTS, _BIAS))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + v)
    return whole.select("vec_id", vectors.active(F.col("z")).cast("bigint").alias("n_active"), F.round(total, 6).alias("total"), F.round(vectors.cosine(F.col("embedding"), F.col("y")), 6).alias("fidelity"))


@query()
def probe_key_sweep(spark, d):
    """Held-out log-loss for each feature key (halves of the vector, all of it) and strength; the best of each key and of all are marked."""
    from loomlake.operators.probe import fit_scores

    keys = {"all": F.col("embedding"), "first": F.slice("embedding", 1, 32), "second": F.slice("embedding", 33, 32)}
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") < 3).cast("int").alias("y"), *(v.alias(k) for k, v in keys.items()))
    p = F.least(F.greatest("score", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = F.avg(-F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p)))

    def held(key, C):
        scored = fit_scores(rows, "vec_id", key, "y", C).where(F.pmod(F.xxhash64("vec_id"), F.lit(10)) >= 7)
        return scored.agg(F.lit(key).alias("feature"), F.lit(C).alias("C"), loss.alias("log_loss"))

    grid = reduce(lambda a, b: a.union(b), (held(k, C) for k in keys for C in (1e-3, 1e-1)))
    least = lambda *by: F.min("log_loss").over(Window.partitionBy(*by))
    return grid.select("*", (F.col("log_loss") == least("feature")).alias("best_of_feature"), (F.col("log_loss") == least()).alias("best"))


# --- SQL of the queries that take all draws -----------------------------------------------------------------------------------


def _drawn(n: int, seed: str, key: str = "grp", strata: str = "") -> str:
    """Weighted draws of whole groups, w (draw, y, score, other, w), and the area of each draw for a score."""
    by, salt = (f"PARTITION BY {strata} ", f"{strata} || '|' || ") if strata else ("", "")
    own = f"{strata}, " if strata else ""
    using = f"({strata}, i)" if strata else "(i)"
    return f"groups AS (SELECT {own}key, row_number() OVER ({by}ORDER BY key) - 1 AS i, count(*) OVER ({by.strip()}) AS g FROM (SELECT DISTINCT {own}{key} AS key FROM hub)), drawn AS (SELECT {own}draw, {_HEX.format(f"'{seed}|' || {salt}draw || '|' || i")} % g AS i FROM groups, range(0, {n}) AS r(draw)), times AS (SELECT draw, key, count(*) AS w FROM drawn JOIN groups USING {using} GROUP BY 1, 2), w AS (SELECT draw, y, score, pymod AS other, w FROM (SELECT *, doc_id * 7 % 100 AS pymod, {key} AS key FROM hub) JOIN times USING (key))"


def _areas(score: str, name: str) -> str:
    return f"{name}_s AS (SELECT draw, {score} AS s, coalesce(sum(w) FILTER (y = 1), 0) AS p, coalesce(sum(w) FILTER (y = 0), 0) AS n FROM w GROUP BY 1, 2), {name}_c AS (SELECT *, sum(n) OVER (PARTITION BY draw ORDER BY s) - n AS below FROM {name}_s), {name} AS (SELECT draw, sum(p * (2 * below + n))::DOUBLE / (2 * sum(p) * sum(n)) AS auc FROM {name}_c GROUP BY draw HAVING sum(p) > 0 AND sum(n) > 0)"


_BOOT = f"{_drawn(2000, 'boot')}, {_areas('score', 'boot')}"
_QUANTILES = "quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.5) AS middle, quantile_cont(auc, 0.975) AS high"
c.ORACLES |= {
    "group_bootstrap": f"WITH {c.HUB}, {_BOOT} SELECT draw, auc FROM boot",
    "group_bootstrap_ci": f"WITH {c.HUB}, {_BOOT} SELECT count(*) AS n, {_QUANTILES} FROM boot",
    "mean_and_error": f"WITH {c.HUB}, {_BOOT} SELECT count(*) AS n, round(avg(auc), 9) AS mean, round(stddev_samp(auc) / sqrt(count(*)), 9) AS se FROM boot",
    "stratified_bootstrap": f"WITH h AS (WITH {c.HUB} SELECT * FROM hub), hub AS (SELECT *, y || '-' || grp AS name FROM h), {_drawn(2000, 'two', 'name', 'y')}, {_areas('score', 'boot')} SELECT count(*) AS n, {_QUANTILES} FROM boot",
    "paired_bootstrap": f"WITH {c.HUB}, {_drawn(4000, 'pair')}, {_areas('score', 'one')}, {_areas('other', 'two')}, d AS (SELECT one.auc AS x, two.auc AS y, one.auc - two.auc AS delta FROM one JOIN two USING (draw)) SELECT count(*) AS n, round(avg(delta), 9) AS mean, round(quantile_cont(delta, 0.025), 9) AS low, round(quantile_cont(delta, 0.975), 9) AS high, avg((delta > 0)::INT) AS p_better, round(corr(x, y), 9) AS corr FROM d",
    "stability_selection": _STABLE.replace("range(0, 10)", "range(0, 200)").replace(
        "SELECT latent, count(*) FILTER (place <= 10) AS n_top, min(delta) AS least, count(*) FILTER (place <= 10) >= 0.75 * 10 AS stable FROM top GROUP BY latent",
        ", every AS (SELECT latent, sum(p * (2 * below + n))::DOUBLE / (sum(p) * sum(n)) - 1 AS delta FROM (SELECT *, sum(n) OVER (PARTITION BY latent ORDER BY v) - n AS below FROM (SELECT latent, v, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM l GROUP BY 1, 2)) GROUP BY latent) SELECT latent, count(*) FILTER (place <= 10) AS n_top, min(top.delta) AS least, every.delta, count(*) FILTER (place <= 10) >= 0.75 * 200 AND every.delta >= 0.9 AS stable FROM top JOIN every USING (latent) GROUP BY latent, every.delta",
    ),
}
