"""Registered queries for clusters and their representatives, splits, frozen thresholds, reports, annotations and files.

They use the same analogues on the fixture tables as the catalog.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlake.functions import sequences as sq
from loomlake.operators import dedup, metrics, pairs, sampling, splits
from loomlake.operators.graph import connected, merged
from loomlake.plans import catalog as c
from loomlake.plans.catalog import query
from loomlake.scratch import Scratch
from loomlake.sources import reports
from loomlake.sources import sequence_files as files
from loomlake.session import table

#: Going through ids in order: o has (id, i, hosts), the hosts of each in their order; fin has the ids that are absorbed.
_STEP = "step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT s.i + 1, CASE WHEN len(list_filter(o.hosts, lambda h: NOT list_contains(s.gone, h))) > 0 THEN list_append(s.gone, o.id) ELSE s.gone END FROM step s JOIN o ON o.i = s.i + 1), fin AS (SELECT gone FROM step ORDER BY i DESC LIMIT 1), absorbed AS (SELECT o.id, list_filter(o.hosts, lambda h: NOT list_contains(fin.gone, h))[1] AS host FROM o, fin)"
_CONTAINED = "u AS (SELECT min(doc_id) AS doc_id, text, max(length(text)) AS n FROM documents GROUP BY text), e AS (SELECT a.doc_id AS id, a.n AS size, b.doc_id AS host, b.n AS m FROM u a JOIN u b ON b.n > a.n AND b.n - a.n <= 60 AND contains(b.text, a.text)), o AS (SELECT id, row_number() OVER (ORDER BY size DESC, id) AS i, hosts FROM (SELECT id, size, list(host ORDER BY m DESC, host) AS hosts FROM e GROUP BY id, size))"

c.ORACLES["containment_dups"] = f"WITH RECURSIVE {_CONTAINED}, {_STEP} SELECT u.doc_id AS id, absorbed.host FROM u LEFT JOIN absorbed ON absorbed.id = u.doc_id"

_SIZES = "z AS (SELECT doc_id AS id, n_chars AS n FROM documents)"
_REPS = f"{_SIZES}, e AS (SELECT CASE WHEN f THEN b ELSE a END AS id, CASE WHEN f THEN a ELSE b END AS host, CASE WHEN f THEN nb ELSE na END AS size, CASE WHEN f THEN na ELSE nb END AS m FROM (SELECT a, b, p.n AS na, q.n AS nb, p.n > q.n OR (p.n = q.n AND a < b) AS f FROM pairs JOIN z p ON p.id = a JOIN z q ON q.id = b WHERE jaccard >= 0.4)), o AS (SELECT id, row_number() OVER (ORDER BY size DESC, id) AS i, hosts FROM (SELECT id, size, list(host ORDER BY m DESC, host) AS hosts FROM e GROUP BY id, size)), {_STEP}, reps AS (SELECT z.id, coalesce(absorbed.host, z.id) AS representative FROM z LEFT JOIN absorbed ON absorbed.id = z.id)"


def _representatives(spark, d):
    docs = table(spark, d, "documents")
    members, near = c._classes(spark, d, 0.4)
    return dedup.representatives(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size")), near, members)


@query(f"WITH RECURSIVE {c._PAIRS}, {_REPS} SELECT id, representative FROM reps")
def cluster_representatives(spark, d):
    return _representatives(spark, d)


@query(f"WITH RECURSIVE {c._PAIRS}, {_REPS} SELECT representative, min(id) AS id FROM reps GROUP BY representative HAVING count(*) FILTER (id IN (SELECT doc_id FROM labels WHERE quality = 1)) = 0")
def clusters_without_known(spark, d):
    """Known items: documents of good quality."""
    return dedup.unknown_families(_representatives(spark, d), table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")))


@query(f"WITH RECURSIVE {c._PAIRS}, m AS (SELECT doc_id AS id, doc_id // 4 * 4 AS cluster FROM documents), l AS (SELECT DISTINCT p.cluster AS a, q.cluster AS b FROM pairs JOIN m p ON p.id = a JOIN m q ON q.id = b WHERE jaccard >= 0.4 AND p.cluster <> q.cluster), edges AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach AS (SELECT DISTINCT cluster AS a, cluster AS b FROM m UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b), root AS (SELECT a, min(b) AS least FROM reach GROUP BY a) SELECT id, least AS cluster FROM m JOIN root ON root.a = m.cluster")
def merged_clusters(spark, d):
    members = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("doc_id div 4 * 4").alias("cluster"))
    return merged(members, pairs.starred(*c._classes(spark, d, 0.4)), Scratch(spark, "merged"))


@query(f"WITH {c._PAIRS}, bad AS (SELECT a AS id, b AS o FROM pairs WHERE jaccard >= 0.9 UNION SELECT b, a FROM pairs WHERE jaccard >= 0.9) SELECT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT id FROM bad JOIN labels l ON l.doc_id = o WHERE l.quality = 1 AND l.toxic = 0)")
def cross_label_drop_held_out(spark, d):
    """As cross_label_drop, with a held-out class (the toxic ones of good quality) that drops nothing."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "neg").when(F.col("toxic") == 1, "held").otherwise("pos").alias("label"))
    return pairs.best_to_class(*c._classes(spark, d, 0.9), labels, "neg", "pos").where("best < 0.9").select(F.col("id").alias("doc_id"))


@query(f"WITH RECURSIVE {c._PAIRS}, {_REPS}, s AS (SELECT doc_id AS id, {c.SEQ} AS seq, text FROM documents), f AS (SELECT id, seq, length(seq) BETWEEN 50 AND 5000 AS ok1, row_number() OVER (PARTITION BY seq ORDER BY id) = 1 AS ok2, NOT regexp_matches(text, '(?i)license|token') AS ok3, regexp_matches(seq, '{c.MOTIF}') AS ok4 FROM s), fam AS (SELECT f.*, reps.representative, r.known FROM f JOIN reps USING (id) JOIN (SELECT representative, count(*) FILTER (id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS known FROM reps GROUP BY representative) r USING (representative)), h AS (SELECT *, ok1 AND ok2 AND ok3 AND ok4 AS four FROM fam) SELECT count(*) AS n1_all, count(*) FILTER (ok1) AS n2_length, count(*) FILTER (ok1 AND ok2) AS n3_distinct, count(*) FILTER (ok1 AND ok2 AND ok3) AS n4_clean, count(*) FILTER (four) AS n5_motif, count(*) FILTER (four AND known = 0) AS n6_unknown, count(DISTINCT representative) FILTER (four AND known = 0) AS n7_representatives FROM h")
def funnel_stages(spark, d):
    """All seven stages: rows, length, first of equal sequences, clean text, motif, no known relative, one a cluster."""
    ok = [F.length("seq").between(50, 5000), F.row_number().over(Window.partitionBy("seq").orderBy("doc_id")) == 1, ~F.col("text").rlike("(?i)license|token"), F.col("seq").rlike(c.MOTIF)]
    flags = c.docs_(spark, d).select(F.col("doc_id").alias("id"), *(f.alias(f"ok{i}") for i, f in enumerate(ok)))
    reps = _representatives(spark, d)
    known = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("known"))
    near = reps.join(known, "id", "left").groupBy("representative").agg(F.count("known").alias("n_known"))
    rows = flags.join(reps, "id").join(near, "representative")
    upto = [reduce(lambda a, b: a & b, (F.col(f"ok{i}") for i in range(n + 1))) for n in range(4)]
    unknown = upto[3] & (F.col("n_known") == 0)
    names = ("n2_length", "n3_distinct", "n4_clean", "n5_motif")
    return rows.agg(F.count("*").alias("n1_all"), *(F.count_if(f).alias(n) for f, n in zip(upto, names, strict=True)), F.count_if(unknown).alias("n6_unknown"), F.count_distinct(F.when(unknown, F.col("representative"))).alias("n7_representatives"))


_NINE = [0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.9]
_BOUNDS = ", ".join(map(str, _NINE))


_SWEEP = f"WITH RECURSIVE {c._GRAMS}, n AS (SELECT id, count(*) AS n FROM g GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2), p AS (SELECT a, b, c::DOUBLE / (p.n + q.n - c) AS jaccard, c::DOUBLE / least(p.n, q.n) AS overlap FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE c::DOUBLE / (p.n + q.n - c) >= 0.15), t AS (SELECT i, bound, measure FROM (SELECT unnest(range(0, 9)) AS i, unnest([{_BOUNDS}])::DOUBLE AS bound), (SELECT unnest(['jaccard', 'overlap']) AS measure)), l AS (SELECT measure, bound, a, b FROM p, t WHERE CASE WHEN measure = 'jaccard' THEN jaccard ELSE overlap END >= bound), edges AS (SELECT * FROM l UNION ALL SELECT measure, bound, b, a FROM l), reach AS (SELECT measure, bound, doc_id AS a, doc_id AS b FROM documents, t UNION SELECT r.measure, r.bound, r.a, e.b FROM reach r JOIN edges e ON e.a = r.b AND e.bound = r.bound AND e.measure = r.measure), comp AS (SELECT measure, bound, a, min(b) AS c FROM reach GROUP BY 1, 2, 3), sizes AS (SELECT measure, bound, c, count(*) AS n, count(*) FILTER (a IN (SELECT doc_id FROM labels WHERE quality = 1)) AS pos FROM comp GROUP BY 1, 2, 3) SELECT measure, bound, count(*) AS n_components, max(n) AS largest, count(*) FILTER (pos > 0) AS with_positives, max(pos) AS most_positives FROM sizes GROUP BY 1, 2"


@query(f"WITH {c._GRAMS}, {c._Q}, m AS (SELECT id, count(*) AS m FROM q GROUP BY id), n AS (SELECT target, count(*) AS n FROM t GROUP BY target), x AS (SELECT id, target, m * n / pow(2::DOUBLE, count(*)) AS evalue FROM q JOIN t USING (s) JOIN m USING (id) JOIN n USING (target) GROUP BY id, target, m, n) SELECT id, target, evalue FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY evalue, target) = 1")
def best_hit_evalue(spark, d):
    return pairs.least_evalue(pairs.shingles(table(spark, d, "documents"), "doc_id", "text"), pairs.shingles(table(spark, d, "benchmark"), "item_id", "text"))


@query(f"WITH {c._PAIRS}, l AS (SELECT doc_id AS id, quality FROM labels) SELECT least(p.quality, q.quality) AS x, greatest(p.quality, q.quality) AS y, count(*) FILTER (jaccard >= 0.35 AND jaccard < 0.4) AS n_band, count(*) FILTER (jaccard >= 0.4) AS n_over, count(*) AS n FROM pairs JOIN l p ON p.id = a JOIN l q ON q.id = b GROUP BY 1, 2")
def identity_bands(spark, d):
    """Pairs by the classes of both, how many just below the bound and how many over it."""
    j, n = F.col("jaccard"), F.col("n")
    kinds = c._kinds(spark, d, table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("kind")))
    total = lambda which: F.coalesce(F.sum(F.when(which, n)), F.lit(0))
    return kinds.groupBy("x", "y").agg(total((j >= 0.35) & (j < 0.4)).alias("n_band"), total(j >= 0.4).alias("n_over"), F.sum("n").alias("n"))


@query("WITH p AS (SELECT l_partkey % 60 AS a, l_suppkey % 60 AS b, l_quantity AS score FROM lineitem) SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score FROM p WHERE a <> b GROUP BY 1, 2 HAVING max(score) >= 40")
def canonical_pairs(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 60).alias("a"), (F.col("l_suppkey") % 60).alias("b"), F.col("l_quantity").alias("score"))
    return pairs.canonical(rows, "score", 40)


@query("SELECT min(l_linenumber) AS l_linenumber, l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS flags, bool_or(l_quantity > 40) AS any_large, bool_and(coalesce(l_returnflag, '') <> 'R') AS never_back, count(*) AS n_merged FROM lineitem GROUP BY l_orderkey")
def collapsed_facts(spark, d):
    """Fact rows as one row of their subject: values met, what holds for any of them, what one of them clears."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_returnflag").alias("flags"), (F.col("l_quantity") > 40).alias("any_large"), (F.coalesce("l_returnflag", F.lit("")) != "R").alias("never_back"))
    out = dedup.merge_evidence(rows, "l_orderkey", "l_linenumber", ["flags"], ["any_large"], ["never_back"])
    return out.withColumn("flags", F.array_join("flags", "|"))


# --- splits ----------------------------------------------------------------------------------------------------------------

_FOLD = f"{c._PAIRS}, {c._EDGES}, {c._ROOTS}, m AS (SELECT comp.doc_id, component, quality FROM comp JOIN labels USING (doc_id)), tot AS (SELECT count(*) FILTER (quality = 0) AS t0, count(*) FILTER (quality = 1) AS t1 FROM m), k AS (SELECT component, count(*) FILTER (quality = 0) AS c0, count(*) FILTER (quality = 1) AS c1, row_number() OVER (ORDER BY count(*) DESC, component) AS i FROM m GROUP BY component), fold AS (SELECT 0::BIGINT AS i, 0::BIGINT AS component, '' AS split, 0::BIGINT AS a0, 0::BIGINT AS a1, 0::BIGINT AS v0, 0::BIGINT AS v1, 0::BIGINT AS e0, 0::BIGINT AS e1 UNION ALL SELECT i, component, s, a0 + (s = 'train')::INT * c0, a1 + (s = 'train')::INT * c1, v0 + (s = 'val')::INT * c0, v1 + (s = 'val')::INT * c1, e0 + (s = 'test')::INT * c0, e1 + (s = 'test')::INT * c1 FROM (SELECT *, CASE WHEN st >= sv AND st >= se THEN 'train' WHEN sv >= se THEN 'val' ELSE 'test' END AS s FROM (SELECT k.i, k.component, c0, c1, f.a0, f.a1, f.v0, f.v1, f.e0, f.e1, " + ", ".join(
    f"c0 * ({share}::DOUBLE * t0 - f.{x}0) / greatest({share}::DOUBLE * t0, 1) + c1 * ({share}::DOUBLE * t1 - f.{x}1) / greatest({share}::DOUBLE * t1, 1) AS s{y}" for x, y, share in (("a", "t", 0.7), ("v", "v", 0.15), ("e", "e", 0.15))
) + " FROM fold f JOIN k ON k.i = f.i + 1, tot)))"

c.ORACLES["split_assignment"] = f"WITH RECURSIVE {_FOLD} SELECT doc_id, m.component, split FROM m JOIN fold ON fold.component = m.component AND fold.i > 0"


@query(f"WITH RECURSIVE {_FOLD} SELECT doc_id, m.component, CASE WHEN toxic = 1 THEN 'heldout' ELSE split END AS split FROM m JOIN fold ON fold.component = m.component AND fold.i > 0 JOIN labels USING (doc_id)")
def split_held_out(spark, d):
    """As split_assignment, with the toxic documents in a split of their own; they still count in their components."""
    members = c._components(spark, d).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("class")), "doc_id")
    assigned = members.join(splits.assign(members), "component")
    return splits.with_held_out(assigned, "toxic", "class").select("doc_id", "component", "split")


# --- metrics ---------------------------------------------------------------------------------------------------------------

_SOME = c.HUB.replace("hub AS", "base AS", 1)
_AT = "tp, fp, fn, tn, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1"


@query(f"WITH {_SOME}, hub AS (SELECT * FROM base WHERE doc_id % 2 = 0), {c.PR}, pick AS (SELECT threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1), r AS (SELECT threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = 0) AS tn FROM base, pick WHERE doc_id % 2 = 1 GROUP BY threshold) SELECT threshold, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (SELECT threshold, {_AT} FROM r)")
def frozen_threshold(spark, d):
    """A threshold chosen on one half and applied to the other."""
    h = c.hub(spark, d)
    out = metrics.frozen(h.where("doc_id % 2 = 0"), h.where("doc_id % 2 = 1"))
    return out.select("threshold", "tp", "fp", "fn", "tn", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")))


@query(f"WITH {c.HUB}, {c.PR} SELECT threshold, precision, recall FROM pr UNION ALL SELECT NULL, 1, 0")
def pr_curve_closed(spark, d):
    return metrics.precision_recall(c.hub(spark, d), closed=True).select("threshold", "precision", "recall")


_PRED = "h AS (SELECT lang AS y, CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' la ') THEN 'fr' ELSE 'es' END AS pred FROM documents)"


def _predicted(spark, d):
    text = F.col("text")
    pred = F.when(F.contains(text, F.lit(" the ")), "en").when(F.contains(text, F.lit(" der ")), "de").when(F.contains(text, F.lit(" la ")), "fr").otherwise("es")
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("y"), pred.alias("predicted"))


@query(f"WITH {_PRED}, c AS (SELECT DISTINCT y AS cls FROM h), r AS (SELECT cls, count(*) FILTER (y = cls AND pred = cls) AS tp, count(*) FILTER (y = cls) AS support, count(*) FILTER (pred = cls) AS said FROM h, c GROUP BY cls), p AS (SELECT cls, tp, support, coalesce(tp::DOUBLE / nullif(said, 0), 0) AS precision, tp::DOUBLE / support AS recall FROM r), q AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p) SELECT cls, tp, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(avg(f1) OVER (), 9) AS macro_f1, round(sum(tp) OVER ()::DOUBLE / sum(support) OVER (), 9) AS accuracy FROM q")
def class_report(spark, d):
    out = metrics.class_report(_predicted(spark, d))
    return out.select("cls", "tp", "support", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1", "macro_f1", "accuracy")))


_ENTRIES = [i / 86 for i in range(43)]


@query(f"WITH {_SOME}, t AS (SELECT unnest(range(0, 43)) / 86.0::DOUBLE AS cut), v AS (SELECT cut, count(*) FILTER (score >= cut AND y = 1) AS tp, count(*) FILTER (score >= cut AND y = 0) AS fp, count(*) FILTER (score < cut AND y = 1) AS fn FROM base, t WHERE doc_id % 2 = 0 GROUP BY cut), pick AS (SELECT cut FROM v ORDER BY round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) DESC, cut LIMIT 1) SELECT cut, count(*) FILTER (score >= cut AND y = 1) AS tp, count(*) FILTER (score >= cut AND y = 0) AS fp, count(*) FILTER (score < cut AND y = 1) AS fn FROM base, pick WHERE doc_id % 2 = 1 GROUP BY cut")
def cutoff_by_f1(spark, d):
    """The one of 43 cutoffs with the best F1 on one half (the lowest on ties), and its counts on the other."""
    h, hit = c.hub(spark, d), F.col("score") >= F.col("cut")
    tp, fp, fn = (F.count_if(f) for f in (hit & (F.col("y") == 1), hit & (F.col("y") == 0), ~hit & (F.col("y") == 1)))
    f1 = F.round(F.coalesce(F.try_divide(2 * tp.cast("double"), 2 * tp + fp + fn), F.lit(0.0)), 9)
    swept = h.where("doc_id % 2 = 0").select("y", "score", F.explode(F.array(*map(F.lit, _ENTRIES))).alias("cut")).groupBy("cut").agg(f1.alias("f1"))
    best = swept.agg(F.max_by("cut", F.struct("f1", -F.col("cut"))).alias("cut"))  # one row
    return h.where("doc_id % 2 = 1").crossJoin(F.broadcast(best)).groupBy("cut").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


@query("WITH b AS (SELECT lang, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), v AS (SELECT 'before' AS step, lang, pos FROM b UNION ALL SELECT 'after', lang, quality = 1 FROM documents JOIN labels USING (doc_id) WHERE toxic = 0) SELECT step, lang, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, round(count(*) FILTER (pos)::DOUBLE / sum(count(*) FILTER (pos)) OVER (PARTITION BY step), 9) AS share_pos, round(count(*) FILTER (NOT pos)::DOUBLE / sum(count(*) FILTER (NOT pos)) OVER (PARTITION BY step), 9) AS share_neg FROM v GROUP BY step, lang")
def group_mix(spark, d):
    """Shares of each language among both classes, before and after a class of rows is dropped."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("pos"), F.explode(F.when(F.col("toxic") == 0, F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("before")))).alias("step"))
    n = both.groupBy("step", "lang").agg(F.count_if("pos").alias("n_pos"), F.count_if(~F.col("pos")).alias("n_neg"))
    share = lambda x: F.round(F.col(x).cast("double") / F.sum(x).over(Window.partitionBy("step")), 9)
    return n.select("step", "lang", "n_pos", "n_neg", share("n_pos").alias("share_pos"), share("n_neg").alias("share_neg"))


# --- features --------------------------------------------------------------------------------------------------------------

_LATENTS = "s AS (SELECT latent, avg(v) FILTER (pos) AS mp, avg(v) FILTER (NOT pos) AS mc, stddev_pop(v) FILTER (NOT pos) AS sc, avg((v > 0)::INT) FILTER (pos) AS prevalence FROM l GROUP BY latent)"


@query(f"WITH l AS (SELECT vec_id, label = 0 AS pos, i - 1 AS latent, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i) WHERE vec_id % 10 < 7), {_LATENTS} SELECT latent, round((mp - mc) / (sc + 1e-6), 9) AS raw, prevalence FROM s WHERE prevalence >= 0.1")
def prevalent_features(spark, d):
    """Differential scores over the training rows only, of features that are active in a tenth of the positives."""
    v, pos = F.col("v"), F.col("pos")
    rows = c._long(spark, d).where("vec_id % 10 < 7")
    s = rows.groupBy("latent").agg(F.avg(F.when(pos, v)).alias("mp"), F.avg(F.when(~pos, v)).alias("mc"), F.stddev_pop(F.when(~pos, v)).alias("sc"), F.avg(F.when(pos, (v > 0).cast("double"))).alias("prevalence"))
    return s.where("prevalence >= 0.1").select("latent", F.round((F.col("mp") - F.col("mc")) / (F.col("sc") + 1e-6), 9).alias("raw"), "prevalence")


@query(f"WITH {c._LONG}, one AS (SELECT latent, round((avg(v) FILTER (pos)) - (avg(v) FILTER (NOT pos)), 9) AS gap FROM l GROUP BY latent), ranked AS (SELECT latent, row_number() OVER (ORDER BY gap DESC, latent) AS place FROM one), r AS (SELECT k AS g, pos::INT AS y, sum(floor(v * 1000)) AS score FROM l JOIN ranked USING (latent), (SELECT unnest([1, 10, 50]) AS k) WHERE place <= k GROUP BY k, vec_id, pos), " + "m AS (SELECT g, y, 2 * rank() OVER (PARTITION BY g ORDER BY score) + count(*) OVER (PARTITION BY g, score) - 1 AS r2 FROM r), a AS (SELECT g, sum(r2) FILTER (y = 1) - p * (p + 1) AS u2, p, n FROM (SELECT *, count(*) FILTER (y = 1) OVER (PARTITION BY g) AS p, count(*) FILTER (y = 0) OVER (PARTITION BY g) AS n FROM m) GROUP BY g, p, n) SELECT g AS k, u2::DOUBLE / (2 * p * n) AS auc FROM a")
def top_feature_controls(spark, d):
    """The sum of the best 1, 10 and 50 features as a score."""
    v, pos = F.col("v"), F.col("pos")
    gap = F.round(F.avg(F.when(pos, v)) - F.avg(F.when(~pos, v)), 9)
    # one row a feature
    ranked = c._long(spark, d).groupBy("latent").agg(gap.alias("gap")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("gap"), "latent"))).where("place <= 50")
    sizes = F.explode(F.array(F.lit(1), F.lit(10), F.lit(50))).alias("k")
    rows = c._long(spark, d).join(F.broadcast(ranked.select("latent", "place", sizes).where("place <= k")), "latent")
    scored = rows.groupBy("k", "vec_id", F.col("pos").cast("int").alias("y")).agg(F.sum(F.floor(F.col("v") * 1000)).alias("score"))
    return metrics.ranking(scored, ["k"]).select("k", "auc")


@query("SELECT label, round((max(embedding[4]::DOUBLE) + max(embedding[8]::DOUBLE) + max(embedding[16]::DOUBLE)) / 3, 9) AS pocket FROM embeddings GROUP BY label")
def pocket_score(spark, d):
    """The mean of the largest values of three columns."""
    top = [F.max(F.col("embedding")[i].cast("double")) for i in (3, 7, 15)]
    return table(spark, d, "embeddings").groupBy("label").agg(F.round((top[0] + top[1] + top[2]) / 3, 9).alias("pocket"))


@query(f"WITH {c.HUB}, r AS (SELECT toxic, tier, count(*) FILTER (score >= 0.1) AS n FROM hub GROUP BY 1, 2) SELECT toxic, sum(n) FILTER (tier = 'de')::BIGINT AS de, sum(n) FILTER (tier = 'en')::BIGINT AS en, sum(n) FILTER (tier = 'es')::BIGINT AS es, sum(n) FILTER (tier = 'fr')::BIGINT AS fr FROM r GROUP BY toxic")
def metric_pivot(spark, d):
    return c.hub(spark, d).groupBy("toxic").pivot("tier", ["de", "en", "es", "fr"]).agg(F.count_if(F.col("score") >= 0.1))


@query(f"WITH w AS (SELECT lpad(substr(s, greatest(p - 4, 1), p + 4 - greatest(p - 4, 1) + 1), 9 - greatest(0, p + 4 - length(s))::INT, '-') AS s FROM (SELECT s, length(regexp_extract(s, '^(.*?)E[STN]H', 1)) + 1 AS p FROM (SELECT {c.SEQ} AS s FROM documents) WHERE regexp_matches(s, 'E[STN]H'))), n AS (SELECT i AS col, substr(s, i::INT, 1) AS letter, count(*) AS n FROM w, range(1, 10) AS r(i) WHERE i <= length(s) GROUP BY 1, 2) SELECT col, letter, n FROM n")
def padded_profile(spark, d):
    """Letters by place of windows around a motif; a window cut by the sequence's start is padded on the left, so that places align."""
    rows = c.docs_(spark, d).where(F.col("seq").rlike("E[STN]H")).withColumn("at", F.regexp_instr("seq", F.lit("E[STN]H")) - 1)
    window = sq.padded(F.col("seq"), F.col("at"), 4)
    letters = rows.select(F.posexplode(F.filter(F.split(window, ""), lambda x: x != "")).alias("col", "letter"))
    return letters.groupBy((F.col("col") + 1).cast("bigint").alias("col"), "letter").agg(F.count("*").alias("n"))


# --- tables, annotations, payloads -------------------------------------------------------------------------------------------


@query("WITH q AS (SELECT 'en' AS lang, 100 AS want UNION ALL SELECT 'de', 1000 UNION ALL SELECT 'xx', 3), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, want, least(want, coalesce(n, 0))::BIGINT AS got, coalesce(n, 0) < want AS short FROM q LEFT JOIN n USING (lang)")
def quota_short(spark, d):
    """Quotas of strata, what each got, and which fell short."""
    wants = spark.createDataFrame([("en", 100), ("de", 1000), ("xx", 3)], "lang string, want int")
    return sampling.quota_report(table(spark, d, "documents"), wants, "lang", "doc_id", "want", "7").select("lang", "want", "got", "short")


@query("SELECT count(l.doc_id) AS n_kept, count(*) - count(l.doc_id) AS n_dropped FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def joined_and_dropped(spark, d):
    """An inner join that says how many rows it leaves out."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    kept = docs.join(labels, "doc_id").agg(F.count("*").alias("n_kept"))
    lost = docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("n_dropped"))
    return kept.crossJoin(lost)  # one row each


@query("SELECT p_partkey, CASE WHEN list_has_any(string_split(p_type, ' '), ['BRASS', 'TIN']) THEN 'metal' WHEN list_contains(string_split(p_type, ' '), 'PROMO') THEN 'promo' WHEN len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 's'))) > 0 THEN 'prefix' ELSE 'other' END AS grp FROM part")
def annotation_group(spark, d):
    """A set that overlaps, then a member, then a prefix of any member, then the rest."""
    kinds, names = F.split("p_type", " "), F.split("p_name", " ")
    overlap = F.arrays_overlap(kinds, F.array(F.lit("BRASS"), F.lit("TIN")))
    rule = F.when(overlap, "metal").when(F.array_contains(kinds, "PROMO"), "promo").when(F.exists(names, lambda w: w.startswith("s")), "prefix").otherwise("other")
    return table(spark, d, "part").select("p_partkey", rule.alias("grp"))


@query("SELECT conv_id, coalesce(array_to_string(list_sort(list_distinct(list(length(text)::VARCHAR) FILTER (role = 'assistant'))), '|'), '') AS sizes, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id")
def nested_annotations(spark, d):
    """Nested JSON made of turns and read again: entries filtered by a field, flattened, distinct and sorted."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("role", F.array(F.struct(F.length("text").cast("string").alias("value"))).alias("numbers"))).alias("turns")).alias("body"))).alias("raw"))
    body = F.from_json("raw", "body struct<turns: array<struct<role: string, numbers: array<struct<value: string>>>>>")["body"]["turns"]
    of = lambda role: F.filter(body, lambda t: t["role"] == role)
    sizes = F.flatten(F.transform(of("assistant"), lambda t: F.transform(t["numbers"], lambda n: n["value"])))
    return turns.select("conv_id", F.array_join(F.array_sort(F.array_distinct(sizes)), "|").alias("sizes"), F.size(of("user")).cast("bigint").alias("n_user"))


@query("""SELECT doc_id, '{"id":' || doc_id || ',"at":{"lang":"' || lang || '","n":' || n_chars || '}' || CASE WHEN n_chars < 500 OR lang = 'fr' THEN ',"source":"' || source || '"' ELSE '' END || '}' AS payload FROM documents""")
def json_payload(spark, d):
    """One JSON object a row; a field is there only where it is wanted."""
    source = F.when((F.col("n_chars") < 500) | (F.col("lang") == "fr"), F.col("source"))
    body = F.struct(F.col("doc_id").alias("id"), F.struct("lang", F.col("n_chars").alias("n")).alias("at"), source.alias("source"))
    return table(spark, d, "documents").select("doc_id", F.to_json(body).alias("payload"))


# --- files -----------------------------------------------------------------------------------------------------------------


def _folder(spark):
    return Scratch(spark, "files").root


@query(f"SELECT doc_id, {c.SEQ} AS seq FROM documents WHERE length({c.SEQ}) > 0")
def fasta_round_trip(spark, d):
    """Sequences written as FASTA and read again."""
    path = _folder(spark)
    rows = c.docs_(spark, d).where(F.length("seq") > 0).select(F.concat(F.col("doc_id").cast("string"), F.lit(" # "), F.col("lang")).alias("header"), "seq", "doc_id")
    files.write_fasta(rows, path, "header", "seq", ["doc_id"])
    return files.read_fasta(spark, path).select(F.col("name").cast("bigint").alias("doc_id"), F.col("sequence").alias("seq"))


@query("SELECT doc_id::VARCHAR AS doc_id, text, lang, coalesce(source, '') AS source FROM documents")
def table_round_trip(spark, d):
    """Texts with quotes, tabs and line breaks through a tab-separated file."""
    path, names = _folder(spark), ["doc_id", "text", "lang", "source"]
    files.write_table(table(spark, d, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), path, names)
    return files.read_table(spark, path, ", ".join(f"{n} string" for n in names), many_lines=True)


@query("SELECT event_id, event_type, value FROM events")
def json_lines_round_trip(spark, d):
    path = _folder(spark)
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(path)
    return files.read_json_lines(spark, path, "event_id bigint, event_type string, value double")


@query("SELECT count(*) AS n_files, sum(n) AS n_rows FROM (SELECT count(*) AS n FROM region UNION ALL SELECT count(*) FROM nation)")
def manifest_files(spark, d):
    """Sizes and digests of files, joined to the rows they hold."""
    names = ("region", "nation")
    found = reduce(lambda a, b: a.union(b), (files.manifest(spark, f"{d.rstrip('/')}/{n}.parquet").select(F.lit(n).alias("name"), "length", "sha256") for n in names))
    rows = reduce(lambda a, b: a.union(b), (table(spark, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names))
    whole = found.where("length > 0 and length(sha256) = 64").select("name").distinct().join(rows, "name")
    return whole.agg(F.count("*").alias("n_files"), F.sum("n").alias("n_rows"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def report_round_trip(spark, d):
    """A small result as a JSON report, written and read again as one object over many lines."""
    path = _folder(spark)
    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    reports.write_json(n, path)
    return reports.read_json(spark, path, "rows array<struct<lang: string, n: bigint>>").select(F.explode("rows").alias("r")).select("r.lang", "r.n")


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def array_file_round_trip(spark, d):
    """Vectors written as archives of named arrays and read again by ranges of rows."""
    path = _folder(spark)
    files.write_arrays(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), path)
    read = files.read_arrays(spark, path, "vec_id bigint, label int, embedding array<float>")
    return read.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def cached_result(spark, d):
    """A result that is computed once and read from its table after that."""
    path, calls = f"{_folder(spark)}/cached", []

    def compute():
        calls.append(1)
        return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))

    reports.cached(spark, path, compute)
    out = reports.cached(spark, path, compute)
    if len(calls) != 1:
        raise ValueError("the cached table was computed again")
    return out




# --- probes ------------------------------------------------------------------------------------------------------------------


def _labelled(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("y"), (F.col("vec_id") % 3).cast("int").alias("part"))


@query()
def probe_saved(spark, d):
    """Scores of a probe that was written and read again, beside those of the one in memory."""
    from pyspark.ml import PipelineModel

    from loomlake.operators import probe

    rows, path = _labelled(spark, d), _folder(spark)
    model = probe.fitted(rows, "vec_id", "embedding", "y")
    model.write().overwrite().save(path)
    own = probe.scored(model, rows, "vec_id", "embedding", "y")
    read = probe.scored(PipelineModel.load(path), rows, "vec_id", "embedding", "y").select("vec_id", F.col("score").alias("loaded"))
    return own.join(read, "vec_id").select("vec_id", "y", "score", "loaded")


@query()
def subset_refit(spark, d):
    """Scores of probes refitted within each third of the rows."""
    from loomlake.operators import probe

    return probe.within(_labelled(spark, d), "part", [0, 1, 2], "vec_id", "embedding", "y")
