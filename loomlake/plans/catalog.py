"""Registered queries on the library's operators, each with the DuckDB SQL of the same result where SQL has one.

Analogues on the fixture tables: a sequence is a document's letters, its stratum the language, its class the quality label, a known
item a benchmark item, a vector an embedding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions import sequences as sq
from loomlake.functions import vectors as vec
from loomlake.functions.alignment import identity
from loomlake.operators import dedup, metrics, ordering, pairs, resampling, sampling, splits
from loomlake.operators.graph import connected
from loomlake.scratch import Scratch
from loomlake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEQ = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
MOTIF = "E.[ST].E"
#: The hub relation: a label and a score for each labelled document, with its tier and its group of equal texts.
HUB = "hub AS (SELECT d.doc_id, lang AS tier, quality AS y, toxic, floor(200.0::DOUBLE * (length(text) - length(replace(text, 'e', ''))) / n_chars) / 200 AS score, min(d.doc_id) OVER (PARTITION BY text) AS grp FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"
AUC = "(sum(p.w * n.w * CASE WHEN p.score > n.score THEN 2 WHEN p.score = n.score THEN 1 ELSE 0 END))::DOUBLE / (2 * sum(p.w * n.w))"
PR = "steps AS (SELECT score, sum(y) AS p, count(*) AS c FROM hub GROUP BY score), pr AS (SELECT score AS threshold, sum(p) OVER (ORDER BY score DESC)::DOUBLE / sum(c) OVER (ORDER BY score DESC) AS precision, sum(p) OVER (ORDER BY score DESC)::DOUBLE / sum(p) OVER () AS recall FROM steps), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs_(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.withColumn("seq", sq.normalise(F.col("text")))


def hub(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    score = F.floor(F.lit(200.0) * (F.length("text") - F.length(F.replace("text", F.lit("e")))) / F.col("n_chars")) / 200
    rows = docs.select("doc_id", F.col("lang").alias("tier"), F.col("quality").alias("y"), "toxic", score.alias("score"), F.sha2("text", 256).alias("print"))
    return rows.join(rows.groupBy("print").agg(F.min("doc_id").alias("grp")), "print").drop("print")


# --- funnel, scalar functions -------------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT doc_id, {SEQ} AS seq FROM documents), b AS (SELECT *, length(seq) BETWEEN 50 AND 1000 AS ok, row_number() OVER (PARTITION BY seq, length(seq) BETWEEN 50 AND 1000 ORDER BY doc_id) AS rn FROM a)
SELECT count(*) AS n_all, count(*) FILTER (ok) AS n_length, count(*) FILTER (ok AND rn = 1) AS n_distinct, count(*) FILTER (ok AND rn = 1 AND regexp_matches(seq, '{MOTIF}')) AS n_motif FROM b""")
def funnel_counts(spark, d):
    ok = F.length("seq").between(50, 1000)
    flags = docs_(spark, d).select(F.sha2("seq", 256).alias("print"), ok.alias("ok"), (ok & F.col("seq").rlike(MOTIF)).alias("motif")).groupBy("print", "ok", "motif").agg(F.count("*").alias("n"))
    return flags.agg(F.sum("n").alias("n_all"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("n_length"), F.count_if("ok").alias("n_distinct"), F.count_if("motif").alias("n_motif"))


@query(f"""WITH a AS (SELECT doc_id, lang, {SEQ} AS seq FROM documents), b AS (SELECT * FROM a WHERE length(seq) BETWEEN 50 AND 1000 AND regexp_matches(seq, '{MOTIF}') QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id) = 1)
SELECT lang, doc_id FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) <= 10""")
def funnel_sample(spark, d):
    kept = dedup.first_seen(docs_(spark, d).where(F.length("seq").between(50, 1000) & F.col("seq").rlike(MOTIF)), ["seq"], ["doc_id"])
    return sampling.per_stratum(kept, "lang", "doc_id", 10, "7").select("lang", "doc_id")


@query(f"SELECT doc_id, {SEQ} AS seq FROM documents")
def normalised(spark, d):
    return docs_(spark, d).select("doc_id", "seq")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: x <> ''))) AS word FROM part) GROUP BY word")
def multi_value_explode_counts(spark, d):
    values = F.array_distinct(sq.split_values(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    return table(spark, d, "part").select(F.explode(values).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_type, ' '), lambda x: x <> ''))), '|') AS joined FROM part")
def join_values(spark, d):
    return table(spark, d, "part").select("p_partkey", sq.join_values(sq.split_values(F.col("p_type"), " ")).alias("joined"))


@query("""SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'excluded' WHEN n_chars < 50 THEN 'short' WHEN quality = 1 AND lang = 'en' THEN 'main' WHEN quality = 1 THEN 'other' ELSE 'excluded' END AS label,
CASE WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 50 THEN 'length' WHEN quality = 1 AND lang = 'en' THEN 'english' WHEN quality = 1 THEN 'language' ELSE 'quality' END AS reason FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def decision_list_class(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    good = F.col("quality") == 1
    out = sq.decide([(F.col("toxic") == 1, "excluded", "toxic"), (F.col("n_chars") < 50, "short", "length"), (good & (F.col("lang") == "en"), "main", "english"), (good, "other", "language")], ("excluded", "quality"))
    return both.select("doc_id", out.alias("c")).select("doc_id", "c.label", "c.reason")


@query("""SELECT lang, source, CASE WHEN list_contains(string_split(p, ' '), 'the') THEN 'the' WHEN list_contains(string_split(p, ' '), 'der') THEN 'der' WHEN list_contains(string_split(p, ' '), 'le') THEN 'le' ELSE 'UNKNOWN' END AS primary_group,
list_has_any(string_split(p, ' '), ['la', 'un']) AS overlap, NOT list_has_any(string_split(lower(p), ' '), ['and', 'und']) AS none_banned, contains(lower(p), 'erth') OR contains(lower(p), 'chst') AS genus, doc_id FROM (SELECT *, text AS p FROM documents)""")
def priority_group(spark, d):
    words = F.split("text", " ")
    return table(spark, d, "documents").select(
        "lang", "source", sq.first_present(words, ["the", "der", "le"]).alias("primary_group"), F.arrays_overlap(words, F.array(F.lit("la"), F.lit("un"))).alias("overlap"),
        sq.none_of(words, ["and", "und"]).alias("none_banned"), sq.any_substring(F.col("text"), ["erth", "chst"]).alias("genus"), "doc_id",
    )


@query("SELECT lang, CASE lang WHEN 'en' THEN 'germanic' WHEN 'de' THEN 'germanic' ELSE 'romance' END AS family, count(*) AS n FROM documents GROUP BY 1, 2")
def dictionary_lookup(spark, d):
    family = sq.recode(F.col("lang"), {"en": "germanic", "de": "germanic"}, "romance")
    return table(spark, d, "documents").groupBy("lang", family.alias("family")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN length(s) = 0 THEN 'empty' END, CASE WHEN length(s) > 0 AND length(s) < 50 THEN 'too_short' END, CASE WHEN length(s) > 1000 THEN 'too_long' END, CASE WHEN regexp_matches(s, '[^ACDEFGHIKLMNPQRSTVWY]') THEN 'nonstandard' END) AS flags,
length(s) BETWEEN 50 AND 1000 AND NOT regexp_matches(text, '(?i)license|token') AS passes FROM (SELECT *, {SEQ} AS s FROM documents)""")
def qc_flags(spark, d):
    return docs_(spark, d).select("doc_id", F.array_join(sq.qc_flags(F.col("seq")), ",").alias("flags"), sq.passes_qc(F.col("seq"), F.col("text"), "(?i)license|token").alias("passes"))


@query(f"SELECT doc_id, regexp_matches(s, 'E[STN]H') AS has_motif, regexp_extract(s, '(E[STN]H)', 1) AS first_motif, CASE WHEN regexp_matches(s, 'E[STN]H') THEN length(regexp_extract(s, '^(.*?)E[STN]H', 1)) ELSE -1 END AS at FROM (SELECT doc_id, {SEQ} AS s FROM documents)")
def motif_first(spark, d):
    seq = F.col("seq")
    return docs_(spark, d).select("doc_id", seq.rlike("E[STN]H").alias("has_motif"), F.regexp_extract(seq, "(E[STN]H)", 1).alias("first_motif"), (F.regexp_instr(seq, F.lit("E[STN]H")) - 1).alias("at"))


@query(f"""SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(range(1, length(s) - 3), lambda i: regexp_full_match(substr(s, i, 5), 'E.[ST].E')), lambda i: i + 1), ','), '') AS positions FROM (SELECT doc_id, {SEQ} AS s FROM documents)""")
def motif_positions(spark, d):
    at = sq.motif_positions(F.col("seq"), MOTIF, 5, 2)
    return docs_(spark, d).select("doc_id", F.array_join(at.cast("array<string>"), ",").alias("positions"))


_LETTERS = "ACDEFGHIKLMNPQRSTVWY"


@query(f"SELECT doc_id, {', '.join(f"(length(s) - length(replace(s, '{c}', '')))::DOUBLE / greatest(length(s), 1) AS f_{c}" for c in _LETTERS)} FROM (SELECT doc_id, {SEQ} AS s FROM documents)")
def composition_20(spark, d):
    return docs_(spark, d).select("doc_id", *(sq.fraction(F.col("seq"), c).alias(f"f_{c}") for c in _LETTERS))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (length(s) > 1022) AS n_cut, sum(length(s[1:1022])) AS letters, count(DISTINCT substr(md5(s), 1, 12)) AS n_keys FROM (SELECT lang, {SEQ} AS s FROM documents) GROUP BY lang")
def truncated(spark, d):
    seq = F.col("seq")
    return docs_(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length(seq) > 1022).alias("n_cut"), F.sum(F.length(sq.truncate(seq))).alias("letters"), F.count_distinct(F.substring(F.md5(seq), 1, 12)).alias("n_keys"))


@query("SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT) AS k FROM events GROUP BY event_type")
def json_paths(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("k"))


# --- deduplication, joins ------------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources, array_to_string(list_sort(list_distinct(list(lang))), '|') AS langs, bool_or(n_chars > 500) AS verified, bool_and(n_chars > 100) AS only_long, count(*) AS n_merged FROM documents GROUP BY text")
def exact_dedup_first(spark, d):
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("print"), "doc_id", F.array("source").alias("sources"), F.array("lang").alias("langs"), (F.col("n_chars") > 500).alias("verified"), (F.col("n_chars") > 100).alias("only_long"))
    out = dedup.merge_evidence(rows, "print", "doc_id", ["sources", "langs"], ["verified"], ["only_long"])
    return out.select("doc_id", F.array_join("sources", "|").alias("sources"), F.array_join("langs", "|").alias("langs"), "verified", "only_long", "n_merged")


@query("SELECT count(*) AS n, count(*) - count(DISTINCT text) AS exact, count(*) FILTER (text IS NULL OR text = '') AS missing, count(DISTINCT source) AS sources, count(*)::DOUBLE / count(DISTINCT text) AS ratio, floor(1000000 / (count(*)::DOUBLE / count(DISTINCT text)))::BIGINT AS families FROM documents")
def duplicate_accounting(spark, d):
    ratio = F.count("*").cast("double") / F.count_distinct("text")
    missing = F.count_if(F.coalesce("text", F.lit("")) == "")
    return table(spark, d, "documents").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("text")).alias("exact"), missing.alias("missing"), F.count_distinct("source").alias("sources"), ratio.alias("ratio"), F.floor(F.lit(1000000) / ratio).alias("families"))


@query("SELECT a.doc_id AS short, b.doc_id AS long, b.n_chars AS long_len FROM documents a JOIN documents b ON b.n_chars > a.n_chars AND b.n_chars - a.n_chars <= 60 AND contains(b.text, a.text)")
def containment_candidates(spark, d):
    return dedup.containment_candidates(table(spark, d, "documents"), "doc_id", "text").select("short", "long", F.col("long_len").cast("bigint").alias("long_len"))


@query()
def containment_dups(spark, d):
    return dedup.greedy_containment(dedup.first_seen(table(spark, d, "documents"), ["text"], ["doc_id"]), "doc_id", "text")


@query("SELECT 'ID' || lpad(row_number() OVER (ORDER BY p_brand, length(p_name) DESC, p_partkey)::VARCHAR, greatest(4, length(row_number() OVER (ORDER BY p_brand, length(p_name) DESC, p_partkey)::VARCHAR))::INT, '0') AS seq_id, p_partkey FROM part")
def mixed_sort_ids(spark, d):
    return dedup.numbered(table(spark, d, "part"), ["p_brand", F.length("p_name").desc(), "p_partkey"]).select("seq_id", "p_partkey")


@query("SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey")
def ban_list_anti(spark, d):
    banned = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(banned, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_mktsegment, count(*) AS n FROM customer SEMI JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def known_semi(spark, d):
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(known, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_default(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("has"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("has").isNull().alias("missing"))


@query("SELECT n_name, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def equi_joins(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# --- aggregations --------------------------------------------------------------------------------------------------------


@query("SELECT l.quality, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr, count(*) AS total FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY l.quality")
def crosstab(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    langs = ["de", "en", "es", "fr"]
    return both.groupBy("quality").pivot("lang", langs).count().na.fill(0).join(both.groupBy("quality").agg(F.count("*").alias("total")), "quality").select("quality", *langs, "total")


@query("SELECT source, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM documents GROUP BY source")
def value_share(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("SELECT lang, count(*) AS n, median(n_chars) AS middle, sum(n_chars)::BIGINT AS total, count(*) FILTER (n_chars > 1000) AS n_long FROM documents GROUP BY lang")
def group_profile(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.median("n_chars").alias("middle"), F.sum("n_chars").alias("total"), F.count_if(F.col("n_chars") > 1000).alias("n_long"))


@query("SELECT p_brand, count(*) AS n, min(p_size) AS lo, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS q2, quantile_cont(p_retailprice, 0.75) AS q3, max(p_size) AS hi FROM part GROUP BY p_brand")
def quartiles(spark, d):
    q = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_size").alias("lo"), F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("p_size").alias("hi"))
    return q.select("p_brand", "n", "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "hi")


@query("SELECT lang, col, avg((v <> '')::INT::DOUBLE) AS rate FROM (SELECT lang, unnest(['text', 'source', 'label']) AS col, unnest([coalesce(text, ''), coalesce(source, ''), coalesce(quality::VARCHAR, '')]) AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY lang, col")
def coverage(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("lang", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("label"))
    return rows.unpivot(["lang"], ["text", "source", "label"], "col", "v").groupBy("lang", "col").agg(F.avg((F.col("v") != "").cast("double")).alias("rate"))


@query("SELECT a.w AS word, a.n AS n_a, b.n AS n_b FROM (SELECT p_brand AS w, count(*) AS n FROM part WHERE p_size <= 20 GROUP BY 1) a JOIN (SELECT p_brand AS w, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1) b ON a.w = b.w")
def shared_keys(spark, d):
    part = table(spark, d, "part")
    a = part.where("p_size <= 20").groupBy(F.col("p_brand").alias("word")).agg(F.count("*").alias("n_a"))
    b = part.where("p_size > 40").groupBy(F.col("p_brand").alias("word")).agg(F.count("*").alias("n_b"))
    return a.join(b, "word")


@query("SELECT n_nationkey, t, count(*) FILTER (c_acctbal >= t) AS n FROM (SELECT c_nationkey AS n_nationkey, c_acctbal, unnest([0, 2500, 5000, 7500]) AS t FROM customer) GROUP BY 1, 2")
def threshold_ladder(spark, d):
    rungs = F.explode(F.array(*map(F.lit, (0, 2500, 5000, 7500)))).alias("t")
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal", rungs).groupBy("n_nationkey", "t").agg(F.count_if(F.col("c_acctbal") >= F.col("t")).alias("n"))


@query("SELECT c_nationkey, max(c_acctbal) AS best, max_by(c_custkey, c_acctbal) AS who FROM customer GROUP BY c_nationkey")
def extreme_payload(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"), F.max_by("c_custkey", "c_acctbal").alias("who"))


@query("SELECT l_suppkey % 10 AS grp, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, flag) <= 2")
def mode_topk(spark, d):
    n = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("grp"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    return sampling.top_per_group(n, "grp", [F.desc("n"), "flag"], 2).drop("place")


@query("SELECT lang, n, greatest(1, round_even(100.0::DOUBLE * n / sum(n) OVER (), 0)::BIGINT) AS quota FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def quota_scaled(spark, d):
    return sampling.scaled_quotas(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), "n", 100)


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('3|' || p_partkey), p_partkey) <= 5")
def stratified_quota_sample(spark, d):
    return sampling.per_stratum(table(spark, d, "part"), "p_brand", "p_partkey", 5, "3").select("p_brand", "p_partkey")


@query("SELECT p_partkey FROM part ORDER BY md5('9|' || p_partkey), p_partkey LIMIT 50")
def simple_sample(spark, d):
    return sampling.simple(table(spark, d, "part"), "p_partkey", 50, "9").select("p_partkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark, d):
    return sampling.top_per_group(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice")


# --- pairs, components, splits --------------------------------------------------------------------------------------------

_GRAMS = "g AS (SELECT DISTINCT doc_id AS id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents), unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5)"
_PAIRS = f"{_GRAMS}, n AS (SELECT id, count(*) AS n FROM g GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2), pairs AS (SELECT a, b, c::DOUBLE / (p.n + q.n - c) AS jaccard FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE c::DOUBLE / (p.n + q.n - c) >= 0.15)"
_ROOTS = "reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b), comp AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a)"
_EDGES = "edges AS (SELECT a, b FROM pairs WHERE jaccard >= 0.4 UNION ALL SELECT b, a FROM pairs WHERE jaccard >= 0.4)"


def _sets(spark, d):
    return pairs.shingle_sets(table(spark, d, "documents"), "doc_id", "text")


def _classes(spark, d, floor=0.15, scratch=None, fold=None):
    """(members, pairs) of the documents' classes of equal sets of shingles."""
    return pairs.similar_classes(_sets(spark, d), floor, scratch or Scratch(spark, "pairs"), fold=fold)


def _kinds(spark, d, held):
    return pairs.similar_kinds(_sets(spark, d), 0.15, Scratch(spark, "pairs"), held)


def _pairs(spark, d):
    return pairs.expanded(*_classes(spark, d))


def _components(spark, d, bound=0.4):
    docs, scratch = table(spark, d, "documents"), Scratch(spark, "components")
    # copies are links to their representative, not pairs of each other
    roots = connected(pairs.starred(*_classes(spark, d, bound, scratch, lambda _, out: out.select("a", "b"))), scratch)
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    named = roots.join(least, "root").select(F.col("node").alias("doc_id"), "component")
    return docs.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def pair_candidates(spark, d):
    return _pairs(spark, d)


@query()
def pair_identity(spark, d):
    """Whole sequences of all candidate pairs, equal copies included; two different sequences are aligned once, whatever their copies."""
    docs, scratch = docs_(spark, d).select("doc_id", "seq"), Scratch(spark, "identity")
    every, once = pairs.by_value(_pairs(spark, d).select("a", "b"), docs, "doc_id", "seq", scratch)
    both = once.join(docs.toDF("va", "x"), "va").join(docs.toDF("vb", "y"), "vb").repartition(spark.sparkContext.defaultParallelism * 4)
    aligned = scratch.write(both.select("va", "vb", identity(F.col("x"), F.col("y")).alias("i")).select("va", "vb", "i.ident_min", "i.ident_aln"), "aligned")
    return every.join(aligned, ["va", "vb"]).select("a", "b", "ident_min", "ident_aln")


@query(f"WITH RECURSIVE {_PAIRS}, {_EDGES}, {_ROOTS} SELECT * FROM comp")
def components(spark, d):
    return _components(spark, d)


@query(f"WITH RECURSIVE {_PAIRS}, {_EDGES}, {_ROOTS} SELECT component, count(*) AS n FROM comp GROUP BY component ORDER BY n DESC, component LIMIT 10")
def component_sizes(spark, d):
    return _components(spark, d).groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(10)


@query(f"WITH RECURSIVE {_PAIRS}, {_EDGES}, {_ROOTS} SELECT component, array_to_string(list_sort(list(DISTINCT quality::VARCHAR)), '|') AS labels FROM comp JOIN labels USING (doc_id) GROUP BY component HAVING count(DISTINCT quality) > 1")
def mixed_components(spark, d):
    both = _components(spark, d).join(table(spark, d, "labels"), "doc_id")
    return both.groupBy("component").agg(F.array_sort(F.collect_set(F.col("quality").cast("string"))).alias("l")).where(F.size("l") > 1).select("component", F.array_join("l", "|").alias("labels"))


@query(f"WITH {_PAIRS}, bi AS (SELECT a, b, jaccard FROM pairs UNION ALL SELECT b, a, jaccard FROM pairs) SELECT l.doc_id AS id, coalesce(max(jaccard) FILTER (m.quality = 1), 0.0) AS best FROM labels l LEFT JOIN bi ON bi.a = l.doc_id LEFT JOIN labels m ON m.doc_id = bi.b WHERE l.quality = 0 GROUP BY l.doc_id")
def max_identity_to_class(spark, d):
    return pairs.best_to_class(*_classes(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), 0, 1)


_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END"


@query(f"WITH {_PAIRS}, s AS (SELECT doc_id AS id, {_SPLIT} AS split FROM documents), x AS (SELECT a, b, jaccard, least(p.split, q.split) || '|' || greatest(p.split, q.split) AS splits FROM pairs JOIN s p ON p.id = a JOIN s q ON q.id = b WHERE p.split <> q.split) SELECT splits, count(*) AS n, max(jaccard) AS largest, quantile_cont(jaccard, 0.5) AS middle, count(*) FILTER (jaccard >= 0.4) AS over, (list(a || '-' || b ORDER BY jaccard DESC, a, b))[1] AS worst FROM x GROUP BY splits")
def cross_split_verify(spark, d):
    kinds = _kinds(spark, d, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(_SPLIT).alias("kind"))).where("x <> y")
    j, first = F.col("jaccard"), F.min_by("least", F.struct(-F.col("jaccard"), "least"))
    out = kinds.groupBy(F.concat_ws("|", "x", "y").alias("splits")).agg(F.sum("n").alias("n"), F.max(j).alias("largest"), F.percentile(j, 0.5, F.col("n")).alias("middle"), F.coalesce(F.sum(F.when(j >= 0.4, F.col("n"))), F.lit(0)).alias("over"), first.alias("w"))
    return out.select("splits", "n", "largest", "middle", "over", F.concat_ws("-", "w.a", "w.b").alias("worst"))


@query()
def split_assignment(spark, d):
    members = _components(spark, d).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return members.join(splits.assign(members), "component").select("doc_id", "component", "split")


@query(f"WITH {_PAIRS}, bad AS (SELECT a AS id, b AS o FROM pairs WHERE jaccard >= 0.9 UNION SELECT b, a FROM pairs WHERE jaccard >= 0.9) SELECT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT id FROM bad JOIN labels l ON l.doc_id = o WHERE l.quality = 1)")
def cross_label_drop(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return pairs.best_to_class(*_classes(spark, d, 0.9), labels, 0, 1).where("best < 0.9").select(F.col("id").alias("doc_id"))


_Q = "q AS (SELECT DISTINCT id, s FROM g), t AS (SELECT DISTINCT item_id AS target, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM benchmark), unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5)"


@query(f"WITH {_GRAMS}, {_Q}, c AS (SELECT id, target, count(*) AS common FROM q JOIN t USING (s) GROUP BY 1, 2) SELECT id, count(*) AS hits, (list(target ORDER BY common DESC, target))[1] AS target, max(common) AS common FROM c GROUP BY id")
def best_hit_search(spark, d):
    return pairs.best_hits(pairs.shingles(table(spark, d, "documents"), "doc_id", "text"), pairs.shingles(table(spark, d, "benchmark"), "item_id", "text"))


# --- metrics and resampling -----------------------------------------------------------------------------------------------


@query(f"WITH {HUB}, w AS (SELECT *, 1 AS w FROM hub) SELECT {AUC} AS auc, (SELECT sum(p.y * pr.precision) / sum(p.y) FROM (WITH {PR} SELECT * FROM pr) pr JOIN hub p ON p.score = pr.threshold) AS ap, (SELECT sum(y) FROM hub)::BIGINT AS n_pos, (SELECT count(*) - sum(y) FROM hub)::BIGINT AS n_neg FROM w p, w n WHERE p.y = 1 AND n.y = 0")
def auc_ap(spark, d):
    return metrics.ranking(hub(spark, d))


@query(f"WITH {HUB}, {PR} SELECT threshold, precision, recall, f1 FROM f")
def pr_curve(spark, d):
    return metrics.precision_recall(hub(spark, d))


@query(f"WITH {HUB}, {PR} SELECT f1, threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def best_f1(spark, d):
    return metrics.best_f1(hub(spark, d))


@query(f"WITH {HUB}, c AS (SELECT tier, count(*) FILTER (score >= 0.1 AND y = 1) AS tp, count(*) FILTER (score >= 0.1 AND y = 0) AS fp, count(*) FILTER (score < 0.1 AND y = 1) AS fn, count(*) FILTER (score < 0.1 AND y = 0) AS tn FROM hub GROUP BY tier), p AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM c) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p")
def confusion(spark, d):
    return metrics.confusion(hub(spark, d), 0.1, ["tier"])


@query(f"WITH {HUB}, w AS (SELECT *, 1 AS w FROM hub) SELECT n.tier, {AUC} AS auc, count(DISTINCT p.doc_id) AS n_pos, count(DISTINCT n.doc_id) AS n_neg FROM w p, w n WHERE p.y = 1 AND n.y = 0 GROUP BY n.tier")
def per_tier_auc(spark, d):
    return metrics.by_tier(hub(spark, d), "tier").select("tier", "auc", "n_pos", "n_neg")


@query(f"WITH {HUB}, {PR} SELECT need, max(recall) AS recall FROM f, (SELECT unnest([0.8, 0.85, 0.9, 0.95])::DOUBLE AS need) WHERE precision >= need GROUP BY need")
def recall_at_precision(spark, d):
    needs = F.explode(F.array(*map(F.lit, (0.8, 0.85, 0.9, 0.95)))).alias("need")
    return metrics.precision_recall(hub(spark, d)).select("*", needs).where("precision >= need").groupBy("need").agg(F.max("recall").alias("recall"))


@query(f"WITH {HUB} SELECT min(r) AS first_error FROM (SELECT y, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM hub) WHERE y = 0")
def first_error_rank(spark, d):
    top = F.max(F.struct("score", -F.col("doc_id"))).alias("e")
    h = hub(spark, d)
    error = h.where("y = 0").agg(top)
    ahead = h.join(F.broadcast(error), F.struct("score", -F.col("doc_id")) >= F.col("e"))
    return ahead.agg(F.count("*").alias("first_error"))


@query(f"WITH {HUB}, t AS (SELECT unnest(range(0, 21)) / 200.0::DOUBLE AS cut) SELECT cut, count(*) FILTER (score >= cut AND y = 1) AS tp, count(*) FILTER (score >= cut AND y = 0) AS fp FROM hub, t GROUP BY cut")
def cutoff_sweep(spark, d):
    cuts = F.explode(F.array(*[F.lit(i / 200.0) for i in range(21)])).alias("cut")
    hit = F.col("score") >= F.col("cut")
    return hub(spark, d).select("*", cuts).groupBy("cut").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"))


@query()
def group_bootstrap(spark, d):
    return resampling.bootstrap(hub(spark, d), "grp", 2000).select("draw", "auc")


@query()
def group_bootstrap_ci(spark, d):
    ci = resampling.interval(resampling.bootstrap(hub(spark, d), "grp", 2000), "auc")
    return ci.select("n", "low", "middle", "high")


@query()
def paired_bootstrap(spark, d):
    h = hub(spark, d).withColumn("other", F.pmod(F.col("doc_id") * 7, F.lit(100)))
    every = resampling.bootstraps(h, "grp", 4000, "pair", "y", ["score", "other"])
    x, y = (F.max(F.when(F.col("which") == i, F.col("auc"))).alias(name) for i, name in enumerate("xy"))
    both = every.groupBy("draw").agg(x, y).where("x is not null and y is not null").withColumn("delta", F.col("x") - F.col("y"))
    low, high = (F.round(F.percentile("delta", q), 9) for q in (0.025, 0.975))
    return both.agg(F.count("*").alias("n"), F.round(F.avg("delta"), 9).alias("mean"), low.alias("low"), high.alias("high"), F.avg((F.col("delta") > 0).cast("double")).alias("p_better"), F.round(F.corr("x", "y"), 9).alias("corr"))


@query()
def stratified_bootstrap(spark, d):
    h = hub(spark, d).withColumn("key", F.concat_ws("-", "y", "grp"))
    return resampling.interval(resampling.bootstrap(h, "key", 2000, "two", strata="y"), "auc")


@query()
def permutation_floor(spark, d):
    """The average precision of 4,000 random rankings of as many positives and negatives as the data have, against the observed one."""
    seen = metrics.ranking(hub(spark, d)).first()
    n_pos, n_neg = (int(seen[c] or 0) for c in ("n_pos", "n_neg"))
    null = resampling.permutation_floor(n_pos, n_neg, spark.range(4000).withColumnRenamed("id", "draw"))
    over = F.avg((F.col("ap") >= F.lit(seen["ap"]).cast("double")).cast("double"))
    counts = [F.lit(n_pos).cast("bigint").alias("n_pos"), F.lit(n_neg).cast("bigint").alias("n_neg"), F.lit(seen["ap"]).cast("double").alias("observed")]
    return null.agg(F.avg("ap").alias("mean"), F.percentile("ap", 0.99).alias("p99"), over.alias("p_value")).select(*counts, "mean", "p99", "p_value")


@query()
def shuffled_null(spark, d):
    """The motif's rate over all non-empty sequences, whole, and over 20 shuffles of each."""
    rows = docs_(spark, d).where(F.length("seq") > 0).select("doc_id", "lang", "seq").repartition(spark.sparkContext.defaultParallelism * 4)
    hits = resampling.shuffled_hits(rows, "doc_id", "seq", "E[STN]H", 20, ["lang"])
    rates = hits.groupBy("lang").agg(F.avg(F.col("observed").cast("double")).alias("observed"), (F.sum("hits").cast("double") / F.sum("draws")).alias("null_rate"))
    return rates.withColumn("enrichment", F.try_divide("observed", "null_rate"))


@query(f"WITH {HUB}, s AS (SELECT grp, count(*) AS n FROM hub WHERE y = 1 GROUP BY grp) SELECT sum(n)::BIGINT AS n, count(*) AS groups, sum(n)::DOUBLE * sum(n) / sum(n * n) AS kish FROM s")
def kish_ess(spark, d):
    s = hub(spark, d).where("y = 1").groupBy("grp").agg(F.count("*").alias("n"))
    return s.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), (F.sum("n").cast("double") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("kish"))


@query(f"WITH {HUB}, w AS (SELECT y, grp, median(score) AS score, 1 AS w FROM hub GROUP BY y, grp) SELECT 2 * {AUC} - 1 AS delta FROM w p, w n WHERE p.y = 1 AND n.y = 0")
def group_collapsed_effect(spark, d):
    one = hub(spark, d).groupBy("y", "grp").agg(F.median("score").alias("score"))
    return metrics.ranking(one).select((2 * F.col("auc") - 1).alias("delta"))


@query(f"WITH {HUB} SELECT ntile, count(*) AS n, avg(y) AS accuracy FROM (SELECT y, ntile(4) OVER (ORDER BY score, doc_id) AS ntile FROM hub) GROUP BY ntile")
def score_quartiles(spark, d):
    h = ordering.tiles(hub(spark, d), ["score", "doc_id"], 4)
    return h.groupBy("ntile").agg(F.count("*").alias("n"), F.avg("y").alias("accuracy"))


@query(f"WITH {HUB}, c AS (SELECT CASE WHEN score >= 0.1 AND toxic = 0 THEN 'A' WHEN score >= 0.1 THEN 'B' ELSE 'C' END AS evidence, y FROM hub) SELECT evidence, count(*) AS n, avg(y) AS share, avg(y) / (SELECT avg(y) FROM c) AS enrichment FROM c GROUP BY evidence")
def evidence_tiers(spark, d):
    h = hub(spark, d).withColumn("evidence", F.when((F.col("score") >= 0.1) & (F.col("toxic") == 0), "A").when(F.col("score") >= 0.1, "B").otherwise("C"))
    whole = h.agg(F.avg("y").alias("all"))
    return h.groupBy("evidence").agg(F.count("*").alias("n"), F.avg("y").alias("share")).crossJoin(F.broadcast(whole)).select("evidence", "n", "share", (F.col("share") / F.col("all")).alias("enrichment"))


@query(f"WITH {HUB} SELECT score >= 0.1 AS a, toxic = 1 AS b, count(*) AS n FROM hub GROUP BY 1, 2")
def agreement_cells(spark, d):
    return hub(spark, d).groupBy((F.col("score") >= 0.1).alias("a"), (F.col("toxic") == 1).alias("b")).agg(F.count("*").alias("n"))


# --- vectors and features ---------------------------------------------------------------------------------------------------

_LONG = "l AS (SELECT vec_id, label = 0 AS pos, i - 1 AS latent, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i))"


def _long(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") == 0).alias("pos"), F.posexplode("embedding").alias("latent", "v")).withColumn("v", F.col("v").cast("double"))


@query(f"WITH {_LONG}, s AS (SELECT latent, avg(v) FILTER (pos) AS mp, avg(v) FILTER (NOT pos) AS mc, stddev_pop(v) FILTER (NOT pos) AS sc, stddev_pop(v) AS sa, avg((v > 0)::INT) FILTER (pos) AS prevalence FROM l GROUP BY latent) SELECT latent, round((mp - mc) / (sc + 1e-6), 9) AS raw, round((mp - mc) / (sc + (SELECT median(sa) FROM s)), 9) AS floored, prevalence FROM s")
def differential_score(spark, d):
    v, pos = F.col("v"), F.col("pos")
    s = _long(spark, d).groupBy("latent").agg(F.avg(F.when(pos, v)).alias("mp"), F.avg(F.when(~pos, v)).alias("mc"), F.stddev_pop(F.when(~pos, v)).alias("sc"), F.stddev_pop(v).alias("sa"), F.avg(F.when(pos, (v > 0).cast("double"))).alias("prevalence"))
    gap = F.col("mp") - F.col("mc")
    return s.crossJoin(F.broadcast(s.agg(F.median("sa").alias("floor")))).select("latent", F.round(gap / (F.col("sc") + 1e-6), 9).alias("raw"), F.round(gap / (F.col("sc") + F.col("floor")), 9).alias("floored"), "prevalence")


@query(f"WITH {_LONG} SELECT count(*) FILTER (sd = 0) AS n_zero, count(*) AS n FROM (SELECT latent, stddev_pop(v) FILTER (NOT pos) AS sd FROM l GROUP BY latent)")
def zero_variance(spark, d):
    return _long(spark, d).where("not pos").groupBy("latent").agg(F.stddev_pop("v").alias("sd")).agg(F.count_if(F.col("sd") == 0).alias("n_zero"), F.count("*").alias("n"))


@query(f"WITH {_LONG}, x AS (SELECT p.latent, sum(CASE WHEN p.v > n.v THEN 1 WHEN p.v < n.v THEN -1 ELSE 0 END)::DOUBLE / count(*) AS delta FROM l p JOIN l n ON n.latent = p.latent WHERE p.pos AND NOT n.pos GROUP BY p.latent) SELECT latent, delta FROM x")
def cliffs_delta(spark, d):
    rows = _long(spark, d).select("latent", F.col("pos").cast("int").alias("y"), F.col("v").alias("score"))
    return metrics.ranking(rows, ["latent"]).select("latent", (2 * F.col("auc") - 1).alias("delta"))


_TOP = "m AS (SELECT label, latent, avg(v) AS mean FROM (SELECT label, i - 1 AS latent, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i)) GROUP BY 1, 2), top AS (SELECT label, latent FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY mean DESC, latent) <= 8)"


@query(f"WITH {_TOP} SELECT a.label AS x, b.label AS y, count(*) AS shared FROM top a JOIN top b ON a.latent = b.latent AND a.label < b.label GROUP BY 1, 2")
def top_overlap(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("latent", "v")).groupBy("label", "latent").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    top = sampling.top_per_group(rows, "label", [F.desc("mean"), "latent"], 8)
    return top.select(F.col("label").alias("x"), "latent").join(top.select(F.col("label").alias("y"), "latent"), "latent").where("x < y").groupBy("x", "y").agg(F.count("*").alias("shared"))


@query(f"WITH {_LONG} SELECT label, latent, round(avg(v), 9) AS mean, max(v) AS top FROM l JOIN embeddings USING (vec_id) GROUP BY 1, 2")
def pooled_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("latent", "v")).withColumn("v", F.col("v").cast("double"))
    return rows.groupBy("label", "latent").agg(F.round(F.avg("v"), 9).alias("mean"), F.max("v").alias("top"))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS cos, list_position(a.embedding, list_max(a.embedding)) - 1 AS peak, len(list_filter(a.embedding, lambda x: x > 0)) AS n_active, greatest(a.embedding[4], a.embedding[8], a.embedding[16])::DOUBLE AS best3 FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b")
def vector_measures(spark, d):
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("b"))
    a = F.col("embedding")
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(vec.cosine(a, F.col("b")), 9).alias("cos"), vec.peak(a).alias("peak"), vec.active(a).alias("n_active"), F.array_max(vec.pick(a, [3, 7, 15])).cast("double").alias("best3"))


@query(f"SELECT doc_id, substr(s, greatest(p - 8, 0) + 1, p + 7 - greatest(p - 8, 0)) AS win, CASE WHEN p + 2 < length(s) THEN substr(s, p + 3, 1) END AS ahead FROM (SELECT doc_id, s, length(regexp_extract(s, '^(.*?)E[STN]H', 1)) + 1 AS p FROM (SELECT doc_id, {SEQ} AS s FROM documents) WHERE regexp_matches(s, 'E[STN]H'))")
def peak_window(spark, d):
    at = F.regexp_instr("seq", F.lit("E[STN]H"))
    rows = docs_(spark, d).where(F.col("seq").rlike("E[STN]H")).withColumn("p", at)
    return rows.select("doc_id", sq.centred(F.col("seq"), F.col("p") - 1, 7).alias("win"), sq.letter_at(F.col("seq"), F.col("p") + 2).alias("ahead"))


@query(f"WITH w AS (SELECT substr(s, p, 7) AS s FROM (SELECT s, length(regexp_extract(s, '^(.*?)E[STN]H', 1)) + 1 AS p FROM (SELECT {SEQ} AS s FROM documents) WHERE regexp_matches(s, 'E[STN]H'))), c AS (SELECT i AS col, substr(s, i, 1) AS letter, count(*) AS n FROM w, range(1, 8) AS r(i) WHERE i <= length(s) GROUP BY 1, 2) SELECT col, letter, n, n::DOUBLE / sum(n) OVER (PARTITION BY col) AS share FROM c QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, letter) <= 3")
def position_profile(spark, d):
    win = F.substr("seq", F.regexp_instr("seq", F.lit("E[STN]H")), F.lit(7))
    rows = docs_(spark, d).where(F.col("seq").rlike("E[STN]H")).select(F.posexplode(F.filter(F.split(win, ""), lambda c: c != "")).alias("col", "letter"))
    counts = rows.groupBy((F.col("col") + 1).alias("col"), "letter").agg(F.count("*").alias("n")).withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("col")))
    return sampling.top_per_group(counts, "col", [F.desc("n"), "letter"], 3).drop("place")


@query()
def probe_logistic(spark, d):
    from loomlake.operators.probe import fit_scores

    return fit_scores(table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("y")), "vec_id", "embedding", "y")


@query()
def cv_oof_scores(spark, d):
    from loomlake.operators.probe import out_of_fold

    return out_of_fold(table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("y")), "vec_id", "embedding", "y")


@query("SELECT event_type, user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def incremental_scores(spark, d):
    from loomlake.streaming.incremental import totals_by_stream

    return totals_by_stream(spark, f"{d}/events.parquet")


@query("WITH h AS (SELECT lang AS y, CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' la ') THEN 'fr' ELSE 'es' END AS pred FROM documents), c AS (SELECT DISTINCT y AS cls FROM h) SELECT cls, count(*) FILTER (y = cls AND pred = cls) AS tp, count(*) FILTER (y = cls) AS support, coalesce(count(*) FILTER (y = cls AND pred = cls)::DOUBLE / nullif(count(*) FILTER (pred = cls), 0), 0) AS precision, coalesce(count(*) FILTER (y = cls AND pred = cls)::DOUBLE / nullif(count(*) FILTER (y = cls), 0), 0) AS recall FROM h, c GROUP BY cls")
def per_class_report(spark, d):
    text = F.col("text")
    pred = F.when(F.contains(text, F.lit(" the ")), "en").when(F.contains(text, F.lit(" der ")), "de").when(F.contains(text, F.lit(" la ")), "fr").otherwise("es")
    cells = table(spark, d, "documents").groupBy(F.col("lang").alias("y"), pred.alias("pred")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col("y").alias("cls")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("support"))
    said = cells.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("said"))
    share = lambda of: F.coalesce(F.try_divide(F.col("tp").cast("double"), of), F.lit(0.0))
    return actual.join(said, "cls", "left").select("cls", "tp", "support", share(F.col("said")).alias("precision"), share(F.col("support")).alias("recall"))
