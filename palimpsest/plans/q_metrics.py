"""Answer metrics: golds are rows' own texts, predictions are altered by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import metrics as m
from palimpsest.operators import aggregates as ag
from palimpsest.plans.registry import query, table

# Predictions: the type of the next part; golds: the part's own type.
_PAIRS = "(SELECT a.p_partkey AS id, lower(a.p_type) AS gold, lower(b.p_type) AS pred, b.p_type AS raw_pred, a.p_type AS raw_gold FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"
_NORM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_W = "string_split({0}, ' ')"
_COMMON = "list_sum(list_transform(list_distinct(list_intersect({p}, {g})), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({g}, lambda x: x = w)))))"
_F1 = f"coalesce(2 * {_COMMON} / (len({{p}}) + len({{g}})), 0.0)"


def f1(p="string_split(pred, ' ')", g="string_split(gold, ' ')"):
    return _F1.format(p=p, g=g)


_TIN = "['tin']"
_PROMO_TIN = "['promo', 'tin']"


def _pairs(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("pred"))
    return p.join(b, "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("gold"), "pred")


def _r(c):
    return F.round(c, 6)


@query("m1_string_contain", f"SELECT id, contains({_NORM.format('pred')}, {_NORM.format('gold')}) AS ok FROM {_PAIRS}")
def m1(spark, d):
    return _pairs(spark, d).select("id", m.string_contain(F.col("pred"), F.array("gold", F.lit(" "))).alias("ok"))


@query("m2_exact_match", f"SELECT id, {_NORM.format('pred')} = {_NORM.format('gold')} OR {_NORM.format('pred')} = 'promotin' AS ok FROM {_PAIRS}")
def m2(spark, d):
    return _pairs(spark, d).select("id", m.exact_match(F.col("pred"), F.array("gold", F.lit("Promo tin!"))).alias("ok"))


_OPT = "(SELECT p_partkey AS id, p_size % 3 AS a, p_partkey % 3 AS b FROM part)"


def _options(spark, d):
    letters = lambda c: F.when(c == 0, "A").when(c == 1, "A, B").otherwise("none here")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), letters(F.col("p_size") % 3).alias("out"), letters(F.col("p_partkey") % 3).alias("ans"))


@query("m3_option_match", f"SELECT id, a = b AS ok FROM {_OPT}")
def m3(spark, d):
    return _options(spark, d).select("id", m.option_match(F.col("out"), F.col("ans")).alias("ok"))


@query("m4_option_score", f"SELECT id, CAST(CASE WHEN b = 2 THEN 0 WHEN a = b THEN 1 WHEN a = 2 THEN 0 WHEN b = 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM {_OPT}")
def m4(spark, d):
    return _options(spark, d).select("id", m.option_score(F.col("out"), F.col("ans")).alias("score"))


@query("m5_token_f1", f"SELECT id, round({f1()}, 6) AS score FROM {_PAIRS}")
def m5(spark, d):
    return _pairs(spark, d).select("id", _r(m.token_f1(F.col("pred"), F.col("gold"))).alias("score"))


@query("m6_multi_hop_f1", f"SELECT id, round((greatest({f1()}, {f1(p=_TIN)}) + greatest({f1(g=_TIN)}, 1.0)) / 2, 6) AS score FROM {_PAIRS}")
def m6(spark, d):
    return _pairs(spark, d).select("id", _r(m.multi_hop_f1(F.concat("pred", F.lit(", tin")), F.concat("gold", F.lit(",tin ,")))).alias("score"))


@query("m7_by_category", f"SELECT id, round(CASE WHEN id % 2 = 0 THEN {f1()} ELSE 0.0 END, 6) AS score, CASE WHEN id % 2 = 0 THEN {f1()} >= 0.5 ELSE FALSE END AS ok FROM {_PAIRS}")
def m7(spark, d):
    category = F.when(F.col("id") % 2 == 0, 1).otherwise(5)
    score, ok = m.by_category(category, F.col("pred"), F.col("gold"))
    return _pairs(spark, d).select("id", _r(score).alias("score"), ok.alias("ok"))


@query("m8_floored_f1", f"SELECT id, round(greatest({f1()}, CASE WHEN pred = gold THEN 0.5 ELSE 0 END), 6) AS score FROM {_PAIRS}")
def m8(spark, d):
    return _pairs(spark, d).select("id", _r(m.floored_f1(F.col("pred"), F.col("gold"))).alias("score"))


@query("m9_permissive_f1", f"SELECT id, round(greatest({f1()}, CASE WHEN contains(pred, gold) OR contains(gold, pred) OR starts_with(pred, substr(gold, 1, 5)) THEN 0.5 ELSE 0 END), 6) AS score FROM {_PAIRS}")
def m9(spark, d):
    return _pairs(spark, d).select("id", _r(m.permissive_f1(F.col("pred"), F.col("gold"))).alias("score"))


@query("m10_declines", "SELECT event_id, user_id % 3 = 0 AS declined FROM events")
def m10(spark, d):
    said = F.when(F.col("user_id") % 3 == 0, "Sorry, that is Not Mentioned anywhere").otherwise("it was a click")
    return table(spark, d, "events").select("event_id", m.declines(said).alias("declined"))


@query("m11_temporal_f1", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM orders")
def m11(spark, d):
    day = F.date_format("o_orderdate", "d MMMM yyyy")
    score, _ = m.by_category(F.lit(2), F.when(F.col("o_orderkey") % 2 == 0, day).otherwise("unsure"), day)
    return table(spark, d, "orders").select("o_orderkey", score.alias("score"))


@query("m12_composite", "SELECT l_orderkey, l_linenumber, round((0.35 * l_tax + 0.35 * l_discount + 0.3 * 0.5) * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0.5 END * CASE l_linestatus WHEN 'O' THEN 0.9 ELSE 0.5 END, 6) AS score FROM lineitem")
def m12(spark, d):
    score = m.composite(F.col("l_tax"), F.col("l_discount"), F.lit(0.5), F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "O", "good").otherwise("odd"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(score).alias("score"))


_FOUND = "WITH g AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS u, list(DISTINCT l_partkey) FILTER (WHERE l_tax > 0.03) AS gold FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey, gold, list_sort(u)[1:3] AS found FROM g WHERE gold IS NOT NULL)"


@query("m13_session_quality", _FOUND + """, s AS (SELECT *, len(list_intersect(found, gold)) AS tp, list_transform(found, lambda x: list_contains(gold, x)) AS rel FROM f)
SELECT l_orderkey, CAST(tp AS INTEGER) AS tp, round(tp / len(found), 6) AS precision, round(tp / len(gold), 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (len(found) + len(gold)) ELSE 0 END, 6) AS f1,
round(coalesce(list_sum(list_transform(rel, lambda x, i: CASE WHEN x THEN len(list_filter(rel[1:i], lambda y: y)) / i ELSE 0 END)), 0) / len(gold), 6) AS ap, round(coalesce(1.0 / nullif(list_position(rel, TRUE), 0), 0.0), 6) AS rr, tp > 0 AS hit, tp = len(found) AND tp = len(gold) AS exact FROM s""")
def m13(spark, d):
    ids = F.array_sort(F.collect_set("l_partkey"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(ids, 1, 3).alias("found"), F.array_sort(F.collect_set(F.when(F.col("l_tax") > 0.03, F.col("l_partkey")))).alias("gold"))
    q = rows.select("l_orderkey", m.session_quality(F.col("found"), F.col("gold")).alias("q")).filter("q is not null")
    return q.select("l_orderkey", "q.tp", *[_r(F.col(f"q.{c}")).alias(c) for c in ("precision", "recall", "f1", "ap", "rr")], "q.hit", "q.exact")


@query("w7_ap_rr", _FOUND + ", x AS (SELECT l_orderkey, len(gold) AS n, i, list_contains(gold, found[i]) AS rel FROM f, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= len(found)), c AS (SELECT *, sum(CASE WHEN rel THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING) / i AS p FROM x) SELECT l_orderkey, round(sum(CASE WHEN rel THEN p ELSE 0 END) / any_value(n), 6) AS ap, round(coalesce(1.0 / min(CASE WHEN rel THEN i END), 0.0), 6) AS rr FROM c GROUP BY 1")
def w7(spark, d):
    return m13(spark, d).select("l_orderkey", "ap", "rr")


@query("m14_metric_defaults", "SELECT event_type, CASE event_type WHEN 'click' THEN 'option_match' WHEN 'view' THEN 'string_contain' ELSE 'token_f1' END AS metric FROM (SELECT DISTINCT event_type FROM events)")
def m14(spark, d):
    kind = F.when(F.col("event_type") == "click", "single_choice").when(F.col("event_type") == "view", "short_answer").otherwise("open")
    mapping = F.create_map(*[F.lit(x) for kv in m.DEFAULTS.items() for x in kv])
    return table(spark, d, "events").select("event_type").distinct().select("event_type", F.element_at(mapping, kind).alias("metric"))


@query("m15_best_over_golds", f"SELECT id, CAST(CASE WHEN {_NORM.format('pred')} IN ({_NORM.format('gold')}, 'promotin') THEN 1 ELSE 0 END AS DOUBLE) AS em, round(greatest({f1()}, {f1(g=_PROMO_TIN)}), 6) AS f1 FROM {_PAIRS}")
def m15(spark, d):
    golds = F.array("gold", F.lit("Promo tin"))
    return _pairs(spark, d).select("id", m.best_over(m.em, F.col("pred"), golds).alias("em"), _r(m.best_over(m.token_f1, F.col("pred"), golds)).alias("f1"))


@query("m16_set_f1_rouge", f"SELECT id, round({f1('list_distinct(' + _W.format('pred') + ')', 'list_distinct(' + _W.format('gold') + ')')}, 6) AS set_f1, round({f1()}, 6) AS rouge_1 FROM {_PAIRS}")
def m16(spark, d):
    return _pairs(spark, d).select("id", _r(m.set_f1(F.col("pred"), F.col("gold"))).alias("set_f1"), _r(m.rouge_n(F.col("pred"), F.col("gold"), 1)).alias("rouge_1"))


@query("m16_rouge2_bleu")
def m16b(spark, d):
    return _pairs(spark, d).select("id", _r(m.rouge_n(F.col("pred"), F.col("gold"), 2)).alias("rouge_2"), _r(m.bleu(F.col("pred"), F.col("gold"))).alias("bleu"))


@query("m16_rouge_l_meteor")
def m16c(spark, d):
    return _pairs(spark, d).select("id", _r(m.rouge_l(F.col("pred"), F.col("gold"))).alias("rouge_l"), _r(m.meteor(F.col("pred"), F.col("gold"))).alias("meteor"))


@query("m17_category_scores", f"WITH s AS (SELECT id % 3 AS category, {f1()} AS f FROM {_PAIRS}) SELECT category, count(*) AS n, round(avg(f), 6) AS score FROM s GROUP BY ROLLUP (category)")
def m17(spark, d):
    rows = _pairs(spark, d).select((F.col("id") % 3).alias("category"), m.token_f1(F.col("pred"), F.col("gold")).alias("score"), F.lit(True).alias("is_correct"))
    return ag.accuracy(rows, "category").select("category", F.col("executed").alias("n"), _r(F.col("avg_score")).alias("score"))


@query("m18_rejudged", "SELECT event_id, value AS local_score, CAST(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.25 END AS DOUBLE) AS judge_score FROM events")
def m18(spark, d):
    e = table(spark, d, "events")
    saved = e.select("event_id", F.col("value").alias("local_score"), F.lit(0.25).alias("judge_score"))
    return m.rejudged(saved, e.filter("event_id % 3 = 0").select("event_id", F.lit(1.0).alias("judge_score")), "event_id")
