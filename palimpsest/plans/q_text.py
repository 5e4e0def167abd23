"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import chunks, dates, stem, text as tx
from palimpsest.functions import vectors
from palimpsest.plans.registry import query, table
from palimpsest.sources import ingest

_P = "[!-/:-@\\[-`{-~]"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang")


@query("n1_normalize_text", f"SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '{_P}', '', 'g'), '\\s+', '', 'g'))) AS digest FROM documents")
def n1(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@query("n2_normalize_answer", f"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(text, ',', '', 'g')), '{_P}', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the', 'and')), ' ')) AS digest FROM documents")
def n2(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.normalize_answer(F.col("text"))).alias("digest"))


@query("n3_stems")
def n3(spark, d):
    w = _docs(spark, d).select(F.explode(tx.ascii_tokens(F.col("text"))).alias("word")).distinct()
    return w.select("word", stem.porter("word").alias("stem"))


@query("n4_number_words", "SELECT l_orderkey, l_linenumber, 'row ' || l_linenumber || ' of 12' AS phrase FROM lineitem")
def n4(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("One", "two", "THREE", "Four", "five", "SIX", "Seven"))), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.number_words(F.concat_ws(" ", F.lit("row"), name, F.lit("of twelve"))).alias("phrase"))


@query("n5_option_letters", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B,D' ELSE '' END AS letters FROM part")
def n5(spark, d):
    answer = F.when(F.col("p_size") % 3 == 0, "the answer is (a).").when(F.col("p_size") % 3 == 1, "选D, or 答案是：b").otherwise("none known")
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.option_letters(answer), ",").alias("letters"))


@query("n6_alnum_tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')) AS n FROM documents")
def n6(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tx.alnum_tokens(F.col("text"))).cast("long").alias("n"))


@query("n7_language", "SELECT doc_id, CASE WHEN (length(t) - length(regexp_replace(t, '[一-鿿]', '', 'g'))) / length(t) > 0.1 THEN 'zh' ELSE 'en' END AS language FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN repeat('中文字符', length(text) // 20 + 1) || text ELSE text END AS t FROM documents)")
def n7(spark, d):
    t = F.when(F.col("doc_id") % 10 == 0, F.expr("concat(repeat('中文字符', cast(length(text) div 20 + 1 as int)), text)")).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", tx.language(t).alias("language"))


@query("n8_tokenize", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS n FROM documents")
def n8(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tx.tokenize(F.col("text"))).cast("long").alias("n"))


@query("n9_stop_words", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x NOT IN ('', 'the', 'of', 'la', 'de', 'die'))) AS n FROM documents")
def n9(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tx.without_stop_words(tx.words(F.col("text")), ["the", "of", "la", "de", "die"])).cast("long").alias("n"))


@query("n10_paragraph_chunks")
def n10(spark, d):
    return chunks.paragraphs(_docs(spark, d), "doc_id", "text", 120)


@query("n11_estimated_tokens", "SELECT doc_id, CAST(floor(length(text) / 3.0) AS BIGINT) AS n FROM documents")
def n11(spark, d):
    return _docs(spark, d).select("doc_id", tx.estimated_tokens(F.col("text")).alias("n"))


@query("n12_slots", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slot FROM part")
def n12(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.slot(F.concat_ws(" ", "p_name", "p_type")).alias("slot"))


@query("n13_subjects", "SELECT event_id, CASE event_type WHEN 'click' THEN 'user ' || user_id WHEN 'view' THEN 'Viewer' ELSE event_type END AS subject FROM events")
def n13(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_type") == "click", " Me ").otherwise(F.col("event_type"))
    return e.select("event_id", tx.resolve_subject(raw, F.concat(F.lit("user "), "user_id"), {"VIEW": "Viewer"}, ["Dana"]).alias("subject"))


@query("n14_semantic_text", "SELECT doc_id, substr(lang || ' | ' || source || ' | ' || text, 1, 400) AS t FROM documents")
def n14(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.semantic_text([F.col("lang"), F.lit(""), F.col("source"), F.col("text")], 400).alias("t"))


@query("n15_stable_ids", "SELECT count(*) AS n, (SELECT count(DISTINCT (lang, source)) FROM documents) AS n_ids FROM documents")
def n15(spark, d):
    return table(spark, d, "documents").select(tx.stable_id("clm_", F.col("lang"), F.col("source")).alias("i")).agg(F.count("*").alias("n"), F.count_distinct("i").alias("n_ids"))


@query("n16_json_extraction", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def n16(spark, d):
    wrapped = F.concat(F.lit("<think>no {\"k\": 0}</think> Here:\n```json\n{\"k\": \"old\"}\n```\n```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.get_json_object(tx.last_fenced_json(tx.without_thinking(wrapped)), "$.k").alias("k"))


@query("n16_balanced_json")
def n16b(spark, d):
    return table(spark, d, "events").select("event_id", chunks.balanced_json(F.concat(F.lit("note {"), "props", F.lit(" tail"))).alias("json"))


@query("n17_session_stamp", "SELECT o_orderkey, CAST(date_trunc('minute', o_orderdate + INTERVAL 815 MINUTE) AS TIMESTAMP) AS stamp FROM orders")
def n17(spark, d):
    at = F.expr("o_orderdate + INTERVAL 815 MINUTE")
    spoken = F.concat(F.lower(F.date_format(at, "h:mm a")), F.lit(" on "), F.date_format(at, "d MMMM, yyyy"))
    return table(spark, d, "orders").select("o_orderkey", dates.session_stamp(spoken).cast("timestamp_ntz").alias("stamp"))


@query("n18_flexible_date", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN make_date(year(o_orderdate), 1, 1) END AS day FROM orders")
def n18(spark, d):
    k = F.col("o_orderkey") % 4
    spoken = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 2, F.date_format("o_orderdate", "'in' yyyy")).otherwise("no date")
    return table(spark, d, "orders").select("o_orderkey", dates.flexible_date(spoken).alias("day"))


@query("n19_date_compare", "SELECT o_orderkey, TRUE AS same FROM orders")
def n19(spark, d):
    a = F.date_format("o_orderdate", "d MMMM yyyy")
    b = F.concat(F.lit("3 days before "), F.date_format(F.expr("o_orderdate + INTERVAL 3 DAY"), "d MMMM, yyyy"))
    return table(spark, d, "orders").select("o_orderkey", dates.same_day(a, b).alias("same"))


@query("n20_weekday_stamp", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS stamp FROM orders")
def n20(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.weekday_stamp(F.date_format("o_orderdate", "yyyy/MM/dd (EEE) HH:mm")).cast("timestamp_ntz").alias("stamp"))


@query("n21_retrieval_query", "SELECT event_id, CASE WHEN event_type = 'click' THEN event_type ELSE event_type || ' ' || user_id END AS q FROM events")
def n21(spark, d):
    prompt = F.when(F.col("event_type") == "click", F.concat(F.lit("Answer this. Question: "), "event_type", F.lit("\nShort:"))).otherwise(F.concat_ws(" ", "event_type", "user_id"))
    return table(spark, d, "events").select("event_id", tx.retrieval_query(prompt, [r"Question:\s*([^\n]+)", r"Q:\s*([^\n]+)"]).alias("q"))


@query("n22_session_text", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def n22(spark, d):
    s = ingest.sessions_of(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return s.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")).alias("digest"))


@query("n23_clean_tokens", f"SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(text, '{_P}', ' ', 'g')), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 1)) AS n FROM documents")
def n23(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tx.clean_tokens(F.col("text"))).cast("long").alias("n"))


@query("n24_dropped_words", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) AS kept FROM (SELECT *, quantile_disc(l_quantity, 0.5) OVER (PARTITION BY l_orderkey) AS q FROM lineitem) WHERE l_quantity >= q GROUP BY 1")
def n24(spark, d):
    words = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("w"))
    return words.select("l_orderkey", chunks.keep_informative(F.col("w"), "l_partkey", "l_quantity", 0.5).alias("kept"))


@query("n25_turn_references", "SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN NULL ELSE 'D' || conv_id || ':' || turn END AS ref FROM conversations")
def n25(spark, d):
    ref = F.concat(F.lit("D"), "conv_id", F.lit(":"), "turn")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("turn ["), ref, F.lit("]"))).when(F.col("turn") % 3 == 1, ref).otherwise("somewhere")
    return table(spark, d, "conversations").select("conv_id", "turn", tx.turn_reference(raw).alias("ref"))


@query("n26_simple_chunks")
def n26(spark, d):
    return chunks.simple(_docs(spark, d), "doc_id", "text", 500, 50)


@query("u7_chunk_generators")
def u7(spark, d):
    """The chunkers as table functions of SQL, a row into many."""
    chunks.register_generators(spark)
    return spark.sql(
        "SELECT doc_id, c.chunk, c.chunk_id, length(c.chunk_text) AS n FROM {docs}, LATERAL paragraph_chunks(text, 120) AS c "
        "UNION ALL SELECT doc_id, -1 - c.chunk, c.chunk_id, length(c.chunk_text) FROM {docs}, LATERAL simple_chunks(text, 500, 50) AS c",
        docs=_docs(spark, d),
    )


@query("n27_urls", "SELECT page_id, len(regexp_extract_all(html, 'https?://[^\\s\"''<>]+')) AS n, TRUE AS restored FROM pages")
def n27(spark, d):
    bare, urls = tx.protect_urls(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(urls).cast("long").alias("n"), (tx.restore_urls(bare, urls) == F.col("html")).alias("restored"))


@query("x3_cosine", "SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def x3(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(vectors.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


_CH = "list_distinct(list_filter(string_split({0}, ''), lambda x: x <> ''))"
_BG = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query("x4_string_similarity", f"SELECT a.p_partkey AS a, b.p_partkey AS b, round(2.0 * len(list_intersect({_CH.format('a.p_type')}, {_CH.format('b.p_type')})) / (len({_CH.format('a.p_type')}) + len({_CH.format('b.p_type')})), 6) AS dice, round(len(list_intersect({_BG.format('a.p_type')}, {_BG.format('b.p_type')})) / len(list_distinct(list_concat({_BG.format('a.p_type')}, {_BG.format('b.p_type')}))), 6) AS jaccard FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def x4(spark, d):
    p = table(spark, d, "part")
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("p_type").alias("ta")), p.select(F.col("p_partkey").alias("b"), F.col("p_type").alias("tb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(vectors.dice(F.col("ta"), F.col("tb")), 6).alias("dice"), F.round(vectors.bigram_jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"))
