"""String, label and rule queries."""

from pyspark.sql import functions as F

from ..functions import classify, diffs, text
from ..operators import evidence, exact
from ..operators.schedule import chunk_id, numbered
from .registry import Tables, query


@query(r"""SELECT doc_id, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS compact, sha256(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}\p{Pc}]', '', 'g')) AS words,
 sha256(trim(regexp_replace(translate(text, '‘’“”', '''''""'), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS typographic FROM documents WHERE text IS NOT NULL""")
def compact_forms(t: Tables):
    c = F.col("text")
    return t.documents.where("text is not null").select("doc_id", F.sha2(text.compact(c), 256).alias("compact"), F.sha2(text.word_compact(c), 256).alias("words"), F.sha2(text.typographic(c), 256).alias("typographic"))


_LABEL = "('Change' || CAST(1 + p_partkey % 3 AS VARCHAR(9)) || ' ' || CAST(1 + p_partkey % 4 AS VARCHAR(9)) || ' - ' || CAST(p_size AS VARCHAR(9)) || CASE WHEN p_partkey % 5 = 0 THEN '.2' WHEN p_partkey % 7 = 0 THEN '/(2-3blank)' ELSE '' END)"


@query(rf"""SELECT label, count(*) AS n FROM (SELECT nullif(regexp_extract(regexp_replace(regexp_replace({_LABEL}, '[\s\x00-\x1f\x7f]+', '', 'g'), 'Change[12]', '', 'g'), '{classify.MARGIN_LABEL}', 1), '') AS label FROM part) GROUP BY label""")
def margin_labels(t: Tables):
    return t.part.select(classify.margin_label(F.expr(_LABEL)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, sha256('{"name": ' || to_json(n_name)::VARCHAR || ', "region": ' || coalesce(to_json(r_name)::VARCHAR, 'null') || ', "size": ' || (n_nationkey * 3)::VARCHAR || '}') AS fingerprint FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2""")
def canonical_fingerprint(t: Tables):
    rows = t.nation.join(t.region.where("r_regionkey <> 2"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.select("n_nationkey", text.fingerprint({"size": F.col("n_nationkey") * 3, "name": F.col("n_name"), "region": F.col("r_name")}).alias("fingerprint"))


_QUOTE = "(CASE WHEN turn % 3 = 0 THEN upper(substring(text, 4, 30)) WHEN turn % 3 = 1 THEN replace(substring(text, 4, 30), ' ', '  ') ELSE substring(text, 4, 30) END)"


@query(rf"""SELECT role, turn % 3 AS kind, count(*) AS n, count(*) FILTER (contains(regexp_replace(trim(text), '[ \t\n\r]+', ' ', 'g'), trim(regexp_replace({_QUOTE}, '[ \t\n\r]+', ' ', 'g')))) AS n_found FROM conversations WHERE text IS NOT NULL GROUP BY ALL""")
def quotes_in_source(t: Tables):
    found = text.quoted(F.col("text"), F.expr(_QUOTE))
    return t.conversations.where("text is not null").groupBy("role", (F.col("turn") % 3).alias("kind")).agg(F.count("*").alias("n"), F.count_if(found).alias("n_found"))


@query(r"""WITH d AS (SELECT item_id, text, string_split(text, '') AS c FROM benchmark), h AS (SELECT item_id, unnest(c) AS ch, generate_subscripts(c, 1) - 1 AS pos FROM d),
k AS (SELECT *, regexp_full_match(ch, '\s') AS ws, lag(regexp_full_match(ch, '\s')) OVER w AS before, max(CASE WHEN NOT regexp_full_match(ch, '\s') THEN pos END) OVER (PARTITION BY item_id) AS last, min(CASE WHEN NOT regexp_full_match(ch, '\s') THEN pos END) OVER (PARTITION BY item_id) AS first FROM h WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
m AS (SELECT *, coalesce(min(CASE WHEN NOT ws THEN pos END) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), pos + 1) AS next FROM k)
SELECT item_id, count(*) AS n, sum(pos)::BIGINT AS places, sum(CASE WHEN ws THEN next ELSE pos + 1 END)::BIGINT AS ends FROM m WHERE pos BETWEEN first AND last AND NOT (ws AND coalesce(before, false)) GROUP BY item_id""")
def normal_positions(t: Tables):
    rows = t.benchmark.select("item_id", diffs.norm_positions("text").alias("n"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("item_id", F.size("n.starts").cast("long").alias("n"), total("n.starts").alias("places"), total("n.ends").alias("ends")).where("n > 0")


_UNIT = "CASE p_partkey % 4 WHEN 0 THEN 'psi_kPa' WHEN 1 THEN 'in_mm' WHEN 2 THEN 'lb_kg' ELSE 'unknown' END"


@query(f"SELECT unit, count(*) AS n, round(sum(p_size * CASE unit WHEN 'psi_kPa' THEN 6.894757::DOUBLE WHEN 'in_mm' THEN 25.4::DOUBLE WHEN 'lb_kg' THEN 0.45359237::DOUBLE END), 4) AS total FROM (SELECT *, {_UNIT} AS unit FROM part) GROUP BY unit")
def unit_conversions(t: Tables):
    rows = t.part.withColumn("unit", F.expr(_UNIT))
    return rows.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.sum(classify.convert(F.col("p_size"), F.col("unit"))), 4).alias("total"))


@query(r"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN k + 40 > 100 THEN 'INPUT_EXCEEDS_CONTEXT' WHEN k = 0 THEN 'EMPTY_QUESTION' ELSE 'OK' END AS verdict FROM (SELECT len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')) AS k FROM conversations)) GROUP BY verdict""")
def prompt_budget(t: Tables):
    tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda x: x != ""))
    return t.conversations.select(classify.budget(tokens, 40, 100).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, count(*) FILTER (event_type <> 'view') AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id)
SELECT CASE WHEN n = 0 THEN 'NOT_RUN' WHEN n < 6 THEN 'PARTIAL' WHEN e > 0 THEN 'COMPLETED_WITH_EVAL_ERRORS' ELSE 'COMPLETED' END AS status, count(*) AS users FROM r GROUP BY 1""")
def run_statuses(t: Tables):
    kind = F.col("event_type")
    r = t.events.groupBy("user_id").agg(F.count_if(kind != "view").alias("n"), F.count_if(kind == "error").alias("e"))
    return r.select(classify.run_status(F.col("n"), F.lit(6), F.col("e")).alias("status")).groupBy("status").agg(F.count("*").alias("users"))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN value > 90 THEN 'GEN_TIMEOUT' WHEN value > 80 THEN 'GEN_ERROR' WHEN event_type <> 'error' AND user_id % 4 <> 0 THEN 'OK' ELSE 'GEN_EMPTY' END AS outcome FROM events) GROUP BY outcome""")
def answer_outcomes(t: Tables):
    error = F.when(F.col("value") > 90, "timeout").when(F.col("value") > 80, "other")
    response = F.when(F.col("user_id") % 4 == 0, " ").otherwise(F.col("event_type"))
    return t.events.select(classify.outcome(F.col("event_type") != "error", response, error).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT 'C' || lpad(row_number() OVER (ORDER BY source, doc_id)::VARCHAR, 6, '0') AS chunk, doc_id FROM documents")
def sequence_ids(t: Tables):
    return numbered(t.documents.select("source", "doc_id"), ["source", "doc_id"], "at").select(chunk_id(F.col("at") + 1).alias("chunk"), "doc_id")


@query("""SELECT sum((regexp_matches(p, '^[A-Za-z0-9._/-]+$') AND NOT starts_with(p, '/') AND NOT regexp_matches(p, '(^|/)\\.\\.(/|$)'))::INT)::BIGINT AS safe_paths, sum(regexp_matches(split_part(p, '/', 1), '^[a-z0-9][a-z0-9-]{1,80}$')::INT)::BIGINT AS safe_names, count(*) AS n
 FROM (SELECT CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') ELSE 'a/../' || page_id END AS p FROM pages)""".replace("\\\\", "\\"))
def path_safety(t: Tables):
    url = F.col("url")
    p = F.when(F.col("page_id") % 3 == 0, url).when(F.col("page_id") % 3 == 1, F.regexp_replace(url, "^[a-z]+://", "")).otherwise(F.concat(F.lit("a/../"), "page_id"))
    rows = t.pages.select(p.alias("p"))
    return rows.agg(F.sum(F.col("p").rlike(classify.SAFE_PATH).cast("long")).alias("safe_paths"), F.sum(F.split("p", "/")[0].rlike(classify.SAFE_NAME).cast("long")).alias("safe_names"), F.count("*").alias("n"))


@query(r"""WITH d AS (SELECT doc_id, string_split_regex(text, '[0-9]{4,}') AS g, regexp_extract_all(text, '[0-9]{4,}') AS h FROM documents),
e AS (SELECT doc_id, unnest(h) AS token, unnest(list_transform(generate_series(1, len(h)), lambda k: list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length(x))), 0)))::BIGINT AS start FROM d WHERE len(h) > 0)
SELECT doc_id, start, token FROM e""")
def token_hits(t: Tables):
    """One row for each suspicious token, with its place."""
    return t.documents.select("doc_id", F.explode(text.matches(F.col("text"), "[0-9]{4,}")).alias("m")).select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.token").alias("token"))


@query()
def text_differences(t: Tables):
    """Similarity and smallest changed span between each document and itself with its numbers masked."""
    masked = F.regexp_replace("text", "[0-9]+", "#")
    rows = t.benchmark.select("item_id", F.col("text").alias("a"), masked.alias("b")).withColumn("span", diffs.changed_span("a", "b"))
    return rows.select("item_id", F.round(diffs.similarity("a", "b"), 9).alias("similarity"), "span.start", "span.end_before", "span.end_after")


@query()
def edit_opcodes(t: Tables):
    """The edit script from each passage to itself with characters beyond ASCII masked."""
    t.benchmark.select("item_id", "text").createOrReplaceTempView("__passages")
    t.spark.udtf.register("opcodes_between", diffs.Opcodes)
    return t.spark.sql("SELECT item_id, o.* FROM __passages, LATERAL opcodes_between(text, regexp_replace(text, '[^ -~]+', '#')) o")


@query()
def question_keys(t: Tables):
    """Reserved questions by their folded key, with the number that share it."""
    return t.benchmark.groupBy(F.sha2(text.question_key("text"), 256).alias("key")).agg(F.count("*").alias("n"))


@query()
def quote_repair(t: Tables):
    """Quotes of two cut lines put right from their source, and the ratio of supported ones before and after."""
    words = F.split("text", " ")
    quote = F.concat(F.array_join(F.slice(words, 2, 4), " "), F.lit("\n"), F.array_join(F.slice(words, 9, 4), " "))
    rows = t.conversations.where("text is not null").select("conv_id", "turn", "text", quote.alias("quote")).withColumn("repaired", diffs.repaired_quote("quote", "text"))
    state = F.when(F.col("repaired").isNull(), "UNREPAIRABLE").when(F.col("repaired") == F.col("quote"), "UNCHANGED").otherwise("REPAIRED")
    return rows.select("conv_id", "turn", state.alias("state"), "repaired")


@query("""SELECT l_orderkey AS k, bool_or(ok) AS covered FROM (SELECT l_orderkey, l_linenumber % 2 AS combo, bool_and(l_partkey % 3 <> 0) AS ok FROM lineitem GROUP BY ALL) GROUP BY 1""")
def covered_in_row(t: Tables):
    combos = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber") % 2).agg(F.collect_set("l_partkey").alias("c"))
    rows = combos.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("c").alias("cs"))
    have = F.filter(F.flatten("cs"), lambda x: x % 3 != 0)
    return rows.select("k", evidence.covered(F.col("cs"), have).alias("covered"))


@query("""SELECT l_returnflag, round(fsum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag""")
def exact_totals(t: Tables):
    return exact.exact_sum(t.lineitem, ["l_returnflag"], "l_extendedprice").withColumn("total", F.round("total", 2))


@query("""SELECT l_returnflag, l_linestatus, sum((l_extendedprice * 1152921504606846976.0)::HUGEINT)::DECIMAL(38, 0) AS units FROM lineitem GROUP BY ALL""")
def exact_total_bits(t: Tables):
    """Sums in units of 2^-60, to the last bit."""
    return exact.exact_units(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice")
