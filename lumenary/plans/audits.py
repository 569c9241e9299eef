"""Audits, validated scans, revisions of gold data, search records and build queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import norm as length_of
from ..functions.vectors import normalise
from ..operators import audits, build, evidence, intervals, ledger, topk, windows
from ..operators.schedule import chunk_id, numbered
from ..sources import index as index_files
from ..sources import io
from .registry import Tables, query
from .retrieval import _RECALL, _TOP, _evidence, _recalls, _rows


@query("""SELECT * FROM (WITH d AS (SELECT doc_id, text, n_chars, source, count(*) OVER (PARTITION BY doc_id) AS times FROM documents), m AS (SELECT source, bool_or(doc_id % 97 = 0) AS changed FROM documents GROUP BY source)
SELECT 'UNIQUE_ID' AS code, count(*) FILTER (times > 1) AS n FROM d UNION ALL SELECT 'DENSE_ID', (max(doc_id) - min(doc_id) + 1 - count(DISTINCT doc_id))::BIGINT FROM d
UNION ALL SELECT 'TEXT_LENGTH', count(*) FILTER (NOT coalesce(length(text) = n_chars, false)) FROM d UNION ALL SELECT 'BLANK_TEXT', count(*) FILTER (trim(coalesce(text, '')) = '') FROM d
UNION ALL SELECT 'MANIFEST', count(*) FILTER (changed) FROM m)""")
def validated_corpus(t: Tables):
    """The checks a corpus has to pass before it is used: ids, texts, and each source's rows and digest against the manifest of a
    frozen copy, from which some texts differ now."""
    docs = t.documents
    path = io.scratch(t.spark, "manifest")
    io.write_new(io.manifest(docs, "source", ["doc_id", "text"]), path)
    now = docs.withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    rows = audits.violations(docs, {"TEXT_LENGTH": F.length("text") == F.col("n_chars"), "BLANK_TEXT": F.trim(F.coalesce("text", F.lit(""))) != ""})
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("c"))
    ids = ids.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("UNIQUE_ID"), (F.max("doc_id") - F.min("doc_id") + 1 - F.count("*")).alias("DENSE_ID"))
    sources = io.against_manifest(now, t.spark.read.parquet(path), "source", ["doc_id", "text"])
    return rows.unionByName(ids.unpivot([], ["UNIQUE_ID", "DENSE_ID"], "code", "n")).unionByName(audits.violations(sources, {"MANIFEST": F.col("state") == "SAME"}))


@query("SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def required_lookup(t: Tables):
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return audits.required_join(t.lineitem.select("l_orderkey"), orders, "l_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(DISTINCT turn) = count(*) AS once, bool_or(role = 'system' AND turn > 0) AS late, bool_or(text IS NULL OR trim(text) = '') AS blank FROM conversations GROUP BY conv_id)
SELECT 'BOTH_SIDES' AS code, count(*) FILTER (NOT (u > 0 AND a > 0)) AS n FROM q UNION ALL SELECT 'ONE_ROW_A_TURN', count(*) FILTER (NOT once) FROM q UNION ALL SELECT 'LEAKED_CONTEXT', count(*) FILTER (late) FROM q UNION ALL SELECT 'BLANK', count(*) FILTER (blank) FROM q""")
def packet_audit(t: Tables):
    role = F.col("role")
    q = t.conversations.groupBy("conv_id").agg(
        F.count_if(role == "user").alias("u"), F.count_if(role == "assistant").alias("a"), (F.countDistinct("turn") == F.count("*")).alias("once"),
        F.bool_or((role == "system") & (F.col("turn") > 0)).alias("late"), F.bool_or(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"),
    )
    c = F.col
    return audits.violations(q, {"BOTH_SIDES": (c("u") > 0) & (c("a") > 0), "ONE_ROW_A_TURN": c("once"), "LEAKED_CONTEXT": ~c("late"), "BLANK": ~c("blank")})


@query("""WITH i AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS ranks, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(DISTINCT l_partkey) AS parts, count(*) FILTER (p_partkey IS NULL OR l_quantity * p_retailprice < l_extendedprice / 2) AS changed
 FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 17 <> 0 GROUP BY 1), a AS (SELECT o_orderkey AS k, o_orderstatus AS s, i.* EXCLUDE k FROM orders LEFT JOIN i ON i.k = o_orderkey)
SELECT 'NO_ATTEMPT' AS code, count(*) FILTER (n IS NULL) AS n FROM a UNION ALL SELECT 'RANKS', count(*) FILTER (NOT coalesce(lo = 1 AND hi = n AND ranks = n, false)) FROM a UNION ALL SELECT 'DISTINCT_ITEMS', count(*) FILTER (NOT coalesce(parts = n, false)) FROM a
UNION ALL SELECT 'PROVENANCE', count(*) FILTER (NOT coalesce(changed = 0, false)) FROM a UNION ALL SELECT 'LEAK', count(*) FILTER (s = 'P' AND n > 6) FROM a""")
def attempt_audit(t: Tables):
    """Schedule, attempts and chunks: attempts are there, ranks are 1 to n, items distinct and as in their source, none where none belong."""
    parts = t.part.where("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    items = t.lineitem.join(parts, "l_partkey", "left").withColumn("changed", F.expr("p_retailprice is null or l_quantity * p_retailprice < l_extendedprice / 2"))
    per = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("ranks"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.countDistinct("l_partkey").alias("parts"), F.count_if("changed").alias("changed"))
    a = t.orders.select("o_orderkey", "o_orderstatus").join(per, "o_orderkey", "left")
    rules = {"NO_ATTEMPT": "n is not null", "RANKS": "lo = 1 and hi = n and ranks = n", "DISTINCT_ITEMS": "parts = n", "PROVENANCE": "changed = 0", "LEAK": "not coalesce(o_orderstatus = 'P' and n > 6, false)"}
    return audits.violations(a, {c: F.expr(x) for c, x in rules.items()})


@query("""WITH d AS (SELECT n_nationkey AS k, 3 + n_nationkey % 5 AS declared FROM nation), f AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT CASE WHEN coalesce(f.n, 0) = declared THEN 'SAME' WHEN coalesce(f.n, 0) < declared THEN 'FEWER' ELSE 'MORE' END AS verdict, count(*) AS n_tables FROM d LEFT JOIN f USING (k) GROUP BY 1""")
def table_row_counts(t: Tables):
    declared = t.nation.select(F.col("n_nationkey").alias("k"), (F.lit(3) + F.col("n_nationkey") % 5).alias("declared"))
    n = F.coalesce("n", F.lit(0))
    rows = declared.join(t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")), "k", "left")
    return rows.groupBy(F.when(n == F.col("declared"), "SAME").when(n < F.col("declared"), "FEWER").otherwise("MORE").alias("verdict")).agg(F.count("*").alias("n_tables"))


@query("""WITH c AS (SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS ids, count(DISTINCT sha256(text)) AS texts FROM documents GROUP BY lang)
SELECT lang, n, abs(n / sum(n) OVER () - CASE lang WHEN 'en' THEN 0.62 WHEN 'fr' THEN 0.14 WHEN 'de' THEN 0.14 ELSE 0.2 END) <= 0.03 AS as_declared, ids = n AS unique_ids, texts = n AS unique_texts FROM c""")
def composition_check(t: Tables):
    c = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.countDistinct(F.sha2("text", 256)).alias("texts"))
    want = F.when(F.col("lang") == "en", 0.62).when(F.col("lang").isin("fr", "de"), 0.14).otherwise(0.2)
    total = F.lit(t.documents.count())
    return c.select("lang", "n", (F.abs(F.col("n") / total - want) <= 0.03).alias("as_declared"), (F.col("ids") == F.col("n")).alias("unique_ids"), (F.col("texts") == F.col("n")).alias("unique_texts"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, NOT (o_orderkey % 5 = 0 AND o_orderkey % 35 = 0) AS unchanged, o_custkey FROM orders""")
def rubric_override(t: Tables):
    base = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    changes = base.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 35 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), F.lit("X").alias("o_orderstatus"))
    return audits.override(base, changes, "o_orderkey", ["o_orderstatus"], ["o_custkey"]).select("o_orderkey", "o_orderstatus", "unchanged", "o_custkey")


_NEW = """e2 AS (SELECT l_orderkey AS question, l_suppkey % 3 AS grp, l_linenumber % 2 AS combo, l_partkey AS chunk FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, l_suppkey % 3, 9, 1 FROM lineitem WHERE l_orderkey % 4 = 0),
c2 AS (SELECT question, grp, combo, bool_and(chunk IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0)) AS whole FROM e2 GROUP BY ALL), g2 AS (SELECT question, grp, bool_or(whole) AS hit FROM c2 GROUP BY ALL),
n2 AS (SELECT question, avg(hit::INT) AS recall FROM g2 GROUP BY question)"""


@query(_RECALL + ", " + _NEW + " SELECT count(*) AS n, round(avg(q.recall), 6) AS before, round(avg(n2.recall), 6) AS after, count(*) FILTER (n2.recall > q.recall + 1e-9) AS higher, count(*) FILTER (n2.recall < q.recall - 1e-9) AS lower FROM q JOIN n2 USING (question)")
def gold_revision(t: Tables):
    """Alternatives added for some questions, and recall before and after."""
    more = _evidence(t).where("question % 4 = 0").select("question", "grp", F.lit(9).alias("combo"), F.lit(1).alias("chunk")).distinct()
    have = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("chunk"))
    after = evidence.coverage(_evidence(t).unionByName(more), have).select("question", F.col("recall").alias("new"))
    both = _recalls(t).select("question", "recall").join(after, "question")
    return both.agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("before"), F.round(F.avg("new"), 6).alias("after"), F.count_if(F.expr("new > recall + 1e-9")).alias("higher"), F.count_if(F.expr("new < recall - 1e-9")).alias("lower"))


@query("SELECT 'A' || lpad(row_number() OVER (ORDER BY sha256('42|' || n_nationkey), n_nationkey)::VARCHAR, 3, '0') AS blind_id, n_nationkey FROM nation")
def blinded_sample(t: Tables):
    return audits.blinded(t.nation.select("n_nationkey"), "n_nationkey")


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('draw|42|' || o_orderkey), o_orderkey) AS r FROM orders),
d AS (SELECT * FROM h WHERE o_orderpriority = '1-URGENT' AND r <= 4 OR o_orderpriority = '2-HIGH' AND r <= 6 OR o_orderpriority = '5-LOW')
SELECT printf('A%03d', row_number() OVER (ORDER BY sha256('blind|42|' || o_orderkey), o_orderkey)) AS blind_id, o_orderkey, o_orderpriority, o_totalprice FROM d""")
def blinded_strata(t: Tables):
    """Four of one kind, six of another and all of a third under blind ids, the sheet joined with its keys again."""
    sheet, keys = audits.blinded_strata(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", "o_orderpriority", {"1-URGENT": 4, "2-HIGH": 6, "5-LOW": None})
    return sheet.join(keys, "blind_id")


@query("SELECT role, count(*) AS n, round(avg(length(text)), 4) AS mean, round(median(length(text)), 4) AS median, count(*) FILTER (contains(text, '?')) AS asking FROM conversations GROUP BY role")
def usage_descriptives(t: Tables):
    size = F.length("text")
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(size), 4).alias("mean"), F.round(F.median(size), 4).alias("median"), F.count_if(F.col("text").contains("?")).alias("asking"))


@query("""SELECT count(*) AS pages, count(*) FILTER (trim(html) = '') AS blank, count(*) FILTER (contains(url, 'https')) AS secure, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) FILTER (length(html) < 1200) AS short_pages FROM pages""")
def run_counters(t: Tables):
    short = F.array_sort(F.collect_list(F.when(F.length("html") < 1200, F.col("page_id"))))
    return t.pages.agg(F.count("*").alias("pages"), F.count_if(F.trim("html") == "").alias("blank"), F.count_if(F.col("url").contains("https")).alias("secure"), F.when(F.size(short) > 0, F.array_join(short, ",")).alias("short_pages"))


@query("SELECT doc_id, n_chars // 4 AS tokens, (row_number() OVER (ORDER BY n_chars // 4 DESC, doc_id) - 1) // 100 AS batch FROM documents")
def length_batches(t: Tables):
    """Batches of a hundred in order of falling length, over all documents."""
    rows = t.documents.select("doc_id", F.expr("n_chars div 4").alias("tokens"))
    return numbered(rows, [F.desc("tokens"), "doc_id"], "at").select("doc_id", "tokens", F.expr("at div 100").alias("batch"))


#: Eight counts of letters over their norm, the first one raised by one so that none is zero: a stand-in for a model that both engines can compute.
_LETTERS = "etaoinsr"
_COUNTS = "[" + ", ".join(f"(length(text) - length(replace(text, '{c}', '')) + {int(i == 0)})::DOUBLE" for i, c in enumerate(_LETTERS)) + "]"
_INDEX = f"""WITH d AS (SELECT doc_id, text, n_chars, {_COUNTS} AS c, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)) """


def _letters(rows):
    """An encoder of rows by plain expressions. A letter is one byte, and bytes needn't be read to be counted."""
    text = F.col("text")
    counts = F.array(*[(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) + int(i == 0)).cast("double") for i, c in enumerate(_LETTERS)])
    return rows.select("key", "place", "batch", normalise(counts).cast("array<float>").alias("vector"))


def _built(t: Tables) -> str:
    path = index_files.scratch(t.spark, "index")
    index_files.build(t.documents, "doc_id", "text", F.col("n_chars"), _letters, path, {"model": "letters"}, size=64, waves=3)
    return path


@query(_INDEX + """SELECT doc_id, place, place // 64 AS batch, sha256(text) AS text_sha256, round(list_sum(list_transform(list_transform(c, lambda x: (x / sqrt(list_inner_product(c, c)))::FLOAT), lambda x, i: x::DOUBLE * i)), 6) AS mark FROM d""")
def index_build(t: Tables):
    """The documents' index, written in waves with receipts; mark is each vector's product with 1, 2, ..."""
    rows = index_files.load(t.spark, _built(t))
    mark = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select(F.col("key").alias("doc_id"), "place", "batch", "text_sha256", F.round(mark, 6).alias("mark"))


@query("""SELECT code, n FROM (SELECT 'MISSING_ROW' AS code, count(*) FILTER (doc_id % 13 = 0) AS n FROM documents UNION ALL SELECT 'UNKNOWN_ROW', count(*) FILTER (doc_id % 11 = 0) FROM documents
 UNION ALL SELECT 'TEXT_CHANGED', count(*) FILTER (doc_id % 7 = 0 AND doc_id % 11 <> 0) FROM documents) WHERE n > 0""")
def index_rows_verify(t: Tables):
    """Rows of an index against texts of which some are gone, some are new and some have changed."""
    now = t.documents.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")).alias("text"))
    new = t.documents.where("doc_id % 13 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return index_files.verify(now.unionByName(new), "doc_id", "text", _built(t), 64)


@query("""SELECT (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS without_record, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector, (SELECT count(*) - count(DISTINCT vec_id) FROM embeddings) AS repeated""")
def index_alignment(t: Tables):
    ids, vecs = t.documents.select(F.col("doc_id").alias("id")), t.embeddings.select(F.col("vec_id").alias("id"))
    a = ids.groupBy("id").agg(F.count("*").alias("d")).join(vecs.groupBy("id").agg(F.count("*").alias("v")), "id", "full_outer")
    return a.agg(F.count_if(F.col("d").isNull()).alias("without_record"), F.count_if(F.col("v").isNull()).alias("without_vector"), F.sum(F.greatest(F.coalesce("v", F.lit(0)) - 1, F.lit(0))).alias("repeated"))


@query("""SELECT count(*) AS n, count(*) FILTER (abs(sqrt(list_sum(list_transform(v, lambda x: x * x))) - 1) <= 1e-9) AS unit FROM (SELECT list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)""")
def encoded_vectors(t: Tables):
    rows = t.embeddings.select(normalise(F.col("embedding")).alias("v"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.abs(length_of(F.col("v")) - 1) <= 1e-9).alias("unit"))


@query(_TOP + """, f AS (SELECT query_id, id, rank, score FROM r WHERE rank <= 20), g AS (SELECT query_id, unnest(l) AS id, generate_subscripts(l, 1) AS rank FROM (SELECT query_id, array_agg(id ORDER BY score DESC, id)[1:5] AS l FROM s GROUP BY query_id)) SELECT count(DISTINCT query_id) AS queries, count(*) FILTER (rank <= 5) AS prefix_rows, (SELECT count(*) FROM f JOIN g USING (query_id, rank) WHERE f.id <> g.id) AS prefix_differs, (SELECT count(*) FROM (SELECT score < lead(score) OVER w OR score = lead(score) OVER w AND id > lead(id) OVER w AS wrong FROM f WINDOW w AS (PARTITION BY query_id ORDER BY rank)) WHERE wrong) AS out_of_order FROM f""")
def index_verify(t: Tables):
    """The best five are the head of the best twenty, and these are in order."""
    probes = _rows(t).where("id % 20 = 0")
    full, few = topk.exact_top_k(probes, _rows(t), 20), topk.exact_top_k(probes, _rows(t), 5)
    head = few.select("query_id", "rank", F.col("id").alias("head"))
    w = W.partitionBy("query_id").orderBy("rank")
    rows = full.withColumn("was", F.lag("score").over(w)).withColumn("was_id", F.lag("id").over(w)).join(head, ["query_id", "rank"], "left")
    wrong = F.expr("was < score or (was = score and was_id > id)")
    return rows.agg(F.countDistinct("query_id").alias("queries"), F.count("head").alias("prefix_rows"), F.count_if(F.expr("rank <= 5 and not (head <=> id)")).alias("prefix_differs"), F.count_if(wrong).alias("out_of_order"))


_KEY = "array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ')"


@query(_TOP + f""", a AS (SELECT item_id, CASE WHEN length(text) NOT BETWEEN 1 AND 400 THEN 'BAD_LENGTH' WHEN sha256({_KEY}) IN (SELECT sha256({_KEY}) FROM benchmark WHERE item_id % 7 = 0) THEN 'RESERVED' ELSE 'OK' END AS status FROM benchmark)
SELECT item_id, status, (SELECT string_agg(id::VARCHAR, ',' ORDER BY rank) FROM r WHERE query_id = item_id * 20 AND rank <= 5 AND status = 'OK') AS ids FROM a""")
def search_records(t: Tables):
    """Questions through length check, guard of reserved ones, encoding (stored vectors) and exact search; a record for each."""
    key = F.sha2(text.ascii_key(F.col("text")), 256)
    reserved = t.benchmark.where("item_id % 7 = 0").select(key.alias("key")).distinct().withColumn("reserved", F.lit(True))
    asked = t.benchmark.withColumn("key", key).join(reserved, "key", "left")
    status = F.when(~F.length("text").between(1, 400), "BAD_LENGTH").when(F.col("reserved"), "RESERVED").otherwise("OK")
    asked = asked.select("item_id", status.alias("status"))
    probes = asked.where("status = 'OK'").select((F.col("item_id") * 20).alias("id")).join(_rows(t), "id")
    items = topk.exact_top_k(probes, _rows(t), 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("i"))
    ids = items.select((F.col("query_id") / 20).cast("long").alias("item_id"), F.array_join(F.transform("i", lambda x: x["id"]), ",").alias("ids"))
    return asked.join(ids, "item_id", "left").select("item_id", "status", "ids")


# Corpus build. Documents are records, their lines the source's lines, digits' masking the corrections.


def _patch_rows(t: Tables):
    rows = t.documents.where("text is not null").select("doc_id", F.explode(text.hits(F.col("text"), "[0-9]+", "#")).alias("p")).select("doc_id", "p.*")
    return rows.withColumn("id", F.concat_ws(":", "doc_id", "start"))


@query(r"""SELECT doc_id, length(text) AS raw, length(regexp_replace(text, '[0-9]+', '#', 'g')) AS corrected, len(regexp_extract_all(text, '[0-9]+')) AS n_patches FROM documents WHERE text IS NOT NULL AND text <> ''""")
def offset_runs(t: Tables):
    """Runs from corrected to raw text: both sides are covered from end to end."""
    found = build.runs(t.documents.where("text is not null").select("doc_id", F.length("text").alias("length")), _patch_rows(t), "doc_id")
    return found.groupBy("doc_id").agg(F.sum(F.col("r1") - F.col("r0")).alias("raw"), F.sum(F.col("c1") - F.col("c0")).alias("corrected"), F.count("patch").alias("n_patches"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents), p AS (SELECT doc_id, no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
SELECT doc_id || ':' || (no - 1) AS ref, s::BIGINT AS raw0, (s + length(line))::BIGINT AS raw1, len(regexp_extract_all(line, '[0-9]+')) AS n_patches, CASE WHEN regexp_matches(line, '[0-9]') THEN 'correction_region' ELSE 'line_or_cell' END AS precision FROM p WHERE line <> ''""")
def span_references(t: Tables):
    """Each line of the corrected text, resolved to the raw span it comes from."""
    docs = t.documents.where("text is not null")
    corrected = ledger.lines(docs.withColumn("text", F.regexp_replace("text", "[0-9]+", "#")), "doc_id", "text").where("line <> ''")
    refs = corrected.select(F.concat_ws(":", "doc_id", "line_no").alias("ref"), "doc_id", F.col("start").alias("s"), (F.col("start") + F.length("line")).alias("e"))
    found = build.runs(docs.select("doc_id", F.length("text").alias("length")), _patch_rows(t), "doc_id")
    return build.raw_spans(refs, found, "doc_id")


_PLACED = "CASE WHEN no % 10 = 4 THEN 'reviewed_pdf_region' WHEN no % 10 = 7 AND no % 20 <> 7 THEN 'frozen_word_coordinates' WHEN n_patches > 0 THEN 'correction_region' ELSE 'line_or_cell' END"


@query(rf"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS r, string_split(regexp_replace(text, '[0-9]+', '#', 'g'), chr(10)) AS c FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(r) AS raw, unnest(c) AS line, generate_subscripts(c, 1) - 1 AS no FROM d), k AS (SELECT *, len(regexp_extract_all(raw, '[0-9]+')) AS n_patches FROM l WHERE line <> ''), p AS (SELECT *, {_PLACED} AS precision FROM k)
SELECT doc_id || ':' || no AS ref, precision, n_patches, 1::BIGINT AS n_blocks, 1 AS n_boxes, CASE WHEN precision LIKE '%region' AND no % 10 = 4 THEN 30.0 WHEN precision LIKE 'frozen%' THEN 45.0 ELSE 40.0 END::DOUBLE AS x0, (no * 12)::DOUBLE AS y0 FROM p""")
def placed_references(t: Tables):
    """Lines of the corrected text on their page: by reviewed regions, by words, or by the raw lines that they come from."""
    c = F.col
    docs = t.documents.where("text is not null")
    found = build.runs(docs.select("doc_id", F.length("text").alias("length")), _patch_rows(t), "doc_id")
    side = lambda x: [F.lit(x).alias("x0"), (c("line_no") * 12.0).alias("y0"), F.lit(240.0).alias("x1"), (c("line_no") * 12.0 + 10).alias("y1")]
    raw = ledger.lines(docs, "doc_id", "text").where("end > start").select("doc_id", c("start").alias("r0"), (c("start") + F.length(F.regexp_replace("line", "\\n$", ""))).alias("r1"), c("line_no").alias("block"), *side(40.0))
    rows = ledger.lines(docs.withColumn("text", F.regexp_replace("text", "[0-9]+", "#")), "doc_id", "text").withColumn("line", F.regexp_replace("line", "\\n$", "")).where("line <> ''")
    refs = rows.select(F.concat_ws(":", "doc_id", "line_no").alias("ref"), "doc_id", c("start").alias("s"), (c("start") + F.length("line")).alias("e"), c("line").alias("text"))
    span = lambda df, x: df.select("doc_id", "start", (c("start") + F.length("line") - F.when(c("line_no") % 20 == 7, 1).otherwise(0)).alias("end"), *side(x))
    placed = build.resolved(refs, found, raw, span(rows.where("line_no % 10 = 4"), 30.0), span(rows.where("line_no % 10 = 7"), 45.0), "doc_id")
    return placed.select("ref", "precision", "n_patches", "n_blocks", F.size("boxes").alias("n_boxes"), "box.x0", "box.y0")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[0-9]+', '#', 'g'), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, no - 1 AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS moved FROM l""")
def reference_migration(t: Tables):
    """Line starts of the raw text, moved to where they are once the corrections are applied."""
    points = ledger.lines(t.documents, "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").alias("at"))
    return build.migrated(points, _patch_rows(t), "doc_id", "at").select("doc_id", "line_no", "moved")


_STATUS = "CASE WHEN contains({0}, '|') THEN 'TABLE' WHEN length({0}) % 2 = 0 THEN 'EVEN' ELSE 'ODD' END"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(string_split(regexp_replace(text, '[0-9]+', '#', 'g'), chr(10))) AS new, generate_subscripts(string_split(text, chr(10)), 1) AS no, len(string_split(text, chr(10))) AS n FROM documents)
SELECT {_STATUS.format('line')} || ' -> ' || {_STATUS.format('new')} AS transition, sum(length(new) + (no < n)::INT)::BIGINT AS chars FROM l WHERE {_STATUS.format('line')} <> {_STATUS.format('new')} GROUP BY 1""")
def shifted_merge(t: Tables):
    """The raw text's ledger, moved through the corrections, against the corrected text's own; a line's label follows its length."""
    status = F.when(F.col("line").contains("|"), "TABLE").when(F.length(F.regexp_replace("line", r"\n$", "")) % 2 == 0, "EVEN").otherwise("ODD").alias("label")
    docs = t.documents.where("text is not null")
    old = ledger.lines(docs, "doc_id", "text").where("end > start").select("doc_id", "start", status)
    moved = build.migrated(old.withColumn("at", F.col("start")), _patch_rows(t), "doc_id", "at").select("doc_id", F.col("moved").alias("start"), "label")
    fresh = docs.withColumn("text", F.regexp_replace("text", "[0-9]+", "#"))
    w = W.partitionBy("doc_id").orderBy("start")
    moved = moved.join(fresh.select("doc_id", F.length("text").cast("long").alias("length")), "doc_id").select("doc_id", "start", F.coalesce(F.lead("start").over(w), F.col("length")).alias("end"), "label")
    return intervals.transitions(moved, ledger.lines(fresh, "doc_id", "text").where("end > start").select("doc_id", "start", "end", status), "doc_id")


@query("""SELECT source AS unit, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id)) AS sha, count(*) AS n_parts, string_agg(DISTINCT lpad((doc_id % 7)::VARCHAR, 2, '0'), ',' ORDER BY lpad((doc_id % 7)::VARCHAR, 2, '0')) AS pages FROM documents WHERE doc_id % 3 = 0 GROUP BY source""")
def unit_build(t: Tables):
    parts = t.documents.where("doc_id % 3 = 0").select(F.col("source").alias("unit"), F.lit("p").alias("page"), F.col("doc_id").alias("y"), F.lit(0).alias("start"), F.coalesce("text", F.lit("")).alias("text"), F.lpad((F.col("doc_id") % 7).cast("string"), 2, "0").alias("printed"))
    pages = parts.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_set("printed")), ",").alias("pages"))
    return build.units(parts, "unit").drop("pages").join(pages, "unit").select("unit", F.sha2("body", 256).alias("sha"), "n_parts", "pages")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
h AS (SELECT *, last_value(CASE WHEN length(line) BETWEEN 1 AND 60 AND NOT contains(line, '|') THEN no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, coalesce(section, 0) AS section, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM h WHERE section IS NULL OR no <> section GROUP BY ALL""")
def prose_units(t: Tables):
    """Lines under the last heading above them; headings themselves are no body."""
    lines = ledger.lines(t.documents, "doc_id", "text").withColumn("no", F.col("line_no").cast("long") + 1)
    heads = lines.where(F.length("line").between(1, 60) & ~F.col("line").contains("|")).select("doc_id", "no", F.col("no").alias("section"))
    under = intervals.as_of(lines.select("doc_id", "no", "line"), heads, "doc_id", "no", "section").where("last_section is null or last_section <> no")
    return under.groupBy("doc_id", F.coalesce("last_section", F.lit(0)).alias("section")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("""SELECT p_brand AS item, sha256(string_agg('brand: ' || p_brand || chr(10) || 'name: ' || p_name || CASE WHEN p_size > 10 THEN chr(10) || 'size: ' || p_size ELSE '' END, chr(10) || chr(10) ORDER BY p_partkey)) AS sha, count(*) AS n_rows FROM part GROUP BY p_brand""")
def table_projection(t: Tables):
    """Rows of an item as labelled fields under their shared context, in order."""
    row = text.fielded({"brand": F.col("p_brand"), "name": F.col("p_name"), "size": F.when(F.col("p_size") > 10, F.col("p_size").cast("string"))})
    parts = t.part.select(F.col("p_brand").alias("item"), F.struct("p_partkey", row.alias("text")).alias("r")).groupBy("item").agg(F.array_sort(F.collect_list("r")).alias("r"), F.count("*").alias("n_rows"))
    return parts.select("item", F.sha2(F.array_join(F.transform("r", lambda x: x["text"]), "\n\n"), 256).alias("sha"), "n_rows")


@query("""WITH p AS (SELECT l_returnflag, l_linestatus = 'F' AS native, l_tax > 0.05 AS claimed, l_discount > 0.08 AS represented, CASE WHEN l_quantity > 45 THEN 'EXCLUDED_NON_TEXT' WHEN l_quantity > 40 THEN 'PREFERRED' END AS d, l_linenumber % 2 = 0 AS witness FROM lineitem)
SELECT l_returnflag, CASE WHEN claimed THEN 'CLAIMED' WHEN represented THEN 'REPRESENTED' WHEN d = 'EXCLUDED_NON_TEXT' THEN d WHEN d = 'PREFERRED' OR native THEN 'SELECTED' WHEN witness THEN 'REPRESENTED' ELSE 'SELECTED' END AS choice, count(*) AS n FROM p GROUP BY ALL""")
def span_selection(t: Tables):
    e = F.expr
    pieces = t.lineitem.select("l_returnflag", e("l_linestatus = 'F'").alias("native"), e("l_tax > 0.05").alias("claimed"), e("l_discount > 0.08").alias("represented"), e("CASE WHEN l_quantity > 45 THEN 'EXCLUDED_NON_TEXT' WHEN l_quantity > 40 THEN 'PREFERRED' END").alias("decision"), e("l_linenumber % 2 = 0").alias("witness"))
    return build.selected(pieces).groupBy("l_returnflag", "choice").agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0) // 400)) AS k FROM documents WHERE length(text) > 0)
SELECT 'C' || lpad(row_number() OVER (ORDER BY doc_id, k)::VARCHAR, 6, '0') AS chunk, doc_id, sha256('[' || doc_id || ']' || substring(text, k * 400 + 1, 500)) AS sha FROM w""")
def chunk_map(t: Tables):
    """Chunks of 500 characters every 400 with a prefix, put together from their parts: the lines' pieces, re-based."""
    docs = t.documents.where("length(text) > 0")
    n = F.length("text").cast("long")
    windows = docs.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 400))).alias("k"))
    windows = windows.select("doc_id", "k", (F.col("k") * 400).alias("w0"), F.least(F.col("k") * 400 + 500, F.col("n")).alias("w1"))
    parts = ledger.lines(docs, "doc_id", "text").select("doc_id", "start", "end", F.concat("line", F.lit("\n")).alias("text"))
    dealt = parts.where("end > start").withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("start") - 100) / 400)), F.floor((F.col("end") - 1) / 400))))
    prefix = F.concat(F.lit("["), F.col("doc_id"), F.lit("]"))
    pieces = build.sliced(windows.join(dealt, ["doc_id", "k"]), F.col("w0"), F.col("w1"), F.length(prefix))
    whole = pieces.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("out0", "piece"))).alias("p"))
    chunks = whole.select("doc_id", "k", F.sha2(F.concat(prefix, F.array_join(F.transform("p", lambda x: x["piece"]), "")), 256).alias("sha"))
    return numbered(chunks, ["doc_id", "k"], "at").select(chunk_id(F.col("at") + 1).alias("chunk"), "doc_id", "sha")


def token_units(t: Tables):
    """A unit a document: its text under a heading that every window repeats."""
    return t.documents.select("doc_id", F.concat(F.lit("Document "), "doc_id", F.lit("\n\n")).alias("prefix"), F.coalesce("text", F.lit("")).alias("body"))


@query()
def token_chunks(t: Tables, file: str = "byte_bpe_50k.json", size: int = 500, overlap: int = 100):
    """Windows of at most 500 tokens of a real tokenizer, with the heading, each sharing the shortest suffix of 100 tokens or more
    with the one before; numbered over all documents, with the number of lines that each is made of."""
    from functools import partial

    import public_tokenizers

    units = token_units(t).repartition("doc_id")  # tokenizing costs far more than the way there
    found = windows.unit_windows(units, "doc_id", partial(windows.bpe_counter, public_tokenizers.path(file)), size, overlap).where("error is null")
    chunks = numbered(io.cut_lineage(found.drop("error")), ["doc_id", "window"], "at").withColumn("chunk", F.format_string("C%06d", F.col("at") + 1))
    lines = ledger.lines(t.documents, "doc_id", "text").select("doc_id", F.col("start").alias("b0"), F.col("end").alias("b1"))
    parts = intervals.overlap_join(chunks.select("doc_id", "chunk", F.col("start").alias("a0"), F.col("end").alias("a1")), lines, ["doc_id"], 2_000)
    return chunks.join(parts.groupBy("chunk").agg(F.count("*").alias("n_parts")), "chunk").drop("at")


@query("""WITH e AS (SELECT o_orderkey AS edge, o_custkey AS head, o_orderkey % 30 AS tail FROM orders), c AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0), n AS (SELECT n_nationkey FROM nation)
SELECT CASE WHEN head NOT IN (SELECT c_custkey FROM c) AND tail NOT IN (SELECT n_nationkey FROM n) THEN 'BOTH_MISSING' WHEN head NOT IN (SELECT c_custkey FROM c) THEN 'HEAD_MISSING' WHEN tail NOT IN (SELECT n_nationkey FROM n) THEN 'TAIL_MISSING' ELSE 'OK' END AS verdict, count(*) AS n FROM e GROUP BY 1""")
def edge_endpoints(t: Tables):
    heads = t.customer.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("head"), F.lit(True).alias("h"))
    tails = t.nation.select(F.col("n_nationkey").alias("tail"), F.lit(True).alias("e"))
    rows = t.orders.select(F.col("o_custkey").alias("head"), (F.col("o_orderkey") % 30).cast("int").alias("tail")).join(heads, "head", "left").join(tails, "tail", "left")
    verdict = F.when(F.col("h").isNull() & F.col("e").isNull(), "BOTH_MISSING").when(F.col("h").isNull(), "HEAD_MISSING").when(F.col("e").isNull(), "TAIL_MISSING").otherwise("OK")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS place, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS before, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS column_before FROM part)
SELECT p_brand, count(*) AS n, count(*) FILTER (column_before = p_size AND before > p_retailprice) AS out_of_order, count(*) FILTER (column_before <> p_size) + 1 AS columns FROM r GROUP BY p_brand""")
def reading_order(t: Tables):
    """Rows by column, height and key; changes of column, and places where the order would break."""
    w = W.partitionBy("p_brand").orderBy("p_size", "p_retailprice", "p_partkey")
    rows = t.part.select("p_brand", "p_size", "p_retailprice", F.lag("p_retailprice").over(w).alias("before"), F.lag("p_size").over(w).alias("was"))
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.expr("was = p_size and before > p_retailprice")).alias("out_of_order"), (F.count_if(F.expr("was <> p_size")) + 1).alias("columns"))


_DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@query("SELECT doc_id, sha256(text) AS sha, lang, source, n_chars FROM documents")
def jsonl_round_trip(t: Tables):
    """All documents written as one object a line and read back by their declared schema."""
    path = io.scratch(t.spark, "jsonl")
    io.write_new(t.documents.selectExpr("doc_id", "text", "lang", "source", "n_chars"), path, "json")
    return io.read_jsonl(t.spark, path, _DOCUMENT).select("doc_id", F.sha2("text", 256).alias("sha"), "lang", "source", "n_chars")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_round_trip(t: Tables):
    path = io.scratch(t.spark, "csv")
    t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("header", True).csv(path)
    return io.read_csv(t.spark, path, "c_custkey long, c_name string, c_nationkey long, c_acctbal double")


@query("SELECT lang, count(*) AS n_lines, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def json_folder_counts(t: Tables):
    """A file a language, each one object with all its lines, read with its name."""
    path = io.scratch(t.spark, "folder")
    rows = t.documents.groupBy("lang").agg(F.count("*").alias("n_lines"), F.countDistinct("source").alias("n_sources"))
    rows.withColumn("name", F.col("lang")).repartition("name").write.partitionBy("name").json(path)
    return io.read_json_folder(t.spark, f"{path}/*/*.json", "lang string, n_lines long, n_sources long").drop("file_name")
