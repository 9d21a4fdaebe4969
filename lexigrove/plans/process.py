"""Dialogue, answers, metrics over tables, manifests and data-set checks, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.functions import citations as Q
from lexigrove.functions import dialogue as L
from lexigrove.functions import text as X
from lexigrove.operators import dialogue as D
from lexigrove.operators import evaluation as E
from lexigrove.operators import manifest as M
from lexigrove.plans import search
from lexigrove.plans.content import _TOK, _re, _strip
from lexigrove.sources.shared import shared_dir
from lexigrove.sources.tables import table
from lexigrove.streaming.manifest_log import ManifestLog


def turns(spark, d):
    return table(spark, d, "conversations")


def latency_percentiles(spark, d):
    return E.latency(table(spark, d, "events"), "value", "event_type")


def confusion_metrics(spark, d):
    return E.confusion(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


def confusion_by_language(spark, d):
    labelled = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return E.confusion(labelled, F.col("quality") == 1, F.col("toxic") == 0, "lang")


def language_detect(spark, d):
    return D.routed(turns(spark, d)).select("conv_id", "turn", "language", "confidence")


def document_language(spark, d):
    """What the detector says of whole documents, against their language."""
    found = table(spark, d, "documents").select("lang", L.language(F.col("text"))["language"].alias("detected"))
    return found.groupBy("lang", "detected").agg(F.count("*").alias("documents"))


def follow_up(spark, d):
    return D.routed(turns(spark, d)).select("conv_id", "turn", "has_history", "follow_up")


def intent_route(spark, d):
    return D.routed(turns(spark, d)).select("conv_id", "turn", "intent", L.greeting_reply(F.col("language")).alias("greeting"))


def conversation_window(spark, d):
    return D.recent(turns(spark, d), 3).select("conv_id", "turn", "back", "role")


def conversation_context(spark, d):
    return D.context(turns(spark, d)).select("conv_id", "turn", F.md5("context").alias("digest"))


def rewrite_fallback(spark, d):
    return D.rewritten(turns(spark, d)).select("conv_id", "turn", F.md5("query").alias("digest"))


def _answers(spark, d):
    """Answers with right, relabelled, miswritten and wrong citations, by the length of the passage."""
    name = F.concat(F.lit("d__md__chunk_"), F.col("item_id").cast("string"))
    text = F.concat(F.lit("See [source: a:"), F.col("item_id").cast("string"), F.lit("] and [b:"), name, F.lit("] not [this]"), F.when(F.length("text") % 3 == 0, " nor [c:9]").otherwise(""))
    allowed = F.array(F.concat(F.lit("[a:"), F.col("item_id").cast("string"), F.lit("]")), F.concat(F.lit("[b:"), F.replace(name, F.lit("__md__"), F.lit(".md__")), F.lit("]")))
    return table(spark, d, "benchmark").select("item_id", F.when(F.length("text") % 5 == 0, "no citation").otherwise(text).alias("answer"), allowed.alias("allowed"))


def citation_extract(spark, d):
    return _answers(spark, d).select("item_id", F.array_join(Q.extract(F.col("answer")), "|").alias("citations"))


def citation_validate(spark, d):
    checked = _answers(spark, d).select("item_id", Q.verdict(F.col("answer"), F.col("allowed")).alias("v"))
    return checked.select("item_id", "v.valid", F.array_join("v.valid_citations", "|").alias("right"), F.array_join("v.invalid_citations", "|").alias("wrong"), "v.outcome")


def _contexts(spark, d):
    ranked = search.rerank_topk(spark, d)
    return ranked.join(search.corpus(spark, d), "chunk_id").select("query_id", F.dense_rank().over(Window.partitionBy("query_id").orderBy("rank")).cast("long").alias("rank"), "source", "chunk_id", "content")


def prompt_context(spark, d):
    return D.prompts(_contexts(spark, d)).select("query_id", F.md5("context").alias("digest"))


def mock_answer(spark, d):
    return D.excerpts(_contexts(spark, d)).select("query_id", F.md5("answer").alias("digest"))


def rag_answer(spark, d):
    out = D.answers(search.confidence_gate(spark, d), _contexts(spark, d))
    return out.select("query_id", "status", F.md5("answer").alias("digest"))


def _snapshots(spark, d):
    """Vectors as what was known and documents as what comes in, under shared ids."""
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.sha2(F.col("label").cast("string"), 256).alias("checksum"))
    new = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.sha2((F.col("n_chars") % 10).cast("string"), 256).alias("checksum"))
    return old, new


def dataset_rules(spark, d):
    """The rules of a question set, on passages as questions: every second one is answerable, some lack what they need."""
    words = F.array_join(F.slice(X.tokens(F.col("text")), 1, 3), " ")
    even = F.col("item_id") % 2 == 0
    items = table(spark, d, "benchmark").select(
        (F.col("item_id") - F.col("item_id") % 7).alias("id"), words.alias("question"), even.alias("answerable"), F.when(even & (F.col("item_id") % 5 > 0), "a.md").alias("expected_source"), F.when(F.col("item_id") % 3 > 0, F.col("text")).otherwise(" ").alias("evidence")
    )
    return M.dataset_rules(items)


def manifest_merge(spark, d):
    return M.merge(*_snapshots(spark, d))


def manifest_history(spark, d):
    """The manifest after two scans of documents, a full scan that lacks some, failures and deletions, compacted on the way."""
    log = ManifestLog(spark, f"{shared_dir(spark)}/lexigrove/manifest-{uuid.uuid4().hex}", compact_after=3)
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), X.text_of("text").alias("text"))
    log.evaluate(docs.where("doc_id % 4 <> 0").select("document_id", F.md5("text").alias("checksum")))
    log.evaluate(docs.select("document_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("checksum")))
    log.mark_missing(docs.where("doc_id % 7 <> 0"))
    log.mark_failed(docs.where("doc_id % 11 = 0").select("document_id", F.concat(F.lit("broken "), "document_id").alias("error_message")))
    log.delete(docs.where("doc_id % 13 = 0"))
    return log.read()


def manifest_counts(spark, d):
    return manifest_merge(spark, d).groupBy("status").agg(F.count("*").alias("documents"))


def resume_anti_join(spark, d):
    return M.remaining(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def semi_join_check(spark, d):
    return M.present(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def source_availability(spark, d):
    """Whether each label's document is there, and of what source."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return table(spark, d, "labels").select("doc_id").join(docs, "doc_id", "left").select("doc_id", F.col("source").isNotNull().alias("available"))


def union_questions(spark, d):
    """Passages and opening turns as one set of questions."""
    items = table(spark, d, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("id"), F.lit(True).alias("answerable"))
    firsts = turns(spark, d).groupBy("conv_id").agg(F.min("turn").alias("turn"))
    return items.unionByName(firsts.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("id"), F.lit(False).alias("answerable")))


def dataset_integrity(spark, d):
    """One row: repeated ids and texts, and how labels are balanced."""
    items = table(spark, d, "benchmark")
    labels = table(spark, d, "labels").agg(F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("quality") == 0).alias("negative"))
    checked = items.agg(F.count("*").alias("items"), (F.count("*") - F.count_distinct("item_id")).alias("repeated_ids"), (F.count("*") - F.count_distinct(X.evaluation_form(F.col("text")))).alias("repeated_texts"))
    return checked.crossJoin(labels)  # one row each


def alias_scan(spark, d):
    """Which of the passages' opening word pairs any document names."""
    pair = F.array_join(F.slice(X.tokens(F.col("text")), 1, 2), " ")
    aliases = table(spark, d, "benchmark").select(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("technology"), pair.alias("alias"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "source", "text")
    return M.alias_scan(aliases, docs).select("technology", "matching", "present", "sources")


def absent_aliases(spark, d):
    return alias_scan(spark, d).where("not present").select("technology")


def format_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents")).orderBy("lang")


def category_counts(spark, d):
    return turns(spark, d).groupBy("role").agg(F.count("*").alias("turns"))


def grouped_counts(spark, d):
    """Documents by source and language, by source, and in all."""
    docs = table(spark, d, "documents")
    return docs.rollup("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def stratified_sample(spark, d):
    """Ten documents of each language, the first by a checksum of id and seed."""
    key = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("/42")))
    w = Window.partitionBy("lang").orderBy(key, "doc_id")
    return table(spark, d, "documents").where("n_chars >= 500").withColumn("n", F.row_number().over(w).cast("long")).where("n <= 10").select("lang", "n", "doc_id")


def event_windows(spark, d):
    """Events by hour and type: the batch form of the streaming count."""
    ev = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return ev.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "events", "total")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_M = _strip("coalesce(text, '')")
_W = "list_distinct(regexp_extract_all(lower(m), '[a-zA-ZÀ-ÿŒœÆæ]+'))"
_FR = "[" + ", ".join(map(_q, L.FRENCH_WORDS)) + "]"
_LANG = f"""CASE WHEN regexp_matches(m, '{L.ARABIC}') THEN 'ar' WHEN regexp_matches(m, '{L.FRENCH_LETTERS}') OR regexp_matches(m, {_q(L.FRENCH_SHORT)}) THEN 'fr'
    WHEN len(list_intersect({_W}, {_FR})) >= 2 OR len(list_intersect({_W}, ['bonjour', 'bonsoir', 'salut'])) > 0 THEN 'fr8' ELSE 'en' END"""
_CONV = f"""WITH c AS (SELECT *, {_M} AS m, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS has_history FROM conversations),
f AS (SELECT *, has_history AND m <> '' AND (regexp_matches(lower(m), {_q(L.DEPENDENT)}) OR regexp_matches(lower(m), {_q(L.REFERENCE)})
  OR (len(regexp_extract_all(lower(m), '[\\p{{L}}\\p{{N}}_]+')) <= 2 AND m LIKE '%?')) AS follow_up, {_LANG} AS l FROM c)"""
_CONF = search.CONFUSION
_ANS = r"""WITH b AS (SELECT item_id, length(text) AS n, item_id::VARCHAR AS i FROM benchmark),
given AS (SELECT item_id, CASE WHEN n % 5 = 0 THEN 'no citation' ELSE 'See [source: a:' || i || '] and [b:d__md__chunk_' || i || '] not [this]' || CASE WHEN n % 3 = 0 THEN ' nor [c:9]' ELSE '' END END AS answer,
  ['[a:' || i || ']', '[b:d.md__chunk_' || i || ']'] AS allowed FROM b),
raw AS (SELECT *, list_filter(list_transform(regexp_extract_all(answer, '\[([^\[\]]+)\]', 1), lambda x: trim(regexp_replace(trim(x), '(?i)^(source|citation|reference|ref)\s*:\s*', ''))), lambda x: contains(x, ':')) AS r FROM given),
a AS (SELECT *, list_transform(list_filter(r, lambda x, k: list_position(r, x) = k), lambda x: '[' || x || ']') AS c FROM raw),
canon AS (SELECT *, list_transform(c, lambda x: regexp_replace(x, '__(md|pdf|html|htm|txt)__chunk_', '.\1__chunk_', 'g')) AS k FROM a),
told AS (SELECT item_id, len(k) AS found, array_to_string(list_filter(k, lambda x: list_contains(allowed, x)), '|') AS good, array_to_string(list_filter(k, lambda x: NOT list_contains(allowed, x)), '|') AS wrong FROM canon)"""
_CTX = """ctx AS MATERIALIZED (SELECT query_id, dense_rank() OVER (PARTITION BY query_id ORDER BY rank) AS rank, source, chunk_id, text AS content FROM top5 JOIN documents ON doc_id = chunk_id)"""
_EXC = _strip("substring(content, 1, 300)") + " || ' [' || source || ':' || chunk_id || ']'"
_GATE = f"""gate AS (SELECT query_id, len({search._FAILED}) = 0 AS accepted FROM feat,
  (SELECT 0.5::DOUBLE AS minimum_top1_score, 0.05::DOUBLE AS minimum_margin, 0.1::DOUBLE AS minimum_cosine_similarity, 0.015::DOUBLE AS minimum_rrf_score, 1 AS minimum_supporting_results))"""
_TECH = lambda x: _strip(_re(_re(_re(f"lower(coalesce({x}, ''))", rf"(?:{X.SPACE}|[_\-/\\])+", "' '"), r"[^\p{L}\p{N}_ .+#]", "''"), f"{X.SPACE}+", "' '"))
_SCAN = f"""WITH a AS (SELECT 't' || item_id AS technology, {_TECH(f"array_to_string({_TOK}[1:2], ' ')")} AS form FROM benchmark),
docs AS MATERIALIZED (SELECT doc_id, source, ' ' || {_TECH("text")} || ' ' AS t FROM documents),
hits AS (SELECT technology, count(DISTINCT doc_id) AS matching, array_to_string(list_sort(list_distinct(list(source)))[1:5], ' | ') AS sources FROM a JOIN docs ON form <> '' AND contains(t, ' ' || form || ' ') GROUP BY technology),
scan AS (SELECT DISTINCT technology, coalesce(matching, 0) AS matching, matching IS NOT NULL AS present, coalesce(sources, '') AS sources FROM a LEFT JOIN hits USING (technology))"""
_SNAP = """WITH o AS (SELECT vec_id AS document_id, sha256(label::VARCHAR) AS old FROM embeddings), n AS (SELECT doc_id AS document_id, sha256((n_chars % 10)::VARCHAR) AS new FROM documents),
m AS (SELECT document_id, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'missing' WHEN old = new THEN 'unchanged' ELSE 'modified' END AS status, coalesce(new, old) AS checksum FROM n FULL JOIN o USING (document_id))"""

ORACLE = {
    "latency_percentiles": """SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95,
      min(value) AS min, max(value) AS max, round(sum(value), 2) AS total FROM events GROUP BY event_type""",
    "confusion_metrics": "SELECT * FROM (" + _CONF.format(by="", rows="(SELECT quality = 1 AS e, toxic = 0 AS p FROM labels)", group="") + ")",
    "confusion_by_language": "SELECT * FROM (" + _CONF.format(by="lang,", rows="(SELECT lang, quality = 1 AS e, toxic = 0 AS p FROM labels JOIN documents USING (doc_id))", group="GROUP BY lang") + ")",
    "language_detect": f"{_CONV} SELECT conv_id, turn, substr(l, 1, 2) AS language, CASE l WHEN 'ar' THEN 0.99 WHEN 'fr' THEN 0.9 WHEN 'fr8' THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM f",
    "document_language": f"WITH c AS (SELECT lang, {_M} AS m FROM documents) SELECT lang, substr({_LANG}, 1, 2) AS detected, count(*) AS documents FROM c GROUP BY 1, 2",
    "follow_up": f"{_CONV} SELECT conv_id, turn, has_history, follow_up FROM f",
    "intent_route": f"""{_CONV} SELECT conv_id, turn, CASE WHEN regexp_matches(lower(m), {_q(L.GREETING)}) THEN 'GREETING' WHEN follow_up THEN 'FOLLOW_UP' ELSE 'KNOWLEDGE_QUERY' END AS intent,
      CASE substr(l, 1, 2) WHEN 'fr' THEN {_q(L.GREETING_REPLY["fr"])} WHEN 'ar' THEN {_q(L.GREETING_REPLY["ar"])} ELSE {_q(L.GREETING_REPLY["en"])} END AS greeting FROM f""",
    "conversation_window": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, role FROM conversations QUALIFY back <= 3",
    "conversation_context": """SELECT conv_id, turn, md5(right(array_to_string(coalesce(list(role || ': ' || coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []), chr(10)), 4000)) AS digest FROM conversations""",
    "rewrite_fallback": f"""{_CONV}, g AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM f)
      SELECT conv_id, turn, md5(CASE WHEN follow_up AND u IS NOT NULL THEN 'Regarding ''' || u || ''': ' || coalesce(text, '') ELSE coalesce(text, '') END) AS digest FROM g""",
    "citation_extract": f"{_ANS} SELECT item_id, array_to_string(c, '|') AS citations FROM a",
    "citation_validate": f"""{_ANS} SELECT item_id, found > 0 AND wrong = '' AS valid, good AS right, wrong,
      CASE WHEN found = 0 THEN 'no_citation' WHEN wrong <> '' THEN 'unauthorized_citation' ELSE 'valid' END AS outcome FROM told""",
    "prompt_context": search._sql("SELECT query_id, md5(string_agg('Source [' || source || ':' || chunk_id || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS digest FROM ctx WHERE rank <= 2 GROUP BY query_id", _CTX),
    "mock_answer": search._sql(f"SELECT query_id, md5({_EXC}) AS digest FROM ctx WHERE rank = 1", _CTX),
    "rag_answer": search._sql(
        f"""SELECT query_id, CASE WHEN NOT accepted THEN 'rejected' WHEN content IS NULL THEN 'invalid_citations' ELSE 'accepted' END AS status, CASE WHEN accepted THEN md5({_EXC}) END AS digest
        FROM gate LEFT JOIN (SELECT * FROM ctx WHERE rank = 1) USING (query_id)""",
        f"{_CTX}, {_GATE}",
    ),
    "manifest_merge": f"{_SNAP} SELECT * FROM m",
    "dataset_rules": f"""WITH i AS (SELECT item_id, item_id - item_id % 7 AS id, lower(array_to_string({_TOK}[1:3], ' ')) AS q, item_id % 2 = 0 AS a, item_id % 2 = 0 AND item_id % 5 > 0 AS s, item_id % 3 > 0 AND trim(text) <> '' AS e FROM benchmark),
      r AS (SELECT count(*) - count(DISTINCT id) AS unique_ids, count(*) - count(DISTINCT q) AS unique_questions, count(*) FILTER (q = '') AS filled_questions, abs(count(*) FILTER (a) - 30) AS answerable_count, abs(count(*) FILTER (NOT a) - 30) AS unanswerable_count,
        count(*) FILTER (a AND NOT (s AND e)) AS answerable_has_evidence, count(*) FILTER (NOT a AND (s OR e)) AS unanswerable_has_none FROM i)
      UNPIVOT r ON COLUMNS(*) INTO NAME rule VALUE failures""",
    "manifest_history": """SELECT doc_id::VARCHAR AS document_id,
      CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'modified' ELSE 'unchanged' END AS status,
      md5(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END) AS checksum, CASE WHEN doc_id % 11 = 0 THEN 'broken ' || doc_id END AS error_message
      FROM documents WHERE doc_id % 13 <> 0""",
    "manifest_counts": f"{_SNAP} SELECT status, count(*) AS documents FROM m GROUP BY status",
    "resume_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "semi_join_check": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "source_availability": "SELECT l.doc_id, d.source IS NOT NULL AS available FROM labels l LEFT JOIN documents d USING (doc_id)",
    "union_questions": "SELECT 'item-' || item_id AS id, true AS answerable FROM benchmark UNION ALL SELECT DISTINCT 'conv-' || conv_id, false FROM conversations",
    "dataset_integrity": """SELECT * FROM (SELECT count(*) AS items, count(*) - count(DISTINCT item_id) AS repeated_ids, count(*) - count(DISTINCT lower(trim(text))) AS repeated_texts FROM benchmark),
      (SELECT count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative FROM labels)""",
    "alias_scan": f"{_SCAN} SELECT * FROM scan",
    "absent_aliases": f"{_SCAN} SELECT technology FROM scan WHERE NOT present",
    "format_counts": "SELECT lang, count(*) AS documents FROM documents GROUP BY lang",
    "category_counts": "SELECT role, count(*) AS turns FROM conversations GROUP BY role",
    "grouped_counts": "SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)",
    "stratified_sample": "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '/42'), doc_id) AS n, doc_id FROM documents WHERE n_chars >= 500 QUALIFY n <= 10",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
QUERIES = {k: v for k, v in globals().items() if k in ORACLE}
