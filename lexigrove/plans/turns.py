"""Conversations answered turn by turn, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrove.functions import dialogue as L
from lexigrove.operators import conversation as V
from lexigrove.operators import dialogue as D
from lexigrove.operators import evaluation as E
from lexigrove.operators import retrieval as R
from lexigrove.operators.prompts import REFUSALS
from lexigrove.plans import search
from lexigrove.plans.content import _strip
from lexigrove.plans.process import _LANG, _q
from lexigrove.sources.shared import kept
from lexigrove.sources.tables import table


def conversation_turns(spark, d):
    """Each message of a user, routed, rewritten, looked up by BM25, gated by the share of its terms that the best document
    has, and answered by rule: every fifth turn by nothing, every seventh conversation not at all, some without citation."""
    planned = kept(V.plan(V.with_history(table(spark, d, "conversations"))), "turns")
    asked = planned.where("question is not null").select("query_id", "question")
    docs = search.corpus(spark, d)
    found = R.bm25(search.index(spark, d), asked, 5)
    best = kept(R.rerank(found.withColumns({c: F.lit(None).cast("double") for c in ("cosine_similarity", "rrf_score")}), asked, docs, 2), "turns-best")
    gated = E.gate(E.confidence_features(best), top1=0.9, margin=0.0, cosine=None, rrf=None, supporting=1)
    told = best.join(docs.select("chunk_id", "source", F.length("content").alias("length")), "chunk_id")
    citation = D.citation_id(F.col("source"), F.col("chunk_id").cast("string"))
    allowed = told.groupBy("query_id").agg(F.collect_set(citation).alias("allowed"))
    turn = F.split("query_id", ":")[1].cast("long")
    given = F.when(turn % 5 == 2, None).when(F.col("length") % 3 == 0, F.lit("no citation")).otherwise(F.concat(F.lit("So says "), citation))
    generated = told.where("rank = 1").select("query_id", given.alias("answer"))
    out = V.respond(planned, gated, allowed, generated, F.col("conv_id") % 7 != 0)
    return out.select("conv_id", "turn", "language", "reply_language", "intent", "rewritten", "status", "outcome", F.md5(F.coalesce("answer", F.lit(""))).alias("digest"))


_REPLY = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in L.GREETING_REPLY.items())
_REFUSED = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in REFUSALS.items())
_PLAN = f"""h AS (
  SELECT *, {_strip("coalesce(text, '')")} AS m, count(*) OVER w > 0 AS has_history, last_value(CASE WHEN role = 'user' THEN coalesce(text, '') END IGNORE NULLS) OVER w AS last_user
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
fu AS (
  SELECT *, has_history AND m <> '' AND (regexp_matches(lower(m), {_q(L.DEPENDENT)}) OR regexp_matches(lower(m), {_q(L.REFERENCE)})
    OR (len(regexp_extract_all(lower(m), '[\\p{{L}}\\p{{N}}_]+')) <= 2 AND m LIKE '%?')) AS follow_up, left({_LANG}, 2) AS language, regexp_matches(lower(m), {_q(L.GREETING)}) AS hail
  FROM h WHERE role = 'user'),
plan AS MATERIALIZED (
  SELECT conv_id, turn, conv_id || ':' || turn AS query_id, language, CASE WHEN hail THEN 'GREETING' WHEN follow_up THEN 'FOLLOW_UP' ELSE 'KNOWLEDGE_QUERY' END AS intent,
    CASE WHEN hail THEN NULL WHEN follow_up AND coalesce(last_user, '') <> '' THEN 'Regarding ''' || last_user || ''': ' || m ELSE m END AS question, follow_up OR language <> 'en' AS needs FROM fu),
q AS MATERIALIZED (SELECT query_id, question, question AS evidence FROM plan WHERE question IS NOT NULL),
"""
_ENDS = f"""
five AS (
  SELECT b.query_id, b.rank AS before, chunk_id, source, text, round(coalesce(len(list_intersect(ask, {search._TERMS.format("coalesce(d.text, '')")}))::DOUBLE / len(ask), 0), 6) AS s
  FROM bm b JOIN asks USING (query_id) LEFT JOIN documents d ON doc_id = chunk_id WHERE b.rank <= 5),
two AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, before, chunk_id) AS rank FROM five QUALIFY rank <= 2),
gate AS (
  SELECT query_id, coalesce(max(s) FILTER (rank = 1) >= 0.9 AND round(max(s) FILTER (rank = 1) - coalesce(max(s) FILTER (rank = 2), 0), 6) >= 0 AND count(*) FILTER (s >= 0.5) >= 1, false) AS accepted
  FROM two GROUP BY query_id),
said AS (
  SELECT query_id, CASE WHEN string_split(query_id, ':')[2]::BIGINT % 5 = 2 THEN NULL WHEN length(text) % 3 = 0 THEN 'no citation' ELSE 'So says [' || source || ':' || chunk_id || ']' END AS given
  FROM two WHERE rank = 1),
ended AS (
  SELECT plan.*, given, CASE WHEN intent = 'GREETING' THEN 'greeting' WHEN NOT coalesce(accepted, false) THEN 'rejected' WHEN conv_id % 7 = 0 THEN 'generation_disabled'
    WHEN given IS NULL THEN 'generation_failed' WHEN given = 'no citation' THEN 'invalid_citations' ELSE 'accepted' END AS status
  FROM plan LEFT JOIN gate USING (query_id) LEFT JOIN said USING (query_id))"""
ORACLE = {
    "conversation_turns": f"""WITH {_PLAN}{search._BASE[search._BASE.index("post AS MATERIALIZED") :]}, {_ENDS}
SELECT conv_id, turn, language, language AS reply_language, intent, CASE WHEN needs AND intent <> 'GREETING' THEN question END AS rewritten, status,
  CASE status WHEN 'accepted' THEN 'valid' WHEN 'invalid_citations' THEN 'no_citation' END AS outcome,
  md5(CASE WHEN status = 'accepted' THEN given WHEN status = 'generation_disabled' THEN {_q(V.DISABLED)} WHEN status = 'greeting' THEN CASE language {_REPLY} END ELSE CASE language {_REFUSED} END END) AS digest
FROM ended""",
}
QUERIES = {k: v for k, v in globals().items() if k in ORACLE}
