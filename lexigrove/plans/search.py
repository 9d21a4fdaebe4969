"""Search queries over documents, benchmark passages and embeddings, and the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.functions import text as X
from lexigrove.functions.vectors import cosine, norm
from lexigrove.operators import evaluation as E
from lexigrove.operators import percentiles as P
from lexigrove.operators import retrieval as R
from lexigrove.operators import semantic as T
from lexigrove.sources.shared import exists, fingerprint, kept, shared_dir, spread
from lexigrove.sources.tables import table


def corpus(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


def questions(spark, d: str) -> DataFrame:
    """A question is a passage's first twelve words."""
    words = F.slice(X.tokens(F.col("text")), 1, 12)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("question"), F.col("text").alias("evidence"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with n, a row's place from 1 by an integer key: its place in a range of keys, after the rows of the ranges before.

    The ranges' bounds are fixed on the driver, a number for each shuffle partition; any bounds give the same places.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<long>"), lambda b: b < F.col(key)))
    df = df.withColumn("part", part)
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    sizes = df.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = df.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(key))).join(sizes, "part")
    return placed.withColumn("n", F.col("n") + F.col("before")).drop("part", "before")


def query_vectors(spark, d: str) -> DataFrame:
    """The n-th passage asks with the n-th smallest vector, as far as there are vectors."""
    items = numbered(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), "query_id")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("query_vector"))
    places = numbered(vectors.select("vec_id"), "vec_id")
    return items.join(places, "n").join(vectors, "vec_id").select("query_id", "query_vector")


def chunks(spark, d: str) -> DataFrame:
    return spread(table(spark, d, "embeddings")).select(F.col("vec_id").alias("chunk_id"), "embedding")


def index(spark, d: str) -> R.Index:
    """The folder's lexical index: built where there is none of the same files, and read ever after."""
    path = f"{shared_dir(spark)}/lexigrove/index-{fingerprint(spark, f'{d}/documents.parquet')}"
    return R.Index(spark, path) if exists(spark, f"{path}/_SUCCESS") else R.build_index(corpus(spark, d), path)


def bm25_topk(spark, d):
    return R.bm25(index(spark, d), questions(spark, d))


def bm25_topk_filtered(spark, d):
    return R.bm25(index(spark, d), questions(spark, d), keep=corpus(spark, d).where("lang = 'en'"))


def term_stats(spark, d):
    return index(spark, d).terms()


def doc_stats(spark, d):
    return index(spark, d).lengths.where("doc_len > 0")


def index_counts(spark, d):
    """How many chunks each index has."""
    lexical = index(spark, d).lengths.agg(F.count("*").alias("chunks")).select(F.lit("lexical").alias("index"), "chunks")
    return lexical.unionByName(chunks(spark, d).agg(F.count("*").alias("chunks")).select(F.lit("vector").alias("index"), "chunks"))


def vector_topk(spark, d):
    return R.nearest(chunks(spark, d), query_vectors(spark, d))


def vector_topk_filtered(spark, d):
    """Neighbours among the vectors of one label."""
    labelled = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return R.nearest(labelled, query_vectors(spark, d), keep=F.col("label") == 1)


def inner_product_topk(spark, d):
    return R.nearest(chunks(spark, d), query_vectors(spark, d), measure="inner")


def _hybrid(spark, d, top=10, lexical=None):
    return R.fuse(R.nearest(chunks(spark, d), query_vectors(spark, d), 50), lexical or R.bm25(index(spark, d), questions(spark, d), 50), top)


def _hyde(spark, d, top=10):
    q = questions(spark, d)
    encoded = T.encode(spread(corpus(spark, d)).where(X.strip(X.text_of("content")) != "").select("chunk_id", "content"), "content", T.hash_encoder(), "embedding", 65)
    asked = T.embed_questions(R.hyde_texts(q, q.select("query_id", F.col("evidence").alias("hyde_document"))), T.hash_encoder(), 65, prefix="")
    return R.nearest(encoded, asked, top)


def hyde_topk(spark, d):
    """Documents near a question and its hypothetical document, here the passage itself, by the stand-in encoder."""
    return _hyde(spark, d)


def hyde_hybrid(spark, d):
    """The question itself for the lexical side, question and hypothetical document for the vectors, fused."""
    return R.fuse(_hyde(spark, d, 50), R.bm25(index(spark, d), questions(spark, d), 50)).drop("cosine_similarity", "bm25_score")


def hybrid_rrf(spark, d):
    return _hybrid(spark, d).drop("cosine_similarity", "bm25_score")


def _reranked(spark, d, lexical=None):
    return R.rerank(_hybrid(spark, d, 20, lexical), questions(spark, d), corpus(spark, d))


def rerank_topk(spark, d):
    return _reranked(spark, d).select("query_id", "rank", "hybrid_rank", "chunk_id", "reranker_score")


def evidence_rank(spark, d):
    q = questions(spark, d)
    return R.evidence_rank(bm25_topk(spark, d), q.select("query_id", "evidence"), corpus(spark, d))


def recall_mrr(spark, d):
    return E.question_metrics(evidence_rank(spark, d))


def retrieval_summary(spark, d):
    return E.means(recall_mrr(spark, d))


def _gold(spark, d):
    """A passage's expected source is that of the first document that holds it, whatever a search finds."""
    docs = corpus(spark, d)
    asked = questions(spark, d)
    homes = E.evidence_homes(asked.select(F.col("query_id").alias("id"), "evidence"), docs.select(F.col("chunk_id").alias("page_id"), "content"))
    homes = homes.join(docs.select(F.col("chunk_id").alias("page_id"), F.col("source").alias("expected_source")), "page_id")
    return asked.select("query_id", "evidence").join(homes.select(F.col("id").alias("query_id"), "expected_source"), "query_id")


def relevance(spark, d):
    """Ranks of BM25's first result of the expected source, and of the first that has the passage too."""
    return R.relevance_ranks(bm25_topk(spark, d), _gold(spark, d), corpus(spark, d))


def _methods(spark, d):
    """Five ways of searching, judged on the same gold: ranks, and a stand-in for latency, the number of results."""
    gold, docs = kept(_gold(spark, d), "gold"), corpus(spark, d)
    lexical, vectors, hyde = (kept(df, "method") for df in (R.bm25(index(spark, d), questions(spark, d), 50), R.nearest(chunks(spark, d), query_vectors(spark, d), 50), _hyde(spark, d, 50)))
    found = {"bm25": lexical.where("rank <= 10"), "vector": vectors.where("rank <= 10"), "hybrid": R.fuse(vectors, lexical), "hyde": hyde.where("rank <= 10"), "hyde_hybrid": R.fuse(hyde, lexical)}
    every = reduce(DataFrame.unionByName, [df.select(F.struct(F.lit(m).alias("method"), "query_id").alias("query_id"), "rank", "chunk_id") for m, df in found.items()])
    every = kept(every, "methods")
    asked = gold.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in found], "method string"))).withColumn("query_id", F.struct("method", "query_id")).drop("method")  # five rows for each question
    ranks = R.relevance_ranks(every, asked, docs).join(every.groupBy("query_id").agg(F.count("*").cast("double").alias("retrieval_time_ms")), "query_id", "left")
    return ranks.select("query_id.*", "source_rank", "evidence_rank", F.coalesce("retrieval_time_ms", F.lit(0.0)).alias("retrieval_time_ms"))


def retrieval_report(spark, d):
    """All methods by source and evidence, the best first by reciprocal rank."""
    return E.compare_methods(E.retrieval_summary(_methods(spark, d), "method"))


def retrieval_comparison(spark, d):
    """All methods, the best first by recall at 5."""
    out = E.compare_recalls(E.retrieval_summary(_methods(spark, d), "method"))
    return out.select("place", "method", "n_questions", *[f"evidence_recall_at_{k}" for k in (1, 3, 5, 10)], "evidence_mrr")


def retrieval_by_format(spark, d):
    q = questions(spark, d).select("query_id", F.when(F.length("evidence") < 400, "short").otherwise("long").alias("format"))
    return E.means(recall_mrr(spark, d).join(q, "query_id"), "format")


def evidence_token_recall(spark, d):
    """Share of a passage's terms that its best result has."""
    held = bm25_topk(spark, d).where("rank = 1").join(questions(spark, d), "query_id").join(corpus(spark, d).select("chunk_id", "content"), "chunk_id")
    e = F.array_distinct(X.index_terms(F.col("evidence")))
    share = X.divide(F.size(F.array_intersect(e, X.index_terms(F.col("content")))), F.size(e))
    return held.select("query_id", "chunk_id", F.round(share, 6).alias("token_recall"))


def fts_query_build(spark, d):
    return questions(spark, d).select("query_id", X.query_string(F.col("question")).alias("query"))


def confidence_features(spark, d):
    return E.confidence_features(_reranked(spark, d))


def confidence_gate(spark, d):
    return E.gate(confidence_features(spark, d), top1=0.5, margin=0.05, cosine=0.1, rrf=0.015, supporting=1)


def _labelled(spark, d):
    """Features and whether evidence is found, from one search."""
    lexical = kept(R.bm25(index(spark, d), questions(spark, d), 50), "lexical")
    found = R.evidence_rank(lexical.where("rank <= 10"), questions(spark, d).select("query_id", "evidence"), corpus(spark, d))
    ranks = found.select("query_id", F.col("rank").isNotNull().alias("expected"))
    return E.confidence_features(_reranked(spark, d, lexical)).join(ranks, "query_id")


def threshold_grid(spark, d):
    return E.search_thresholds(_labelled(spark, d))


def threshold_grid_top20(spark, d):
    return E.best_thresholds(threshold_grid(spark, d))


def threshold_generalisation(spark, d):
    """The thresholds that are best on questions of even id, judged on those of odd id."""
    labelled = _labelled(spark, d)
    return E.judge_thresholds(E.best_thresholds(E.search_thresholds(labelled.where("query_id % 2 = 0")), 1), labelled.where("query_id % 2 = 1"))


def feature_label_summary(spark, d):
    """Mean and median features of answerable and other questions."""
    labelled, names = _labelled(spark, d), ("top1_score", "margin", "mean_score")
    means = labelled.groupBy("expected").agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in names])
    return P.with_percentiles(means, P.percentiles(labelled, names, {"median": 0.5}, ("expected",)), ("expected",))


def candidate_export(spark, d):
    """All candidates of a question as one row of JSON, in order."""
    ranked = bm25_topk(spark, d)
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["rank"], x["chunk_id"])), ",").alias("candidates"))


def vector_norms(spark, d):
    n = norm(F.col("embedding"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.avg(n), 4).alias("mean_norm"))


def consecutive_similarity(spark, d):
    """Likeness of each vector to the one before it under its label."""
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return table(spark, d, "embeddings").withColumn("before", before).select("vec_id", F.round(cosine("embedding", "before"), 6).alias("similarity"))


_TERMS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_WORDS = r"regexp_extract_all(text, '[^\s\x{a0}\x{85}\x{2028}\x{3000}]+')"
_FOLD = "translate({}, '‐‑‒–—−‘’‚“”„', '------' || repeat(chr(39), 3) || repeat(chr(34), 3))"
_BASE = rf"""
q AS MATERIALIZED (SELECT item_id AS query_id, array_to_string({_WORDS}[1:12], ' ') AS question, text AS evidence FROM benchmark),
post AS MATERIALIZED (
  SELECT chunk_id, field, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (
    SELECT doc_id AS chunk_id, 0 AS field, {_TERMS.format("coalesce(text, '')")} AS t FROM documents
    UNION ALL SELECT doc_id, 1, {_TERMS.format("doc_id::VARCHAR")} FROM documents
    UNION ALL SELECT doc_id, 2, {_TERMS.format("coalesce(source, '')")} FROM documents)),
asked0 AS (
  SELECT query_id, regexp_extract_all(lower(trim(question)), '[A-Za-z0-9][A-Za-z0-9_-]*') AS t FROM q),
asked1 AS (
  SELECT query_id, CASE WHEN len(list_filter(t, lambda x: x NOT IN ({_STOP}) AND length(x) >= 2)) > 0
         THEN list_filter(t, lambda x: x NOT IN ({_STOP}) AND length(x) >= 2) ELSE t END AS t FROM asked0),
qt AS MATERIALIZED (SELECT DISTINCT query_id, unnest(t) AS phrase FROM asked1),
parts AS (SELECT phrase, regexp_extract_all(phrase, '[\p{{L}}\p{{N}}]+') AS p FROM (SELECT DISTINCT phrase FROM qt)),
pt AS (SELECT phrase, len(p) AS n_parts, unnest(p) AS term, generate_subscripts(p, 1) - 1 AS idx FROM parts),
tf AS MATERIALIZED (
  SELECT phrase, chunk_id, count(*)::DOUBLE AS tf FROM (
    SELECT phrase, n_parts, chunk_id, field, pos - idx AS at FROM post JOIN pt USING (term)
    GROUP BY ALL HAVING count(DISTINCT idx) = n_parts) GROUP BY ALL),
dl AS MATERIALIZED (SELECT chunk_id, count(*)::BIGINT AS doc_len FROM post GROUP BY chunk_id),
st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n_all, (SELECT sum(doc_len) FROM dl) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl),
nn AS (SELECT phrase, count(*)::DOUBLE AS n FROM tf GROUP BY phrase),
scored AS MATERIALIZED (
  SELECT query_id, chunk_id, round(-sum((CASE WHEN ln((n_all - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) > 0 THEN ln((n_all - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)
    * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl))), 6) AS score
  FROM qt JOIN tf USING (phrase) JOIN nn USING (phrase) JOIN dl USING (chunk_id) CROSS JOIN st GROUP BY ALL),
bm AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank, chunk_id, score FROM scored QUALIFY rank <= 50),
items AS (SELECT item_id AS query_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark),
qv AS (SELECT query_id, v.embedding::DOUBLE[] AS query_vector FROM items JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings) v USING (n)),
cosines AS (
  SELECT query_id, vec_id AS chunk_id, round(greatest(-1, least(1, list_cosine_similarity(embedding::DOUBLE[], query_vector))), 6) AS cosine_similarity FROM embeddings, qv),
vec AS MATERIALIZED (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine_similarity DESC, chunk_id) AS rank, chunk_id, cosine_similarity FROM cosines QUALIFY rank <= 50),
fused AS MATERIALIZED (
  SELECT query_id, chunk_id, v.rank AS vector_rank, b.rank AS bm25_rank, cosine_similarity, score AS bm25_score,
    round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS rrf_score
  FROM vec v FULL JOIN bm b USING (query_id, chunk_id)),
hy AS MATERIALIZED (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, least(coalesce(vector_rank, 1000000000), coalesce(bm25_rank, 1000000000)), chunk_id) AS rank, * EXCLUDE (query_id)
  FROM fused QUALIFY rank <= 20),
asks AS (SELECT query_id, list_distinct(list(phrase)) AS ask FROM qt GROUP BY query_id),
rr AS MATERIALIZED (
  SELECT h.query_id, h.rank AS hybrid_rank, h.chunk_id, cosine_similarity, rrf_score,
    round(coalesce(len(list_intersect(ask, {_TERMS.format("coalesce(d.text, '')")}))::DOUBLE / len(ask), 0), 6) AS reranker_score
  FROM hy h JOIN asks USING (query_id) LEFT JOIN documents d ON d.doc_id = h.chunk_id),
top5 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, hybrid_rank, chunk_id) AS rank FROM rr QUALIFY rank <= 5),
norm_docs AS (SELECT doc_id, trim(regexp_replace(lower({_FOLD.format("coalesce(text, '')")}), '[\s\x{{a0}}\x{{2007}}\x{{202f}}]+', ' ', 'g')) AS t FROM documents),
norm_gold AS (SELECT query_id, trim(regexp_replace(lower({_FOLD.format('evidence')}), '[\s\x{{a0}}\x{{2007}}\x{{202f}}]+', ' ', 'g')) AS g FROM q),
hit AS (SELECT query_id, min(rank) AS rank FROM bm JOIN norm_gold USING (query_id) JOIN norm_docs ON doc_id = chunk_id WHERE bm.rank <= 10 AND contains(t, g) GROUP BY query_id),
er AS MATERIALIZED (SELECT query_id, hit.rank FROM q LEFT JOIN hit USING (query_id)),
met AS MATERIALIZED (
  SELECT query_id, rank, coalesce((rank <= 1)::INT, 0) AS recall_at_1, coalesce((rank <= 3)::INT, 0) AS recall_at_3, coalesce((rank <= 5)::INT, 0) AS recall_at_5,
    coalesce((rank <= 10)::INT, 0) AS recall_at_10, coalesce(1.0::DOUBLE / rank, 0) AS reciprocal_rank FROM er),
feat AS MATERIALIZED (
  SELECT *, round(top1_score - coalesce(top2_score, 0), 6) AS margin FROM (
    SELECT query_id, count(*) AS number_of_results, max(reranker_score) FILTER (rank = 1) AS top1_score, max(reranker_score) FILTER (rank = 2) AS top2_score,
      max(cosine_similarity) FILTER (rank = 1) AS top1_cosine, max(rrf_score) FILTER (rank = 1) AS top1_rrf, round(avg(reranker_score), 6) AS mean_score,
      count(*) FILTER (reranker_score >= 0.5) AS supporting FROM top5 GROUP BY query_id)),
lab AS MATERIALIZED (SELECT feat.*, er.rank IS NOT NULL AS expected FROM feat JOIN er USING (query_id))"""
_MEANS = "count(*) AS n_questions, " + ", ".join(f"round(avg(recall_at_{k}), 6) AS recall_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(reciprocal_rank), 6) AS mrr"


def _values(values: tuple, name: str) -> str:
    return f"(SELECT unnest([{', '.join('NULL::DOUBLE' if v is None else f'{v}::DOUBLE' for v in values)}]) AS {name})"


CONFUSION = """
  SELECT *, round((false_acceptance_rate + false_rejection_rate) / 2, 6) AS balanced_error_rate FROM (
  SELECT {by} true_positive, true_negative, false_positive, false_negative,
    round((tp + tn) / greatest(total, 1), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END, 6) AS specificity,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1_score,
    round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS false_acceptance_rate, round(CASE WHEN fn + tp = 0 THEN 0 ELSE fn / (fn + tp) END, 6) AS false_rejection_rate,
    round((tp + fp) / greatest(total, 1), 6) AS coverage, round((tn + fn) / greatest(total, 1), 6) AS rejection_rate,
    total, true_positive + false_positive AS accepted, true_negative + false_negative AS rejected
  FROM (SELECT *, true_positive::DOUBLE AS tp, true_negative::DOUBLE AS tn, false_positive::DOUBLE AS fp, false_negative::DOUBLE AS fn,
               true_positive + true_negative + false_positive + false_negative AS total FROM (
    SELECT {by} count(*) FILTER (e AND p) AS true_positive, count(*) FILTER (NOT e AND NOT p) AS true_negative,
      count(*) FILTER (NOT e AND p) AS false_positive, count(*) FILTER (e AND NOT p) AS false_negative FROM {rows} {group})))"""
_FAILED = """list_filter([CASE WHEN top1_score < minimum_top1_score THEN 'top1_score' END, CASE WHEN margin < minimum_margin THEN 'margin' END,
    CASE WHEN coalesce(top1_cosine, 0) < minimum_cosine_similarity THEN 'cosine' END, CASE WHEN coalesce(top1_rrf, 0) < minimum_rrf_score THEN 'rrf' END,
    CASE WHEN supporting < minimum_supporting_results THEN 'supporting_results' END], lambda x: x IS NOT NULL)"""
_GRID = f"""
grid AS (SELECT * FROM {_values(E.TOP1, E.RULES[0])}, {_values(E.MARGIN, E.RULES[1])}, {_values(E.COSINE, E.RULES[2])}, {_values(E.RRF, E.RULES[3])}, {_values(E.SUPPORTING, E.RULES[4])}),
judged AS (SELECT grid.*, expected AS e, len({_FAILED}) = 0 AS p FROM lab, grid),
res AS (SELECT * FROM ({CONFUSION.format(by=", ".join(E.RULES) + ",", rows="judged", group="GROUP BY " + ", ".join(E.RULES))}))"""


def _sql(select: str, extra: str = "") -> str:
    return f"WITH {_BASE.strip()}{', ' + extra.strip() if extra else ''} {select}"


_ORDER = "false_acceptance_rate, f1_score DESC, accuracy DESC, balanced_error_rate, recall DESC, coverage DESC, " + ", ".join(f"{r} ASC NULLS FIRST" for r in E.RULES)

_GOLD = f"""
gold AS MATERIALIZED (
  SELECT query_id, lower(string_split(replace(source, '\\', '/'), '/')[-1]) AS want FROM (
    SELECT query_id, min(doc_id) AS home FROM norm_gold JOIN norm_docs ON contains(t, g) GROUP BY query_id) JOIN documents ON doc_id = home)"""


def _relevance(results: str) -> str:
    """results has (method, query_id, rank, chunk_id)."""
    return f"""
res0 AS MATERIALIZED ({results}),
seen AS (SELECT r.method, query_id, r.rank, lower(string_split(replace(coalesce(source, ''), '\\', '/'), '/')[-1]) = want AS same, contains(t, g) AS whole,
  list_distinct({_TERMS.format('evidence')}) AS e, {_TERMS.format("coalesce(text, '')")} AS c
  FROM res0 r JOIN gold USING (query_id) JOIN q USING (query_id) JOIN norm_gold USING (query_id) JOIN documents d ON d.doc_id = chunk_id JOIN norm_docs n ON n.doc_id = chunk_id),
found AS (SELECT method, query_id, min(rank) FILTER (same) AS source_rank, min(rank) FILTER (same AND (whole OR (len(e) > 0 AND len(list_intersect(e, c)) / len(e)::DOUBLE >= 0.6))) AS evidence_rank FROM seen GROUP BY ALL),
rel AS MATERIALIZED (
  SELECT method, query_id, source_rank, evidence_rank, coalesce(n, 0)::DOUBLE AS n FROM gold CROSS JOIN (SELECT DISTINCT method FROM res0) LEFT JOIN found USING (method, query_id)
  LEFT JOIN (SELECT method, query_id, count(*) AS n FROM res0 GROUP BY ALL) USING (method, query_id))"""


_ALL = " UNION ALL ".join(f"SELECT '{m}' AS method, query_id, rank, chunk_id FROM {t} WHERE rank <= 10" for m, t in (("bm25", "bm"), ("vector", "vec"), ("hybrid", "hy"), ("hyde", "hvec"), ("hyde_hybrid", "hh")))
_RATES = ", ".join(
    [f"round(avg(coalesce(({w}_rank <= {k})::INT, 0)), 6) AS {w}_recall_at_{k}" for w in ("source", "evidence") for k in (1, 3, 5, 10)]
    + [f"round(avg(coalesce(1.0::DOUBLE / {w}_rank, 0)), 6) AS {w}_mrr" for w in ("source", "evidence")]
)
_REPORT = f"""SELECT *, row_number() OVER (ORDER BY evidence_mrr DESC, evidence_recall_at_1 DESC, evidence_recall_at_5 DESC, mean_retrieval_time_ms, method) AS place FROM (
  SELECT method, count(*) AS n_questions, {_RATES}, round(avg(n), 4) AS mean_retrieval_time_ms, round(median(n), 4) AS median_retrieval_time_ms,
  round(quantile_cont(n, 0.95), 4) AS p95_retrieval_time_ms, min(n) AS min_retrieval_time_ms, max(n) AS max_retrieval_time_ms FROM rel GROUP BY method)"""
_COMPARED = f"""SELECT row_number() OVER (ORDER BY evidence_recall_at_5 DESC, evidence_mrr DESC, mean_retrieval_time_ms, method) AS place, method, n_questions, evidence_recall_at_1, evidence_recall_at_3,
  evidence_recall_at_5, evidence_recall_at_10, evidence_mrr FROM ({_REPORT})"""

_HASHED = """(SELECT key, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot, sum(CASE WHEN (('0x' || substr(md5(term), 1, 8))::BIGINT >> 16) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x
  FROM (SELECT {key} AS key, unnest({terms}) AS term FROM {rows}) GROUP BY ALL)"""
_HYDE = f"""
dv AS MATERIALIZED {_HASHED.format(key="doc_id", terms=_TERMS.format("coalesce(text, '')"), rows="documents")},
av AS MATERIALIZED {_HASHED.format(key="query_id", terms=_TERMS.format("question || chr(10) || evidence"), rows="q")},
dl2 AS (SELECT doc_id AS key, 1 + coalesce(sum(x * x), 0)::DOUBLE AS q FROM (SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\\s\\x{{a0}}\\x{{85}}\\x{{2028}}\\x{{3000}}]')) LEFT JOIN dv ON doc_id = key GROUP BY doc_id),
al2 AS (SELECT query_id AS key, 1 + coalesce(sum(x * x), 0)::DOUBLE AS q FROM q LEFT JOIN av ON query_id = key GROUP BY query_id),
dots AS (SELECT av.key AS query_id, dv.key AS chunk_id, sum(av.x * dv.x) AS p FROM av JOIN dv USING (slot) GROUP BY ALL),
hv AS MATERIALIZED (
  SELECT a.key AS query_id, b.key AS chunk_id, round((1 + coalesce(p, 0)) / (sqrt(a.q) * sqrt(b.q)), 6) AS cosine_similarity
  FROM al2 a CROSS JOIN dl2 b LEFT JOIN dots ON dots.query_id = a.key AND dots.chunk_id = b.key),
hvec AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine_similarity DESC, chunk_id) AS rank, chunk_id, cosine_similarity FROM hv QUALIFY rank <= 50),
hfused AS (
  SELECT query_id, chunk_id, v.rank AS vector_rank, b.rank AS bm25_rank, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS rrf_score FROM hvec v FULL JOIN bm b USING (query_id, chunk_id)),
hh AS MATERIALIZED (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, least(coalesce(vector_rank, 1000000000), coalesce(bm25_rank, 1000000000)), chunk_id) AS rank, * EXCLUDE (query_id) FROM hfused QUALIFY rank <= 10)"""
ORACLE = {
    "hyde_topk": _sql("SELECT *, round(1 - cosine_similarity, 6) AS cosine_distance FROM hvec WHERE rank <= 10", _HYDE),
    "hyde_hybrid": _sql("SELECT query_id, rank, chunk_id, vector_rank, bm25_rank, rrf_score FROM hh", _HYDE),
    "bm25_topk": _sql("SELECT * FROM bm WHERE rank <= 10"),
    "bm25_topk_filtered": _sql(
        "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank, chunk_id, score FROM scored JOIN documents ON doc_id = chunk_id WHERE lang = 'en' QUALIFY rank <= 10"
    ),
    "index_counts": "SELECT 'lexical' AS index, count(*) AS chunks FROM documents UNION ALL SELECT 'vector', count(*) FROM embeddings",
    "vector_topk_filtered": f"""WITH items AS (SELECT item_id AS query_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark),
      qv AS (SELECT query_id, v.embedding::DOUBLE[] AS query_vector FROM items JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings) v USING (n)),
      c AS (SELECT query_id, vec_id AS chunk_id, round(greatest(-1, least(1, list_cosine_similarity(embedding::DOUBLE[], query_vector))), 6) AS cosine_similarity FROM embeddings, qv WHERE label = 1)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine_similarity DESC, chunk_id) AS rank, chunk_id, cosine_similarity, round(1 - cosine_similarity, 6) AS cosine_distance FROM c QUALIFY rank <= 10""",
    "inner_product_topk": _sql("SELECT query_id, rank, chunk_id, cosine_similarity AS inner_product, round(1 - cosine_similarity, 6) AS distance FROM vec WHERE rank <= 10"),
    "relevance": _sql("SELECT query_id, source_rank, evidence_rank FROM rel", f"{_GOLD}, {_relevance(_ALL.split(' UNION')[0])}"),
    "retrieval_report": _sql(_REPORT, f"{_HYDE}, {_GOLD}, {_relevance(_ALL)}"),
    "retrieval_comparison": _sql(_COMPARED, f"{_HYDE}, {_GOLD}, {_relevance(_ALL)}"),
    "term_stats": _sql("SELECT term, count(DISTINCT chunk_id) AS n_docs, count(*) AS n_total FROM post GROUP BY term"),
    "doc_stats": _sql("SELECT * FROM dl"),
    "vector_topk": _sql("SELECT *, round(1 - cosine_similarity, 6) AS cosine_distance FROM vec WHERE rank <= 10"),
    "hybrid_rrf": _sql("SELECT query_id, rank, chunk_id, vector_rank, bm25_rank, rrf_score FROM hy WHERE rank <= 10"),
    "rerank_topk": _sql("SELECT query_id, rank, hybrid_rank, chunk_id, reranker_score FROM top5"),
    "evidence_rank": _sql("SELECT * FROM er"),
    "recall_mrr": _sql("SELECT * FROM met"),
    "retrieval_summary": _sql(f"SELECT {_MEANS} FROM met"),
    "retrieval_by_format": _sql(f"SELECT CASE WHEN length(evidence) < 400 THEN 'short' ELSE 'long' END AS format, {_MEANS} FROM met JOIN q USING (query_id) GROUP BY 1"),
    "evidence_token_recall": _sql(
        f"""SELECT query_id, chunk_id, round(len(list_intersect(list_distinct(e), c))::DOUBLE / len(list_distinct(e)), 6) AS token_recall FROM (
        SELECT query_id, chunk_id, {_TERMS.format("evidence")} AS e, {_TERMS.format("text")} AS c FROM bm JOIN q USING (query_id) JOIN documents ON doc_id = chunk_id WHERE rank = 1)"""
    ),
    "confidence_features": _sql("SELECT * FROM feat"),
    "confidence_gate": _sql(
        f"""SELECT query_id, len(f) = 0 AS accepted, array_to_string(f, ',') AS failed_rules FROM (SELECT query_id, {_FAILED} AS f FROM feat,
        (SELECT 0.5::DOUBLE AS minimum_top1_score, 0.05::DOUBLE AS minimum_margin, 0.1::DOUBLE AS minimum_cosine_similarity, 0.015::DOUBLE AS minimum_rrf_score, 1 AS minimum_supporting_results))"""
    ),
    "threshold_grid": _sql("SELECT * FROM res", _GRID),
    "threshold_grid_top20": _sql(f"SELECT * FROM res ORDER BY {_ORDER} LIMIT 20", _GRID),
    "threshold_generalisation": _sql(
        f"SELECT * FROM ({CONFUSION.format(by=', '.join(E.RULES) + ',', rows='tested', group='GROUP BY ' + ', '.join(E.RULES))})",
        _GRID.replace("FROM lab, grid", "FROM lab, grid WHERE query_id % 2 = 0")
        + f""",
best AS (SELECT {', '.join(E.RULES)} FROM res ORDER BY {_ORDER} LIMIT 1),
tested AS (SELECT best.*, expected AS e, len({_FAILED}) = 0 AS p FROM lab, best WHERE query_id % 2 = 1)""",
    ),
    "feature_label_summary": _sql(
        "SELECT expected, count(*) AS questions, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, median({c}) AS median_{c}" for c in ("top1_score", "margin", "mean_score")) + " FROM lab GROUP BY expected"
    ),
    "fts_query_build": _sql("SELECT query_id, array_to_string(list_transform(list_filter(t, lambda x, i: list_position(t, x) = i), lambda x: '\"' || x || '\"'), ' OR ') AS query FROM asked1"),
    "candidate_export": _sql("SELECT query_id, string_agg(rank || ':' || chunk_id, ',' ORDER BY rank) AS candidates FROM bm WHERE rank <= 10 GROUP BY query_id"),
    "vector_norms": "SELECT label, count(*) AS vectors, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS mean_norm FROM embeddings GROUP BY label",
    "consecutive_similarity": """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)), 6) AS similarity FROM embeddings""",
}
QUERIES = {k: v for k, v in globals().items() if k in ORACLE}
