"""Queries on what stands around retrieval: rows of an index, questions and outputs of a model, suites, runs, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrove.functions import queries as Q
from lexigrove.functions import text as X
from lexigrove.operators import chunking as C
from lexigrove.operators import evaluation as E
from lexigrove.operators import prompts as P
from lexigrove.operators import providers as V
from lexigrove.operators import runs as U
from lexigrove.operators import spelling as W
from lexigrove.plans.content import _S, _T, _TOK, _strip
from lexigrove.sources import tables as S
from lexigrove.sources.tables import table


def chunk_rows(spark, d):
    """Documents as chunk records, each third with its own gaps in what is known of it."""
    i = F.col("doc_id").cast("string")
    meta = F.map_filter(
        F.map_from_arrays(
            F.array(*map(F.lit, ("chunk_id", "source", "format", "page", "page_number"))),
            F.array(
                F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" m"), i)), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a\\"), "source", F.lit(".md"))), F.when(F.col("doc_id") % 5 == 0, "HTML"),
                F.when(F.col("doc_id") % 4 == 0, "x"), F.when(F.col("doc_id") % 4 == 1, F.lit(" 7")),
            ),
        ), lambda k, v: v.isNotNull(),
    )
    own = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("c"), i))
    records = table(spark, d, "documents").select(F.col("doc_id").alias("position"), F.col("text").alias("page_content"), meta.alias("metadata"), own.alias("chunk_id"), F.concat("source", F.lit("\\p.PDF")).alias("source"))
    return S.chunk_rows(records).select("position", "chunk_id", "source", "document_format", "page_number", F.md5("content").alias("digest"), F.get_json_object("metadata", "$.chunk_position").alias("chunk_position"))


def repeated_texts(spark, d):
    docs = table(spark, d, "documents").select(F.md5(X.text_of("text")).alias("digest"))
    return S.repeated(docs, "digest")


def page_sections(spark, d):
    """Lines as pages."""
    return S.page_sections(table(spark, d, "documents").select("doc_id", F.split(X.text_of("text"), "\n").alias("pages")), "doc_id").select("doc_id", "section_id", "heading", "page", F.md5("text").alias("digest"))


def token_edges(spark, d):
    t = F.col("text")
    pieces = Q.split_by_tokens(t, 100)
    out = table(spark, d, "documents").select("doc_id", Q.first_tokens(t, 5).alias("head"), Q.last_tokens(t, 5).alias("tail"), pieces.alias("p"))
    return out.select("doc_id", "head", "tail", F.size("p").cast("long").alias("pieces"), F.md5(F.array_join("p", "|")).alias("digest"))


def front_matter(spark, d):
    """Documents behind a block of their source and language, some quoted, and a line that is no pair."""
    lead = F.concat(F.lit('---\r\ntitle: "'), "source", F.lit("\"\nms.lang:  "), "lang", F.lit("\nnothing here\ntitle: again\n---\n"), X.text_of("text"))
    whole = F.when(F.col("doc_id") % 4 == 0, X.text_of("text")).otherwise(lead)
    found = table(spark, d, "documents").select("doc_id", Q.front_matter(whole).alias("f"))
    return found.select("doc_id", F.try_element_at("f.values", F.lit("title")).alias("title"), F.try_element_at("f.values", F.lit("ms.lang")).alias("language"), F.md5("f.body").alias("body"))


def document_names(spark, d):
    """Ids and titles of pages by their heading, where they have one, or by a path."""
    path = F.concat(F.lit("Docs\\guide/Part_"), F.col("page_id").cast("string"), F.lit("-of-book.v2.MD"))
    heading = F.when(F.col("page_id") % 3 != 0, F.regexp_extract(X.text_of("html"), r"(?s)<h1>([^<]*)</h1>", 1))
    return table(spark, d, "pages").select("page_id", Q.document_id(F.lit("web"), path).alias("document_id"), Q.title(heading, path=path).alias("title"))


def _outputs(spark, d):
    """What models make of questions: fenced, labelled, quoted, plain, of two lines, answers, markup, too long."""
    k, t = F.col("item_id") % 8, F.substring_index("text", " ", 6)
    shape = (
        F.when(k == 0, F.concat(F.lit("```text\n"), t, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Normalized Query: "), t)).when(k == 2, F.concat(F.lit(" 'output: "), t, F.lit("' ")))
        .when(k == 3, t).when(k == 4, F.concat(t, F.lit("\nmore"))).when(k == 5, F.concat(F.lit("Sure, "), t)).when(k == 6, F.concat(F.lit("* "), t)).otherwise(F.repeat(F.concat(t, F.lit(" ")), 20))
    )
    return table(spark, d, "benchmark").select("item_id", shape.alias("output"), F.lower(t).alias("question"))


def normalised_outputs(spark, d):
    made = _outputs(spark, d).select("item_id", "question", Q.normalised_output(F.col("output"), F.col("question")).alias("normalised"))
    return made.select("item_id", "normalised", Q.expanded(F.coalesce("normalised", "question"), F.col("question")).alias("lexical"))


def displayed_answers(spark, d):
    """Passages as answers, with citations that only a program reads and one that a reader may."""
    i = F.col("item_id").cast("string")
    answer = F.concat("text", F.lit("  [guide.md : "), i, F.lit("] , see [x__chunk_"), i, F.lit("]. \n\n\n\nAnd [1] \t!"))
    return table(spark, d, "benchmark").select("item_id", Q.display(answer).alias("shown"))


def conversation_titles(spark, d):
    """A conversation's title is its first user message's first 42 characters."""
    users = table(spark, d, "conversations").where("role = 'user'")
    return users.groupBy("conv_id").agg(F.left(F.min_by(X.text_of("text"), "turn"), F.lit(42)).alias("title"))


def _suite(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    n, p = F.col("n_chars"), F.col("toxic") == 0
    return table(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id", (F.col("quality") == 1).alias("expected"), p.alias("predicted"), p.alias("llm_called"), F.when(p, n % 100).alias("input_tokens"), F.when(p, n % 10).alias("output_tokens"),
        (n % 4 != 0).alias("citations_valid"), (n % 7 == 0).alias("llm_failed"), (n / 8).alias("total_ms"),
    )


def suite_summary(spark, d):
    return V.suite_summary(_suite(spark, d))


def suite_errors(spark, d):
    return V.suite_errors(_suite(spark, d)).select("doc_id", F.array_join("errors", ",").alias("errors"))


def method_comparison(spark, d):
    """Documents' places in their language under three orders, as ranks of three methods."""
    docs = table(spark, d, "documents")
    ranks = {"length": F.col("n_chars") % 13 + 1, "id": F.when(F.col("doc_id") % 17 < 12, F.col("doc_id") % 17 + 1), "source": F.length("source") % 4 + F.col("doc_id") % 3 + 1}
    return E.compared({name: E.means(E.question_metrics(docs.select(rank.cast("long").alias("rank")))) for name, rank in ranks.items()})


def evidence_present(spark, d):
    """Each labelled document's eleventh to twentieth word, every third of them with a foreign one, in the document's lines."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("in/Doc"), F.col("doc_id").cast("string"), F.lit(".MD")).alias("source"))
    words = F.array_join(F.slice(X.tokens(F.col("text")), 11, 10), "  ")
    items = table(spark, d, "labels").select("doc_id").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.upper("source").alias("source"), F.when(F.col("doc_id") % 3 == 0, F.concat(words, F.lit(" zzz"))).otherwise(words).alias("evidence"))
    pages = docs.select("source", F.explode(F.split(X.text_of("text"), "\n")).alias("content"))
    return E.evidence_present(items, pages)


def chunk_times(spark, d):
    """Chunks of two sizes with the times of one."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    sizes = [C.fixed_tokens(docs, size, overlap).agg(F.count("*").alias("chunks"), F.max("token_count").alias("largest")).withColumn("chunk_size", F.lit(size).cast("long")) for size, overlap in ((64, 8), (256, 32))]
    times = spark.createDataFrame([(256, 12.5)], "chunk_size long, seconds double")
    return E.with_times(sizes[0].unionByName(sizes[1]), times, "chunk_size")


def run_states(spark, d):
    """Users' events as changes of runs' statuses."""
    kinds = F.array(*[F.lit(s) for s in U.STATUSES])
    status = F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int"))
    log = table(spark, d, "events").where("user_id is not null").select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMddHH")).alias("run_id"), F.lit("search").alias("kind"), F.col("event_type").alias("name"),
        status.alias("status"), F.col("ts").alias("at"), F.col("props").alias("message"),
    )
    return U.states(log).select("run_id", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"), "duration_seconds", "error", "valid")


def spelling(spark, d):
    """Words of questions, each without its third letter, held against the words that documents use at least twice."""
    docs = table(spark, d, "documents").where("lang = 'en'")
    asked = table(spark, d, "benchmark").select(F.explode(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9_-]*)"), F.lit(1)), 1, 12)).alias("word")).where("length(word) between 5 and 14")
    broken = asked.select(F.concat(F.left("word", F.lit(2)), F.substring("word", 4, 99)).alias("word")).distinct()
    return W.corrections(broken, W.vocabulary(docs, least=2))


def prompt_messages(spark, d):
    """A question in each document's language, with the document itself as the first context and the next one as the second."""
    docs = table(spark, d, "documents")
    lang = F.when(F.col("doc_id") % 3 == 0, "EN ").when(F.col("doc_id") % 3 == 1, "ar").otherwise("fr")
    style = F.when(F.col("doc_id") % 2 == 0, "concise").when(F.col("doc_id") % 7 == 0, "loud").otherwise("expert")
    asked = docs.select(F.col("doc_id").alias("query_id"), F.concat("source", F.lit(" ?")).alias("question"), lang.alias("language"), style.alias("style"))
    one = docs.select(
        F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), "source", F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit("md").alias("document_format"), F.lit(None).cast("string").alias("source_url"),
        (F.col("doc_id") % 9).alias("page_number"), F.lit(0.5).alias("score"),
    )
    two = one.withColumns({"query_id": F.col("query_id") - 1, "rank": F.lit(2), "page_number": F.lit(None).cast("long"), "score": F.lit(None).cast("double"), "source_url": F.lit("http://x"), "document_format": F.lit("")})
    out = P.messages(asked, one.unionByName(two.where("query_id >= 0")))
    return out.select("query_id", F.md5("system").alias("system"), F.md5("user").alias("asked"))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SUITE = """WITH s AS (SELECT doc_id, quality = 1 AS e, toxic = 0 AS p, n_chars AS n, n_chars % 4 <> 0 AS c, n_chars % 7 = 0 AS f FROM labels JOIN documents USING (doc_id))"""
_DISPLAY = r"regexp_replace(text || '  [guide.md : ' || item_id || '] , see [x__chunk_' || item_id || ']. ' || repeat(chr(10), 4) || 'And [1] ' || chr(9) || '!', '(?i)\[[^\[\]\r\n]*(?:\.(?:pdf|md|html?|txt)\s*:|__chunk_\d+)[^\[\]\r\n]*\]', '', 'g')"
for _p, _to in ((r"[ \t]{2,}", "' '"), (r"[ \t]+([,.;:!?])", r"'\1'"), (r"[ \t]+\n", "chr(10)"), (r"\n{3,}", "repeat(chr(10), 2)")):
    _DISPLAY = f"regexp_replace({_DISPLAY}, '{_p}', {_to}, 'g')"
_PAIRS = {lang: " ".join(f"WHEN style = '{s}' THEN {_lit(line)}" for s, line in P.STYLE_RULES[lang].items()) for lang in P.LANGUAGES}
_STYLE = "CASE lang " + " ".join(f"WHEN '{lang}' THEN CASE {_PAIRS[lang]} END" for lang in P.LANGUAGES) + " END"
_SYSTEM = "CASE lang " + " ".join(f"WHEN '{lang}' THEN {_lit(P.RULES[lang] + P.REFUSALS[lang])}" for lang in P.LANGUAGES) + " END"
_NORMAL = rf"""WITH o AS (SELECT item_id, item_id % 8 AS k, array_to_string(string_split(text, ' ')[1:6], ' ') AS t FROM benchmark),
  g AS (SELECT item_id, lower(t) AS q, CASE k WHEN 0 THEN '```text' || chr(10) || t || chr(10) || '```' WHEN 1 THEN 'Normalized Query: ' || t WHEN 2 THEN ' ''output: ' || t || ''' ' WHEN 3 THEN t
    WHEN 4 THEN t || chr(10) || 'more' WHEN 5 THEN 'Sure, ' || t WHEN 6 THEN '* ' || t ELSE repeat(t || ' ', 20) END AS o FROM o),
  b AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(o), '^```(?:text)?\s*|\s*```$', '', 'g')), '(?i)^(?:normalized query|normalized|output)\s*:\s*', '')) AS x FROM g),
  u AS (SELECT *, CASE WHEN length(x) >= 2 AND left(x, 1) = right(x, 1) AND left(x, 1) IN ('"', '''') THEN trim(x[2:-2]) ELSE x END AS y FROM b),
  n AS (SELECT item_id, q, CASE WHEN y <> '' AND NOT contains(y, chr(10)) AND length(y) <= greatest(120, 3 * length(q)) AND NOT regexp_matches(y, '(?i)^(?:answer|explanation|the answer|here(?:''s| is)|certainly|sure)\s*[:,-]')
    AND left(y, 1) <> '#' AND left(y, 2) NOT IN ('- ', '* ') THEN y END AS normalised FROM u)"""

ORACLE = {
    "chunk_rows": f"""WITH c AS (SELECT *, replace(CASE WHEN doc_id % 2 = 0 THEN 'a/' || source || '.md' ELSE source || '/p.PDF' END, chr(92), '/') AS s FROM documents)
      SELECT doc_id AS position, CASE doc_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'c' ELSE 'chunk_' END || doc_id AS chunk_id, s AS source,
        CASE WHEN doc_id % 5 = 0 THEN 'html' WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'pdf' END AS document_format, CASE WHEN doc_id % 4 = 1 THEN 7 END AS page_number, md5({_strip(_T)}) AS digest, doc_id::VARCHAR AS chunk_position FROM c""",
    "repeated_texts": f"SELECT md5({_T}) AS digest, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1",
    "page_sections": f"""WITH p AS (SELECT doc_id, string_split({_T}, chr(10)) AS l FROM documents), q AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS page, l FROM p)
      SELECT doc_id, doc_id || ':page-' || page AS section_id, 'Page ' || page AS heading, page, md5({_strip("l[page]")}) AS digest FROM q WHERE {_strip("l[page]")} <> ''""",
    "token_edges": f"""WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents),
      u AS (SELECT *, list_transform(range(0, len(w), 100), lambda i: array_to_string(w[i + 1 : i + 100], ' ')) AS p FROM t)
      SELECT doc_id, array_to_string(w[1:5], ' ') AS head, array_to_string(w[greatest(len(w) - 4, 1):], ' ') AS tail, len(p) AS pieces, md5(array_to_string(p, '|')) AS digest FROM u""",
    "front_matter": rf"""WITH w AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {_T} ELSE '---' || chr(13) || chr(10) || 'title: "' || source || '"' || chr(10) || 'ms.lang:  ' || lang || chr(10) || 'nothing here' || chr(10) || 'title: again' || chr(10) || '---' || chr(10) || {_T} END AS raw FROM documents),
      t AS (SELECT doc_id, regexp_replace(raw, '\r\n?', chr(10), 'g') AS t FROM w), b AS (SELECT *, regexp_extract(t, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)', 1) AS block FROM t)
      SELECT doc_id, nullif(regexp_extract(block, 'title: "([^"]*)"', 1), '') AS title, nullif(regexp_extract(block, 'ms.lang:\s*(\S+)', 1), '') AS language,
        md5(CASE WHEN block = '' THEN t ELSE substr(t, length(block) + 10) END) AS body FROM b""",
    "document_names": f"""SELECT page_id, 'web:part_' || page_id || '-of-book.v2' AS document_id, coalesce(CASE WHEN page_id % 3 <> 0 THEN nullif({_strip("regexp_extract(html, '(?s)<h1>([^<]*)</h1>', 1)")}, '') END, 'Part ' || page_id || ' Of Book.v2') AS title FROM pages""",
    "normalised_outputs": f"{_NORMAL} SELECT item_id, normalised, CASE WHEN coalesce(normalised, q) = q THEN q ELSE normalised || chr(10) || q END AS lexical FROM n",
    "displayed_answers": f"SELECT item_id, {_strip(_DISPLAY)} AS shown FROM benchmark",
    "conversation_titles": "SELECT conv_id, left(arg_min(coalesce(text, ''), turn), 42) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "suite_summary": f"""{_SUITE} SELECT count(*) AS questions, count(*) FILTER (e AND p) AS true_positive, count(*) FILTER (NOT e AND NOT p) AS true_negative, count(*) FILTER (NOT e AND p) AS false_positive,
      count(*) FILTER (e AND NOT p) AS false_negative, round(avg((e = p)::INT), 6) AS accuracy, count(*) FILTER (p) AS llm_calls, coalesce(sum(n % 100) FILTER (p), 0)::BIGINT AS input_tokens,
      coalesce(sum(n % 10) FILTER (p), 0)::BIGINT AS output_tokens, round(avg(c::INT) FILTER (p), 6) AS citation_validity, round(avg(n / 8), 4) AS mean_total_ms, median(n / 8) AS median_total_ms FROM s""",
    "suite_errors": f"""{_SUITE}, k AS (SELECT doc_id, concat_ws(',', CASE WHEN e <> p THEN 'wrong_prediction' END, CASE WHEN p AND NOT c THEN 'invalid_citations' END, CASE WHEN p AND f THEN 'failed_llm' END) AS errors FROM s)
      SELECT * FROM k WHERE errors <> ''""",
    "method_comparison": """WITH r AS (SELECT 'length' AS method, n_chars % 13 + 1 AS rank FROM documents UNION ALL SELECT 'id', CASE WHEN doc_id % 17 < 12 THEN doc_id % 17 + 1 END FROM documents
        UNION ALL SELECT 'source', length(source) % 4 + doc_id % 3 + 1 FROM documents)
      SELECT method, count(*) AS n_questions, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS recall_at_1, round(avg(coalesce((rank <= 3)::INT, 0)), 6) AS recall_at_3, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS recall_at_5,
        round(avg(coalesce((rank <= 10)::INT, 0)), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM r GROUP BY method""",
    "evidence_present": rf"""WITH f AS (SELECT doc_id, {_TOK}[11:20] AS w, string_split({_T}, chr(10)) AS l FROM documents JOIN labels USING (doc_id)),
      c AS (SELECT doc_id, lower(array_to_string(w, ' ')) || CASE WHEN doc_id % 3 = 0 THEN ' zzz' ELSE '' END AS e, list_transform(l, lambda x: regexp_replace(lower(x), '{_S}+', ' ', 'g')) AS l FROM f)
      SELECT doc_id AS id, trim(e) <> '' AND len(list_filter(l, lambda x: contains(x, trim(e)))) > 0 AS present FROM c""",
    "chunk_times": f"""WITH t AS (SELECT len({_TOK}) AS n FROM documents), s(chunk_size, step) AS (VALUES (64::BIGINT, 56), (256, 224)),
      k AS (SELECT chunk_size, n, greatest(ceil((n - chunk_size) / step::DOUBLE)::BIGINT, 0) + 1 AS windows FROM t, s WHERE n > 0)
      SELECT chunk_size, sum(windows)::BIGINT AS chunks, max(least(n, chunk_size))::BIGINT AS largest, CASE WHEN chunk_size = 256 THEN 12.5::DOUBLE END AS seconds FROM k GROUP BY chunk_size""",
    "run_states": """WITH l AS (SELECT 'run_' || user_id || '_' || strftime(ts, '%Y%m%d%H') AS run_id, event_id % 4 AS k, ts, event_type, props FROM events WHERE user_id IS NOT NULL),
      o AS (SELECT *, lag(k) OVER w AS b, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, k DESC, event_type DESC, props DESC) AS back FROM l WINDOW w AS (PARTITION BY run_id ORDER BY ts, k, event_type, props)),
      r AS (SELECT run_id, arg_min(k, back) AS k, min(ts) FILTER (k = 1) AS a, min(ts) FILTER (k >= 2) AS z, arg_min({'m': props}, back).m AS m, bool_and(CASE k WHEN 0 THEN b IS NULL WHEN 1 THEN coalesce(b = 0, false) WHEN 2 THEN coalesce(b = 1, false) ELSE coalesce(b IN (0, 1), false) END) AS valid FROM o GROUP BY run_id)
      SELECT run_id, ['created', 'running', 'completed', 'failed'][k + 1] AS status, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, round((epoch_us(z) - epoch_us(a)) / 1e6, 6) AS duration_seconds, CASE WHEN k = 3 THEN m END AS error, valid FROM r""",
    "spelling": """WITH v AS (SELECT w AS other, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]*')) AS w FROM documents WHERE lang = 'en') GROUP BY 1 HAVING count(*) > 1),
      a AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]*')[1:12]) AS w FROM benchmark), s AS (SELECT DISTINCT left(w, 2) || w[4:] AS word FROM a WHERE length(w) BETWEEN 5 AND 14),
      p AS (SELECT word, other, n, levenshtein(word, other) AS l, damerau_levenshtein(word, other) AS m FROM s JOIN v ON abs(length(word) - length(other)) <= 2 WHERE word NOT IN (SELECT other FROM v) AND levenshtein(word, other) <= 2)
      SELECT word, arg_min(other, {'d': CASE WHEN l = 1 OR m = 1 THEN 1 ELSE 2 END, 'n': -n, 'w': other}) AS corrected FROM p GROUP BY word""",
    "prompt_messages": f"""WITH q AS (SELECT d.doc_id AS query_id, d.source || ' ?' AS question, CASE d.doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ar' ELSE 'fr' END AS lang, CASE WHEN d.doc_id % 2 = 0 THEN 'concise' WHEN d.doc_id % 7 = 0 THEN 'loud' ELSE 'expert' END AS style,
        '--- CONTEXT 1 ---' || chr(10) || 'AUTHORIZED CITATION — COPY EXACTLY:' || chr(10) || '[' || d.source || ':' || d.doc_id || ']' || chr(10) || 'Source: ' || d.source || chr(10) || 'Chunk ID: ' || d.doc_id || chr(10) || 'Format: md' || chr(10) || 'Page: ' || d.doc_id % 9 || chr(10) || 'Reranker score: 0.500000' || chr(10) || 'Content:' || chr(10) || {_strip("coalesce(d.text, '')")} AS one,
        '--- CONTEXT 2 ---' || chr(10) || 'AUTHORIZED CITATION — COPY EXACTLY:' || chr(10) || '[' || n.source || ':' || n.doc_id || ']' || chr(10) || 'Source: ' || n.source || chr(10) || 'Chunk ID: ' || n.doc_id || chr(10) || 'URL: http://x' || chr(10) || 'Content:' || chr(10) || {_strip("coalesce(n.text, '')")} AS two,
        {_strip("coalesce(d.text, '')")} <> '' AS has_one, coalesce({_strip("coalesce(n.text, '')")}, '') <> '' AS has_two FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1),
      u AS (SELECT query_id, lang, 'QUESTION' || chr(10) || question || chr(10) || chr(10) || 'CONTEXTS' || chr(10) || nullif(concat_ws(chr(10) || chr(10), CASE WHEN has_one THEN one END, CASE WHEN has_two THEN two END), '') || chr(10) || chr(10) || 'INSTRUCTIONS' || chr(10) || {_STYLE} AS asked FROM q)
      SELECT query_id, CASE WHEN asked IS NOT NULL THEN md5({_SYSTEM}) END AS system, md5(asked) AS asked FROM u""",
}
QUERIES = {k: v for k, v in globals().items() if k in ORACLE}
