"""Cleaning, deduplication, chunking, parsing and scalar queries, and the SQL that checks them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import metadata as M
from lexigrove.functions import text as X
from lexigrove.operators import blocks as B
from lexigrove.operators import chunkers as H_
from lexigrove.operators import chunking as C
from lexigrove.operators import cleaning as K
from lexigrove.operators import parts as G
from lexigrove.operators import sections as N
from lexigrove.operators import semantic as T
from lexigrove.sources import html as H
from lexigrove.sources import npy
from lexigrove.sources import tables as S
from lexigrove.sources.shared import shared_dir, spread
from lexigrove.sources.tables import table


def docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def clean_whitespace_inline(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.clean_inline(F.col("text"))).alias("cleaned"))


def clean_whitespace_multiline(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.clean_multiline(F.col("text"))).alias("cleaned"))


def clean_code_lines(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.clean_code(F.col("html"))).alias("cleaned"))


def clean_unicode(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.clean_unicode(F.col("text"))).alias("cleaned"))


def boilerplate_lines(spark, d):
    """Lines that are boilerplate, counted by their compared form: of documents, each with a line of navigation or a year."""
    known = F.array(*[F.lit(b) for b in X.BOILERPLATE])
    extra = F.concat(F.lit("\n  "), F.upper(F.element_at(known, (F.col("doc_id") % len(X.BOILERPLATE) + 1).cast("int"))), F.lit(" :\nCopyright 20"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0"), F.lit(" all\nprinter"))
    lines = K.to_lines(docs(spark, d).withColumn("text", F.concat(X.text_of("text"), extra)))
    return lines.where(X.is_boilerplate(F.col("line"))).groupBy(X.boilerplate_form(F.col("line")).alias("form")).agg(F.count("*").alias("lines"))


def boilerplate_links(spark, d):
    return table(spark, d, "pages").select("page_id", X.is_boilerplate_url(F.col("url")).alias("boilerplate"))


def dedup_lines_global(spark, d):
    """Lines that stay when a document keeps the first of equal ones."""
    return K.drop_repeats(K.to_lines(docs(spark, d))).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("pos").alias("places"))


def dedup_lines_local(spark, d):
    return K.drop_repeats(K.to_lines(docs(spark, d)), within=8).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("pos").alias("places"))


def consecutive_dedup(spark, d):
    return K.drop_neighbours(K.to_lines(docs(spark, d))).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("pos").alias("places"))


def dedup_documents(spark, d):
    return K.distinct_documents(docs(spark, d)).select("doc_id", "copies")


def section_fingerprints(spark, d):
    return K.section_fingerprints(K.to_lines(docs(spark, d)))


def cleaning_report(spark, d):
    return K.report(docs(spark, d))


def part_duplicates(spark, d):
    """What goes when a document keeps the first of equal parts: sections are runs of eight lines, whose first line's words
    are a list."""
    lines = F.split(X.text_of("text"), "\n")
    runs = X.once(lines, lambda ls: F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / 8).cast("int")), lambda i: F.slice(ls, i * 8 + 1, 8)))
    cut = docs(spark, d).select("doc_id", F.posexplode(runs).alias("position", "paragraphs"))
    none = lambda kind: F.array().cast(kind)
    sections = cut.withColumns(
        {
            "lists": F.array(X.tokens(F.col("paragraphs")[0])), "tables": none("array<struct<headers:array<string>,rows:array<array<string>>>>"),
            "code": none("array<struct<content:string,language:string>>"), "links": none("array<struct<text:string,url:string>>"),
        }
    )
    kept = G.drop_repeated_parts(sections, "doc_id")
    whole = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "paragraphs"))), lambda x: x["paragraphs"])), "\n")
    return kept.groupBy("doc_id").agg(F.sum("removed.paragraphs").alias("paragraphs"), F.sum("removed.list_items").alias("list_items"), F.md5(whole).alias("digest"))


def metadata_clean(spark, d):
    """A nested record of each document with its white space unified wherever a text stands, and two values of it by path."""
    words = F.slice(X.tokens(F.col("text")), 1, 3)
    told = F.struct(
        F.concat(F.lit("  "), "lang", F.lit(" \t"), "source").alias("title"), F.struct(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit("\n"))).alias("words"), F.col("n_chars").alias("n")).alias("inner"),
        F.array(F.struct((F.col("n_chars") / 4).alias("quarter"), F.lit(" x  y ").alias("note"))).alias("list"),
    )
    made = spread(table(spark, d, "documents")).select("doc_id", F.parse_json(F.to_json(told)).alias("v"))
    clean = made.withColumn("v", M.each_string(M.single_spaced)(F.col("v")))
    return clean.select("doc_id", F.to_json("v").alias("record"), M.filled(F.col("v"), "$.inner.words[0]").alias("word"), M.filled(F.col("v"), "$.list[0].quarter", "double").alias("quarter"))


def npy_checks(spark, d):
    """Vectors written as NPY files and read again by byte ranges."""
    path = f"{shared_dir(spark)}/lexigrove/npy-{uuid.uuid4().hex}"
    npy.register(spark)
    table(spark, d, "embeddings").select(F.col("embedding").alias("vector")).write.format("npy").mode("append").save(path)
    return S.vector_checks(spark.read.format("npy").option("rows", 500).load(path), "vector")


def sentence_split(spark, d):
    s = X.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(s).cast("long").alias("sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


def paragraph_split(spark, d):
    p = X.paragraphs(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(p).cast("long").alias("paragraphs"), F.md5(F.array_join(p, "|")).alias("digest"))


def token_count(spark, d):
    return docs(spark, d).select("doc_id", X.token_count("text").cast("long").alias("tokens"))


def technology_forms(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.technology_form(F.col("text"))).alias("digest"))


def evaluation_forms(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.evaluation_form(F.col("text"))).alias("digest"))


def url_filename(spark, d):
    return table(spark, d, "pages").select("page_id", X.url_filename(F.col("url")).alias("filename"))


def canonical_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.canonical_filename(F.col("url")).alias("name"), X.detect_format(F.col("url")).alias("format"))


def chunk_fixed_char(spark, d):
    return C.fixed_characters(docs(spark, d)).select("doc_id", "chunk_index", "start", "chunk_id", F.md5("content").alias("digest"))


def chunk_fixed_token(spark, d):
    return C.fixed_tokens(docs(spark, d)).select("doc_id", "chunk_index", "start", "token_count", "chunk_id")


def chunk_statistics(spark, d):
    return C.statistics(C.fixed_characters(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), carry=("lang",)), "lang")


def chunk_validation(spark, d):
    return C.validation(C.fixed_characters(docs(spark, d)), 1024)


def chunk_recursive(spark, d):
    return C.recursive(docs(spark, d)).select("doc_id", "chunk_index", "token_count", "boundary", F.md5("content").alias("digest"))


def chunk_semantic(spark, d):
    """Chunks of documents that end where a sentence is unlike the one before, by the hashing encoder."""
    made = T.semantic_chunks(T.as_blocks(docs(spark, d)), T.hash_encoder(), threshold=0.2)
    return made.select("doc_id", "chunk_index", "token_count", "boundary", "least_similarity", "first_unit", "last_unit", F.md5("content").alias("digest"))


def semantic_units(spark, d):
    """Sentences with their likeness to the one before."""
    found = T.likened(T.as_blocks(docs(spark, d)), 128, T.hash_encoder())
    return found.select("doc_id", "unit", "tokens", "similarity")


def chunk_strategies(spark, d):
    """Chunkers by name: how many chunks each makes of a document, and a digest of them all."""
    texts = docs(spark, d)
    made = [H_.chunk("fixed_size", texts), H_.chunk("fixed-size", texts, size=40, overlap=5, tokens="terms"), H_.chunk("fixed_size", texts.where("doc_id % 10 = 0"), size=300, overlap=0, tokens="characters")]
    every = reduce(DataFrame.unionByName, [m.withColumn("n", F.lit(n)) for n, m in enumerate(made)])
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "|")
    return every.groupBy("n", "doc_id").agg(F.count("*").alias("chunks"), F.md5(content).alias("digest"))


def chunk_percentile(spark, d):
    """Chunks that break at the largest twentieth of a document's distances."""
    made = T.percentile_chunks(T.as_blocks(docs(spark, d)), T.hash_encoder())
    return made.select("doc_id", "chunk_index", "units", "least_similarity", F.md5("content").alias("digest"))


def html_sections(spark, d):
    found = H.sections(table(spark, d, "pages"), "page_id", "html")
    return found.select("page_id", "position", "heading", "level", F.size("paragraphs").alias("paragraphs"), F.md5(H.section_text()).alias("digest"))


def html_tables(spark, d):
    found = H.sections(table(spark, d, "pages"), "page_id", "html").select("page_id", "position", F.explode("tables").alias("t"))
    return found.select("page_id", "position", F.array_join("t.headers", ",").alias("headers"), F.size("t.rows").alias("rows"))


def html_links(spark, d):
    found = H.sections(table(spark, d, "pages"), "page_id", "html").select("page_id", "position", F.explode("links").alias("l"))
    return found.select("page_id", "position", F.col("l.text").alias("text"), F.col("l.url").alias("url"), X.is_boilerplate_url(F.col("l.url")).alias("boilerplate"))


def html_metadata(spark, d):
    return H.metadata(table(spark, d, "pages")).withColumn("keywords", F.array_join("keywords", "|"))


def markdown_sections(spark, d):
    found = H.sections(docs(spark, d), "doc_id", "text", "markdown")
    return found.select("doc_id", "position", "heading", F.size("paragraphs").alias("paragraphs"), F.md5(H.section_text()).alias("digest"))


def _cleaned(spark, d):
    return N.clean(H.sections(table(spark, d, "pages"), "page_id", "html"), "page_id")


def clean_sections(spark, d):
    """Parsed pages after the default cleaners."""
    return _cleaned(spark, d).select("page_id", "position", "heading", F.size("paragraphs").alias("paragraphs"), F.size("links").alias("links"), F.md5(H.section_text()).alias("digest"))


def section_report(spark, d):
    parsed = H.sections(table(spark, d, "pages"), "page_id", "html")
    return N.report(parsed, N.clean(parsed, "page_id"), "page_id")


def page_blocks(spark, d):
    return B.build_blocks(_cleaned(spark, d), "page_id").select("page_id", "block_index", "block_type", "section_id", "block_id")


def page_chunks(spark, d):
    """Token windows over a page's blocks, with the section and the heading path that they share."""
    made = B.chunk_blocks(B.build_blocks(_cleaned(spark, d), "page_id"), "page_id")
    return made.select("page_id", "chunk_index", "start", "token_count", F.size("block_ids").alias("blocks"), "section_id", F.array_join("heading_path", " / ").alias("heading_path"), "chunk_id")


def vector_checks(spark, d):
    return S.vector_checks(table(spark, d, "embeddings"))


_S = X.SPACE
_T = "coalesce(text, '')"
_EDGE = r"[ \t\r\n:;,.!?–—|\-]+"


def _re(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, 'g')"


def _strip(x: str) -> str:
    return _re(x, f"^{_S}+|{_S}+$", "''")


def _inline(x: str) -> str:
    return _strip(_re(_re(x, r"\r\n|\r|\n", "' '"), r"[ \t\f\x0b]+", "' '"))


def _unix(x: str) -> str:
    return _re(x, r"\r\n|\r", "chr(10)")


def _multi(x: str) -> str:
    return _strip(_re(_re(_re(_unix(x), r"[ \t\f\x0b]+", "' '"), r" *\n *", "chr(10)"), r"\n{3,}", "chr(10) || chr(10)"))


def _form(x: str) -> str:
    return _re(_re(f"lower({_strip(x)})", f"{_S}+", "' '"), f"^{_EDGE}|{_EDGE}$", "''")


_LINES = f"lines AS MATERIALIZED (SELECT doc_id, unnest(string_split({_T}, chr(10))) AS line, generate_subscripts(string_split({_T}, chr(10)), 1) - 1 AS pos FROM documents)"


_NAVIGATION = f"(coalesce(text, '') || chr(10) || '  ' || upper([{', '.join(repr(b) for b in X.BOILERPLATE)}][(doc_id % {len(X.BOILERPLATE)} + 1)::INT]) || ' :' || chr(10) || 'Copyright 20' || lpad((doc_id % 30)::VARCHAR, 2, '0') || ' all' || chr(10) || 'printer')"
_BOILER = "(" + " OR ".join([f"f IN ({', '.join(repr(b) for b in X.BOILERPLATE)})", f"regexp_matches(f, '{X.BOILERPLATE_PATTERN}')"]) + ")"
_DEDUP = f"lower({_re(_strip('line'), _S + '+', chr(39) + ' ' + chr(39))})"
_KEPT = "SELECT doc_id, count(*) AS lines, sum(pos)::BIGINT AS places FROM kept GROUP BY doc_id"
_TOK = rf"regexp_extract_all({_T}, '[^\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+')"
_CHARS = f"""WITH win AS (
  SELECT doc_id, unnest(range(0, greatest(ceil((length({_T}) - 1024) / 820.0)::BIGINT, 0) + 1)) * 820 AS start, {_T} AS t FROM documents),
cut AS (SELECT doc_id, start, {_strip("substring(t, start + 1, 1024)")} AS content FROM win),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, start, content FROM cut WHERE content <> '')"""
_SENT = _re(_strip(_T), rf"([.!?]){_S}+", r"'\1' || chr(1)")

_UNITS = f"""s AS (SELECT doc_id, list_filter(list_transform(string_split({_SENT}, chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') AS s FROM documents),
sent AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) AS n FROM s),
tok AS (SELECT doc_id, n, text, {_TOK.replace(_T, "text")} AS t FROM sent),
cut AS (SELECT doc_id, n, 0 AS w, text FROM tok WHERE len(t) <= 128
        UNION ALL SELECT doc_id, n, w, array_to_string(t[w * 128 + 1 : w * 128 + 128], ' ') FROM (SELECT *, unnest(range(0, (len(t) - 1) // 128 + 1)) AS w FROM tok WHERE len(t) > 128)),
units AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, w) - 1 AS unit, text, len({_TOK.replace(_T, "text")})::BIGINT AS tokens FROM cut),
hashed AS (SELECT doc_id, unit, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM (SELECT doc_id, unit, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM units)),
parts AS MATERIALIZED (SELECT doc_id, unit, h % 64 AS at, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM hashed GROUP BY ALL),
len2 AS MATERIALIZED (SELECT doc_id, unit, 1 + coalesce(sum(x * x), 0)::DOUBLE AS q FROM units LEFT JOIN parts USING (doc_id, unit) GROUP BY ALL),
inner_ AS (SELECT a.doc_id, b.unit, sum(a.x * b.x) AS p FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND a.unit + 1 = b.unit AND a.at = b.at GROUP BY ALL),
like_ AS MATERIALIZED (
  SELECT u.*, round((1 + coalesce(p, 0)) / (sqrt(o.q) * sqrt(m.q)), 6) AS similarity
  FROM units u LEFT JOIN len2 m USING (doc_id, unit) LEFT JOIN len2 o ON o.doc_id = u.doc_id AND o.unit + 1 = u.unit LEFT JOIN inner_ i ON i.doc_id = u.doc_id AND i.unit = u.unit)"""
ORACLE = {
    "chunk_strategies": f"""WITH t AS (
        SELECT 0 AS n, doc_id, {_TOK} AS t, 256 AS size, 224 AS step FROM documents
        UNION ALL SELECT 1, doc_id, regexp_extract_all(strip_accents(lower({_T})), '[\\p{{L}}\\p{{N}}]+'), 40, 35 FROM documents
        UNION ALL SELECT 2, doc_id, string_split({_T}, ''), 300, 300 FROM documents WHERE doc_id % 10 = 0 AND {_T} <> ''),
      w AS (SELECT *, unnest(range(0, greatest(ceil((len(t) - size) / step::DOUBLE)::BIGINT, 0) + 1)) AS i FROM t WHERE len(t) > 0)
      SELECT n, doc_id, count(*) AS chunks, md5(string_agg(CASE WHEN n = 2 THEN array_to_string(t[i * step + 1 : i * step + size], '') ELSE array_to_string(t[i * step + 1 : i * step + size], ' ') END, '|' ORDER BY i)) AS digest FROM w GROUP BY n, doc_id""",
    "semantic_units": f"WITH {_UNITS} SELECT doc_id, unit, tokens, similarity FROM like_",
    "chunk_percentile": f"""WITH {_UNITS}, far AS (SELECT *, round(1 - similarity, 6) AS distance FROM like_),
      lim AS (SELECT doc_id, round(quantile_cont(distance, 0.95), 6) AS most FROM far GROUP BY doc_id),
      turned AS (SELECT far.*, coalesce(distance > most, false) AS turn FROM far JOIN lim USING (doc_id)),
      placed AS (SELECT *, sum(turn::BIGINT) OVER (PARTITION BY doc_id ORDER BY unit)::BIGINT AS chunk_index FROM turned)
      SELECT doc_id, chunk_index, count(*) AS units, min(similarity) FILTER (NOT turn) AS least_similarity, md5(string_agg(text, ' ' ORDER BY unit)) AS digest FROM placed GROUP BY ALL""",
    "chunk_semantic": f"""WITH RECURSIVE {_UNITS}, fold AS (
        SELECT doc_id, unit, tokens AS held, 0::BIGINT AS chunk, '' AS why FROM like_ WHERE unit = 0
        UNION ALL
        SELECT u.doc_id, u.unit, CASE WHEN t OR s THEN u.tokens ELSE held + u.tokens END, chunk + (t OR s)::BIGINT, CASE WHEN t THEN 'semantic_threshold' WHEN s THEN 'chunk_size' ELSE '' END
        FROM (SELECT f.*, u.tokens AS more, u.similarity < 0.2 AND held >= 16 AS t, held + u.tokens > 128 AS s FROM fold f JOIN like_ u ON u.doc_id = f.doc_id AND u.unit = f.unit + 1) f
        JOIN like_ u ON u.doc_id = f.doc_id AND u.unit = f.unit + 1),
      made AS (SELECT doc_id, chunk, sum(u.tokens)::BIGINT AS token_count, min(similarity) FILTER (why = '' AND unit > 0) AS least_similarity, min(unit) AS first_unit, max(unit) AS last_unit,
          string_agg(text, ' ' ORDER BY unit) AS content FROM fold JOIN like_ u USING (doc_id, unit) GROUP BY ALL),
      ended AS (SELECT m.*, coalesce(f.why, 'document_end') AS boundary FROM made m LEFT JOIN fold f ON f.doc_id = m.doc_id AND f.unit = m.last_unit + 1),
      once AS (SELECT * FROM ended QUALIFY content IS DISTINCT FROM lag(content) OVER (PARTITION BY doc_id ORDER BY chunk))
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS chunk_index, token_count, boundary, least_similarity, first_unit, last_unit, md5(content) AS digest FROM once""",
    "clean_whitespace_inline": f"SELECT doc_id, md5({_inline(_T)}) AS cleaned FROM documents",
    "clean_whitespace_multiline": f"SELECT doc_id, md5({_multi(_T)}) AS cleaned FROM documents",
    "boilerplate_lines": f"WITH {_LINES.replace(_T, _NAVIGATION)}, formed AS (SELECT {_form('line')} AS f FROM lines) SELECT f AS form, count(*) AS lines FROM formed WHERE f <> '' AND {_BOILER} GROUP BY f",
    "boilerplate_links": f"SELECT page_id, regexp_matches(lower({_strip('url')}), '{X.BOILERPLATE_URL}') AS boilerplate FROM pages",
    "dedup_lines_global": f"WITH {_LINES}, kept AS (SELECT doc_id, pos FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id, {_DEDUP} ORDER BY pos) = 1 OR {_DEDUP} = '') {_KEPT}",
    "dedup_lines_local": f"WITH {_LINES}, kept AS (SELECT doc_id, pos FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id, pos // 8, {_DEDUP} ORDER BY pos) = 1 OR {_DEDUP} = '') {_KEPT}",
    "consecutive_dedup": f"WITH {_LINES}, kept AS (SELECT doc_id, pos FROM lines QUALIFY line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY pos)) {_KEPT}",
    "dedup_documents": f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {_DEDUP.replace('line', _T)}",
    "section_fingerprints": f"WITH {_LINES} SELECT doc_id, sha256(string_agg({_DEDUP}, chr(9246) ORDER BY pos)) AS fingerprint FROM lines GROUP BY doc_id",
    "cleaning_report": f"""WITH {_LINES}, inl AS (SELECT doc_id, pos, {_inline("line")} AS line FROM lines),
      formed AS (SELECT *, {_form("line")} AS f, {_DEDUP} AS k FROM inl), marked AS (SELECT *, f <> '' AND {_BOILER} AS boiler FROM formed),
      again AS (SELECT *, NOT boiler AND k <> '' AND row_number() OVER (PARTITION BY doc_id, boiler, k ORDER BY pos) > 1 AS repeat FROM marked)
      SELECT count(DISTINCT doc_id) AS documents, count(*) AS lines_in, count(*) FILTER (NOT boiler AND NOT repeat) AS lines_out, count(*) FILTER (boiler) AS boilerplate_removed,
        count(*) FILTER (repeat) AS repeats_removed, sum(length(line))::BIGINT AS characters_in, sum(CASE WHEN boiler OR repeat THEN 0 ELSE length(line) END)::BIGINT AS characters_out FROM again""",
    "part_duplicates": f"""WITH {_LINES},
      marked AS (SELECT doc_id, pos, line, {_DEDUP} = '' OR row_number() OVER (PARTITION BY doc_id, {_DEDUP} ORDER BY pos) = 1 AS keep FROM lines),
      items AS (SELECT doc_id, pos, unnest(t) AS item, generate_subscripts(t, 1) AS n FROM (SELECT doc_id, pos, {_TOK.replace(_T, "line")} AS t FROM lines WHERE pos % 8 = 0)),
      gone AS (SELECT doc_id, count(*) FILTER (nth > 1)::BIGINT AS list_items FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, lower(item) ORDER BY pos, n) AS nth FROM items) GROUP BY doc_id)
      SELECT doc_id, count(*) FILTER (NOT keep)::BIGINT AS paragraphs, coalesce(any_value(list_items), 0)::BIGINT AS list_items, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS digest
      FROM marked LEFT JOIN gone USING (doc_id) GROUP BY doc_id""",
    "evaluation_forms": f"""SELECT doc_id, md5({_strip(_re("lower(translate(" + _T + ", '‐‑‒–—−‘’‚“”„', '------' || repeat(chr(39), 3) || repeat(chr(34), 3)))", _S + "+", "' '"))}) AS digest FROM documents""",
    "metadata_clean": f"""WITH m AS (SELECT doc_id, lang || ' ' || source AS title, {_TOK}[1:3] AS w, n_chars, n_chars / 4::DOUBLE AS quarter FROM documents)
      SELECT doc_id, '{{"inner":{{"n":' || n_chars || ',"words":' || to_json(w) || '}},"list":[{{"note":"x y","quarter":' || CASE WHEN quarter = floor(quarter) THEN quarter::BIGINT::VARCHAR ELSE quarter::VARCHAR END || '}}],"title":"' || title || '"}}' AS record,
        w[1] AS word, quarter FROM m""",
    "npy_checks": """SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS dimensions, max(len(embedding))::BIGINT AS width, 0::BIGINT AS unusable FROM embeddings""",
    "sentence_split": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split({_SENT}, chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') AS s FROM documents)
      SELECT doc_id, len(s)::BIGINT AS sentences, md5(array_to_string(s, '|')) AS digest FROM s""",
    "paragraph_split": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split({_re(_unix(_T), r"\n[ \t\x0b\f]*\n[ \t\x0b\f\n]*", "chr(1)")}, chr(1)),
      lambda p: {_strip(_re("p", rf"{_S}*\n{_S}*", "' '"))}), lambda p: p <> '') AS p FROM documents) SELECT doc_id, len(p)::BIGINT AS paragraphs, md5(array_to_string(p, '|')) AS digest FROM s""",
    "token_count": f"SELECT doc_id, len({_TOK})::BIGINT AS tokens FROM documents",
    "technology_forms": "SELECT doc_id, md5("
    + _strip(_re(_re(_re(f"lower({_T})", rf"(?:{_S}|[_\-/\\])+", "' '"), r"[^\p{L}\p{N}_ .+#]", "''"), f"{_S}+", "' '"))
    + ") AS digest FROM documents",
    "url_filename": r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^?#]*)', 1)), '[^a-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS slug FROM pages)
      SELECT page_id, CASE WHEN slug = '' THEN 'page' ELSE slug END || '-' || substr(sha256(url), 1, 12) || '.html' AS filename FROM p""",
    "canonical_names": r"""SELECT page_id, lower(string_split(replace(url, '\', '/'), '/')[-1]) AS name,
      CASE WHEN lower(url) LIKE '%.md' THEN 'markdown' WHEN lower(url) LIKE '%.html' THEN 'html' WHEN lower(url) LIKE '%.pdf' THEN 'pdf' ELSE 'unknown' END AS format FROM pages""",
    "chunk_fixed_char": f"{_CHARS} SELECT doc_id, chunk_index, start, 'fixed__1024__' || doc_id || '__chunk_' || chunk_index AS chunk_id, md5(content) AS digest FROM chunks",
    "chunk_fixed_token": f"""WITH t AS (SELECT doc_id, {_TOK} AS tok FROM documents), w AS (
      SELECT doc_id, tok, unnest(range(0, greatest(ceil((len(tok) - 256) / 224.0)::BIGINT, 0) + 1)) AS chunk_index FROM t WHERE len(tok) > 0),
      c AS (SELECT doc_id, chunk_index, chunk_index * 224 AS start, tok[chunk_index * 224 + 1 : chunk_index * 224 + 256] AS part FROM w)
      SELECT doc_id, chunk_index, start, len(part)::BIGINT AS token_count,
        'chunk_' || sha256(concat_ws('|', doc_id::VARCHAR, 'fixed_size', '256', '32', chunk_index::VARCHAR, array_to_string(part, ' '))) AS chunk_id FROM c""",
    "chunk_statistics": f"""{_CHARS}, m AS (SELECT lang, length(content) AS c, len({_TOK.replace(_T, "content")}) AS w FROM chunks JOIN documents USING (doc_id))
      SELECT lang, count(*) AS chunks, {", ".join(f"round(avg({c}), 4) AS mean_{n}, median({c})::DOUBLE AS median_{n}, min({c})::BIGINT AS min_{n}, max({c})::BIGINT AS max_{n}, round(stddev_pop({c}), 4) AS std_{n}" for n, c in (("chars", "c"), ("words", "w")))} FROM m GROUP BY lang""",
    "chunk_validation": f"""{_CHARS} SELECT count(*) AS chunks, count(*) FILTER ({_strip("content")} = '') AS empty,
      count(*) - count(DISTINCT 'fixed__1024__' || doc_id || '__chunk_' || chunk_index) AS repeated_ids, count(*) FILTER (length(content) > 1024) AS oversized, count(*) FILTER (length(content) < 50) AS short FROM chunks""",
    "html_metadata": r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<html[^>]*\blang=["'']?([A-Za-z-]+)', 1)), '') AS lang,
      nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), '') AS title,
      nullif(trim(regexp_extract(html, '(?is)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)["'']', 1)), '') AS description,
      nullif(trim(regexp_extract(html, '(?is)<link[^>]*rel=["'']canonical["''][^>]*href=["'']([^"'']*)["'']', 1)), '') AS canonical,
      nullif(trim(regexp_extract(html, '(?is)<meta[^>]*name=["'']author["''][^>]*content=["'']([^"'']*)["'']', 1)), '') AS author,
      array_to_string(list_filter(list_transform(string_split(trim(coalesce(regexp_extract(html, '(?is)<meta[^>]*name=["'']keywords["''][^>]*content=["'']([^"'']*)["'']', 1), '')), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords FROM pages""",
    "vector_checks": """SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS dimensions, max(len(embedding))::BIGINT AS width,
      count(*) FILTER (embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS unusable FROM embeddings""",
}
_ROWS_ONLY = ("clean_code_lines", "clean_unicode", "chunk_recursive", "html_sections", "html_tables", "html_links", "markdown_sections", "clean_sections", "section_report", "page_blocks", "page_chunks")
QUERIES = {k: v for k, v in globals().items() if k in ORACLE or k in _ROWS_ONLY}
