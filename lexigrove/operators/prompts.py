"""Messages for a model: instructions in the question's language, the contexts as blocks, and the style asked for.

What a program reads again is fixed: the blocks' form, the languages and the styles. The wording of the instructions is
this library's own and may be replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.text import strip, text_of

#: What a model says when the contexts hold no answer, and is looked for in its answers.
REFUSALS = {
    "en": "I don't know based on the available internal documents.",
    "fr": "Je ne sais pas répondre à cette question à partir des documents internes disponibles.",
    "ar": "لا أعرف بناءً على المستندات الداخلية المتاحة.",
}
LANGUAGES = tuple(REFUSALS)
STYLES = ("concise", "detailed", "expert")

RULES = {
    "en": "Use the contexts below and nothing else. Put the authorized citation of a context, copied exactly, after each statement it supports. If the contexts do not answer the question, say only: ",
    "fr": "N'utilise que les contextes ci-dessous. Place après chaque affirmation la citation autorisée de son contexte, copiée exactement. Si les contextes ne répondent pas, dis seulement : ",
    "ar": "استخدم السياقات أدناه فقط. ضع بعد كل معلومة الاستشهاد المصرح به منسوخاً حرفياً. إذا لم تجب السياقات عن السؤال فقل فقط: ",
}
STYLE_RULES = {
    "en": {"concise": "Answer briefly.", "detailed": "Explain at length, within the evidence.", "expert": "Write for experts, within the evidence."},
    "fr": {"concise": "Réponds brièvement.", "detailed": "Explique en détail, sans dépasser les preuves.", "expert": "Écris pour des experts, sans dépasser les preuves."},
    "ar": {"concise": "أجب بإيجاز.", "detailed": "اشرح بالتفصيل ضمن الأدلة.", "expert": "اكتب للخبراء ضمن الأدلة."},
}


def _by(key: Column, values: dict[str, str], default: str) -> Column:
    out = F.lit(values[default])
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def language_of(c: Column) -> Column:
    """en, ar, or French for anything else."""
    code = F.lower(strip(text_of(c)))
    return F.when(code.isin("en", "ar"), code).otherwise("fr")


def system_message(language: Column, rules: dict[str, str] = RULES) -> Column:
    return F.concat(_by(language, rules, "fr"), _by(language, REFUSALS, "fr"))


def block() -> Column:
    """A row of contexts as the model sees it: lines for format, address, page and score only where they are known."""
    known = lambda label, c, form=None: F.coalesce(F.concat(F.lit(f"{label}: "), F.nullif(F.col(c).cast("string") if form is None else form, F.lit("")), F.lit("\n")), F.lit(""))
    return F.concat(
        F.format_string("--- CONTEXT %d ---\nAUTHORIZED CITATION — COPY EXACTLY:\n[%s:%s]\nSource: %s\nChunk ID: %s\n", "rank", "source", F.col("chunk_id").cast("string"), "source", F.col("chunk_id").cast("string")),
        known("Format", "document_format"), known("URL", "source_url"), known("Page", "page_number"), known("Reranker score", "score", F.when(F.col("score").isNotNull(), F.format_string("%.6f", "score"))),
        F.lit("Content:\n"), strip(text_of("content")),
    )


def messages(questions: DataFrame, contexts: DataFrame, top: int = 2, rules: dict[str, str] = RULES, styles: dict[str, dict[str, str]] = STYLE_RULES) -> DataFrame:
    """questions(query_id, question, language, style) and contexts(query_id, rank, source, chunk_id, content,
    document_format, source_url, page_number, score) to (query_id, system, user) of the first `top` contexts.

    Questions that are blank, of an unknown style or without a context of any content get null messages: they cannot be
    asked.
    """
    blocks = contexts.where((F.col("rank") <= top) & (strip(text_of("content")) != "")).select("query_id", F.struct("rank", block().alias("text")).alias("b"))
    told = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["text"]), "\n\n").alias("contexts"))
    lang = language_of(F.col("language"))
    wanted = F.lower(strip(text_of("style")))
    style = F.lit(None).cast("string")
    for code, words in styles.items():
        for name, line in words.items():
            style = F.when((lang == code) & (wanted == name), line).otherwise(style)
    user = F.concat(F.lit("QUESTION\n"), F.nullif(strip(text_of("question")), F.lit("")), F.lit("\n\nCONTEXTS\n"), F.col("contexts"), F.lit("\n\nINSTRUCTIONS\n"), style)
    asked = questions.join(told, "query_id", "left").select("query_id", lang.alias("lang"), user.alias("user"))
    return asked.select("query_id", F.when(F.col("user").isNotNull(), system_message(F.col("lang"), rules)).alias("system"), "user")


def refused(answer: Column) -> Column:
    """Whether an answer is a refusal in any of the languages."""
    return strip(text_of(answer)).isin(*REFUSALS.values())
