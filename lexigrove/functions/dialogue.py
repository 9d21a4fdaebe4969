"""Language, follow-up and intent of a message, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.functions.text import strip, text_of

#: Letters, contractions and words that mark a language.
ARABIC = "[؀-ۿ]"
FRENCH_LETTERS = "[àâçéèêëîïôùûüÿœæÀÂÇÉÈÊËÎÏÔÙÛÜŸŒÆ]"
FRENCH_SHORT = r"(?:^|[^\p{L}\p{N}_])(?:[cdjlmnstCDJLMNST]|[qQ][uU])['’][a-zA-Zà-ÿÀ-ß]"
FRENCH_WORDS = (
    "au aux avec ce ces cette cinq dans de des du elle en est et ils je la le les mais nous ou par pas plus pour que quel quelle "
    "quelles quels qui sans se ses sont sur tu un une vous quoi comment pourquoi bonjour bonsoir salut"
).split()
FRENCH_GREETINGS = ("bonjour", "bonsoir", "salut")
#: What begins or refers back in a message that depends on the one before.
DEPENDENT = (
    "^(?:and|also|but|why|how|what about|more|explain more|et|mais|aussi|pourquoi|comment|et concernant|explique|plus de|"
    "وماذا|ماذا عن|ولماذا|لماذا|كيف|اشرح|المزيد)(?:[^\\p{L}\\p{N}_]|$)"
)
REFERENCE = "(?:^|[^\\p{L}\\p{N}_])(?:it|this|that|these|those|them|its|cela|ça|ceci|celui|celle|eux|هذا|هذه|ذلك|تلك|عنها|عنه)(?:[^\\p{L}\\p{N}_]|$)"
GREETING = (
    "^(?:hi|hello|hey|good[ \\t\\r\\n]+(?:morning|afternoon|evening)|bonjour|bonsoir|salut|coucou|"
    "مرحبا|مرحباً|أهلا|اهلا|السلام[ \\t\\r\\n]+عليكم)[!,.؟ \\t\\r\\n]*$"
)
GREETING_REPLY = {
    "fr": "Bonjour ! Comment puis-je vous aider avec votre base de connaissances ?",
    "ar": "مرحباً! كيف يمكنني مساعدتك في قاعدة المعرفة؟",
    "en": "Hello! How can I help you with your internal knowledge base?",
}


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-zA-ZÀ-ÿŒœÆæ]+)"), F.lit(1)))


def language(c) -> Column:
    text = strip(text_of(c))
    words = _words(text)
    marked = F.size(F.array_intersect(words, F.array(*map(F.lit, FRENCH_WORDS)))) >= 2
    greeted = F.size(F.array_intersect(words, F.array(*map(F.lit, FRENCH_GREETINGS)))) > 0
    french = F.struct(F.lit("fr").alias("language"), F.lit(0.9).alias("confidence"))
    return (
        F.when(text.rlike(ARABIC), F.struct(F.lit("ar").alias("language"), F.lit(0.99).alias("confidence")))
        .when(text.rlike(FRENCH_LETTERS) | text.rlike(FRENCH_SHORT), french)
        .when(marked | greeted, F.struct(F.lit("fr").alias("language"), F.lit(0.8).alias("confidence")))
        .otherwise(F.struct(F.lit("en").alias("language"), F.lit(0.6).alias("confidence")))
    )


def is_follow_up(c, has_history: Column) -> Column:
    text = F.lower(strip(text_of(c)))
    short = (F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))) <= 2) & text.endswith("?")
    return has_history & (text != "") & (text.rlike(DEPENDENT) | text.rlike(REFERENCE) | short)


def intent(c, has_history: Column) -> Column:
    return F.when(F.lower(strip(text_of(c))).rlike(GREETING), "GREETING").when(is_follow_up(c, has_history), "FOLLOW_UP").otherwise("KNOWLEDGE_QUERY")


def greeting_reply(lang: Column) -> Column:
    return F.when(lang == "fr", GREETING_REPLY["fr"]).when(lang == "ar", GREETING_REPLY["ar"]).otherwise(GREETING_REPLY["en"])
