"""Text functions as Catalyst columns: tokens, estimates, hashes, guards, masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------
TOKEN = r"[\p{L}\p{N}]+"
SEARCH_OPERATORS = ("AND", "OR", "NOT", "NEAR")
CHAT_PHRASES = (
    "hi", "hello", "hey", "yo", "hiya", "thanks", "thank you", "thx", "ty", "cheers", "ok", "okay", "cool", "great", "nice", "bye", "goodbye",
    "good morning", "good afternoon", "good evening", "how are you", "what's up", "whats up", "sup", "你好", "嗨", "谢谢", "多谢", "再见", "早上好",
)
FOLLOW_UP_WORDS = ("it", "this", "that", "they", "them", "these", "those", "he", "she", "its", "their")
FOLLOW_UP_PHRASES = ("what about", "tell me more", "go on", "continue", "and then", "the above", "previous", "earlier")
FOLLOW_UP_CJK = ("它", "他", "她", "这个", "那个", "继续", "再说说", "详细说说", "深入")
SQL_WORDS = ("SELECT", "FROM", "WHERE", "JOIN", "GROUP BY", "ORDER BY", "HAVING", "LIMIT", "COUNT", "SUM", "AVG", "MAX", "MIN")
SQL_WORDS_CJK = ("表", "查询", "统计", "汇总", "排名", "多少", "几个")
INJECTION_PHRASES = ("ignore previous", "ignore all previous", "system:", "forget all", "disregard previous", "you are now", "new instructions")
STOPWORDS = (
    "the", "and", "are", "for", "with", "when", "what", "how", "does", "from", "into", "that", "this", "than", "then", "they", "their", "there", "have",
    "has", "had", "been", "being", "during", "about", "against", "between", "called", "known", "only", "very", "similar",
)
# ---------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; diacritics stay."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def _spans(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)


def estimate_splitter(text: Column) -> Column:
    """Splitter's estimate: an ASCII word costs its third, a wide character 2, others 1; 0 only for ''.

    A word's third, rounded up, is the number of its pieces of three letters at most.
    """
    words = F.size(_spans(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x21-\x7F]{1,3}"))
    wide = F.size(_spans(text, r"[\x{800}-\x{10FFFF}]")) * 2 + F.size(_spans(text, r"[\x{80}-\x{7FF}]"))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(F.greatest(F.lit(1), words + wide)).cast("int")


def estimate_chunker(text: Column) -> Column:
    """Chunker's estimate: an ASCII word costs its fourth, any other character 1."""
    return F.size(_spans(text, r"[\x00-\x08\x0B\x0E-\x1F\x21-\x7F]{1,4}|[\x{80}-\x{10FFFF}]")).cast("int")


def estimate_injector(text: Column) -> Column:
    """Injector's estimate: an ASCII word 1, a three-byte character 2, other non-ASCII ones 1."""
    words = F.size(_spans(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x21-\x7F]+"))
    three = F.size(_spans(text, r"[\x{800}-\x{FFFF}]")) * 2
    return (words + three + F.size(_spans(text, r"[\x{80}-\x{7FF}\x{10000}-\x{10FFFF}]"))).cast("int")


def search_words(query: Column) -> Column:
    """A user's full-text query as harmless words: operators, grouping and prefixes removed."""
    bare = F.regexp_replace(F.regexp_replace(query, r"[*()]", ""), r"[\^:]", " ")
    words = F.filter(F.split(bare, r"[ \t\n\r]+"), lambda w: (w != "") & ~w.isin(*SEARCH_OPERATORS) & ~w.startswith("NEAR/"))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[+\-]+", "")), lambda w: w != "")


def or_query(query: Column) -> Column:
    """Quoted words joined by OR; words without a letter or digit are left out."""
    kept = F.filter(search_words(query), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    return F.array_join(F.transform(kept, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit("")), F.lit('"'))), " OR ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(text: Column) -> Column:
    """``sha256:`` and the first 16 bytes of the digest in hex."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 32))


def is_content_hash(value: Column) -> Column:
    return value.rlike("^sha256:[0-9a-f]{32}$")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")


def snippet(text: Column, most: int = 500, head: int = 400, tail: int = 100) -> Column:
    """Head, a mark and tail of a long text."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("[...]"), F.right(text, F.lit(tail)))).otherwise(text)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` UTF-8 bytes."""
    fits = F.octet_length(text) <= most
    letters = F.transform(F.split(text, ""), F.octet_length)
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"))
    step = lambda s, w: F.struct((s["used"] + w).alias("used"), F.when(s["used"] + w <= most, s["n"] + 1).otherwise(s["n"]).alias("n"))
    return F.when(fits, text).otherwise(F.substring(text, F.lit(1), F.aggregate(letters, state, step)["n"]))


def chat_normal(text: Column) -> Column:
    return F.regexp_replace(trim_space(F.lower(text)), r"[.!?, \t\r\n]+$", "")


def is_chat(text: Column) -> Column:
    return chat_normal(text).isin(*CHAT_PHRASES)


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def is_follow_up(text: Column) -> Column:
    """Whether a turn leans on an earlier one: a pronoun as a word, or a cue phrase."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    words = _any_of(low, tuple(f" {w} " for w in FOLLOW_UP_WORDS))
    return words | _any_of(low, FOLLOW_UP_PHRASES) | _any_of(text, FOLLOW_UP_CJK)


def sql_intent(text: Column) -> Column:
    return F.when(_any_of(F.upper(text), SQL_WORDS) | _any_of(text, SQL_WORDS_CJK), "sql").otherwise("semantic")


def has_injection(text: Column) -> Column:
    return _any_of(F.lower(text), INJECTION_PHRASES)


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)))


def keeps_variant(original: Column, variant: Column) -> Column:
    """Whether a rewritten query still shares enough content words with the original."""
    a, b = content_words(original), content_words(variant)
    n, both = F.size(a), F.size(F.array_intersect(a, b))
    ratio = both / n
    enough = F.when(n < 3, True).when(F.size(b) == 0, False).when(n <= 5, both >= 1).when(n <= 8, (both >= 2) | (ratio >= 0.35)).otherwise((both >= 3) | (ratio >= 0.30))
    return (F.lower(original) != F.lower(variant)) & enough


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def glob_match(value: Column, pattern: str) -> Column:
    """One ``*`` at most means anything: exact, prefix, suffix, infix, or one inside."""
    if "*" not in pattern:
        return value == pattern
    if pattern.startswith("*") and pattern.endswith("*") and len(pattern) > 1:
        return F.contains(value, F.lit(pattern[1:-1]))
    head, _, tail = pattern.partition("*")
    if not head or not tail:
        return value.endswith(tail) if not head else value.startswith(head)
    return value.startswith(head) & value.endswith(tail) & (F.length(value) >= len(head) + len(tail))


def wildcard_regex(pattern: str) -> str:
    """A full ``*`` and ``?`` pattern as an anchored regular expression."""
    import re

    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def title_of(filename: Column) -> Column:
    """The name without its last extension; names without one, or all extension, stay."""
    return F.regexp_replace(filename, r"(?s)^(.+)\.[^.]*$", "$1")


def source_uri(host: str, port: int, database: str, table: str, row_id: Column) -> Column:
    return F.concat(F.lit(f"postgres://{host}:{port}/{database}/{table}/"), row_id.cast("string"))


def prompt_language(text: Column) -> Column:
    return F.when(text.rlike("[\\x{4E00}-\\x{9FFF}]"), "zh").otherwise("en")


# --- log redaction ----------------------------------------------------------------------


def mask(kind: str, value: Column, field: str = "") -> Column:
    """One field of a log line by its rule: redact, partial, pii, truncate, hash."""
    digest = F.concat(F.lit("[sha256:"), F.sha2(value, 256), F.lit("]"))
    if kind == "redact":
        return F.lit("****")
    if kind == "partial":
        return F.when(F.length(value) <= 11, F.lit("***")).otherwise(F.concat(F.substring(value, 1, 8), F.lit("***"), F.right(value, F.lit(3))))
    if kind == "pii":
        if field == "email":
            return F.lit("****@***")
        if field == "ip_address":
            octets = F.split(value, r"\.")
            return F.when(F.size(octets) >= 3, F.concat(octets[0], F.lit("."), octets[1], F.lit(".***.***"))).otherwise("***")
        return F.lit("****")
    if kind == "truncate":
        return F.concat(F.substring(value, 1, 50), F.lit("..."), digest) if field == "query_text" else digest
    if kind == "hash":
        return digest
    raise ValueError(f"no such rule: {kind}")
