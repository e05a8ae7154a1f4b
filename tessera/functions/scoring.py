"""Numeric functions: similarity, decay, blends, levels, costs and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------
LEVEL_SCORES = (0.2, 0.4, 0.6, 0.8, 1.0)
RETRY_SECONDS = (60, 300, 900, 3600, 21600)
DECAY_PER_DAY = 0.01
RESERVED_TOKENS = 3
ERROR_CLASSES = (
    ("LLM_TRANSPORT", "llm_transport"), ("LLM_RATE_LIMIT", "quota_exceeded"), ("LLM_BAD_BODY", "invalid_response"), ("LLM_HTTP", "llm_http"),
    ("LLM_TIMEOUT", "llm_timeout"), ("LLM_CIRCUIT_OPEN", "circuit_open"), ("LLM_QUOTA", "quota_exceeded"), ("INVALID_RESPONSE", "invalid_response"),
)
RERANK_WEIGHT, FUSION_WEIGHT, QUALITY_WEIGHT = 0.7, 0.3, 0.2
# ---------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def bad_vector(v: Column) -> Column:
    """Null or empty, not finite somewhere, or all zero."""
    x = F.transform(v, lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(v) <= 0) | odd | F.forall(x, lambda c: c == 0.0), F.lit(True))


def similarity_of_distance(d: Column) -> Column:
    return 1 / (1 + d)


def score_of_rank(rank: Column) -> Column:
    """A full-text rank (lower is better, negative) as a score in (0, 1]."""
    return 1 / (1 + F.greatest(F.lit(0.0), -rank))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def age_days(now_s: int, at_s: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.lit(now_s) - at_s) / 86400)).cast("int")


def decay(days: Column, per_day: float = DECAY_PER_DAY, floor: float = 0.0) -> Column:
    return F.greatest(F.exp(-F.lit(per_day) * days), F.lit(floor))


def memory_decay(kind: Column, days: Column) -> Column:
    """Facts and preferences don't age; events, and kinds unknown, do."""
    return F.when(F.coalesce(kind, F.lit("")).isin("fact", "preference"), F.lit(1.0)).otherwise(decay(days))


def level_score(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVEL_SCORES)), F.greatest(F.lit(1), F.least(F.lit(5), level + 1)))


def effective_quality(anomalous: Column, enriched: Column, semantic: Column) -> Column:
    return F.when(anomalous, 0.0).otherwise(F.coalesce(enriched, semantic))


def with_quality(score: Column, quality: Column, weight: float = QUALITY_WEIGHT) -> Column:
    """Up to ``weight / 2`` more or less, around a quality of one half; null changes nothing."""
    return score * (1 + F.lit(weight) * (F.coalesce(quality, F.lit(0.5)) - 0.5))


def blend(rerank: Column, fused: Column) -> Column:
    return F.lit(RERANK_WEIGHT) * rerank + F.lit(FUSION_WEIGHT) * fused


def cost_micro_usd(tokens_in: Column, tokens_out: Column, in_per_1k: int, out_per_1k: int) -> Column:
    """Micro-dollars, rounded down, from prices in micro-dollars for a thousand tokens."""
    spent = F.greatest(F.lit(0), tokens_in).cast("long") * in_per_1k + F.greatest(F.lit(0), tokens_out).cast("long") * out_per_1k
    return ((spent - F.pmod(spent, F.lit(1000))) / 1000).cast("long")


def retry_delay(attempts: Column) -> Column:
    """Seconds until the next try after so many attempts (from 0)."""
    return F.element_at(F.array(*map(F.lit, RETRY_SECONDS)), F.greatest(F.lit(0), F.least(F.lit(len(RETRY_SECONDS) - 1), attempts)) + 1)


def cleanup_backoff(attempt: Column) -> Column:
    """Seconds to wait after the first, second and third failure; 0: no more tries."""
    return F.when(attempt == 1, 60).when(attempt == 2, 300).when(attempt == 3, 900).otherwise(0)


def processing_level(parser: Column, enricher: Column, captioned: Column, is_metadata: Column) -> Column:
    """0-4 by the best of what parsed, enriched and captioned a block; metadata blocks are 0."""
    by_parser = F.when(parser.isin("docling", "docling+paddleocr"), 2).when(parser == "paddleocr", 1).otherwise(0)
    by_enricher = F.when(enricher == "llm", 4).when(enricher.isin("contextual", "hype"), 3).otherwise(0)
    return F.when(is_metadata, 0).otherwise(F.greatest(by_parser, by_enricher, F.when(captioned, 4).otherwise(0)))


def next_daily_run(now_s: Column, hour: int = 2) -> Column:
    """Seconds of the next ``hour`` o'clock UTC, never now itself."""
    return now_s + 86400 - F.pmod(now_s - hour * 3600, F.lit(86400))


def is_sealed(vectors: Column, size_bytes: Column, most_vectors: int, most_bytes: int) -> Column:
    return (vectors >= most_vectors) | (size_bytes >= most_bytes)


def error_class(message: Column) -> Column:
    """A short reason for a degraded answer; transport errors come before the deadline they cause."""
    reason = F.lit("llm_error")
    for token, name in reversed(ERROR_CLASSES):
        reason = F.when(F.contains(message, F.lit(token)), name).otherwise(reason)
    return reason


def passage_budget(query_tokens: Column, longest: int = 512) -> Column:
    return F.greatest(F.lit(0), F.lit(longest) - query_tokens - RESERVED_TOKENS)


def passage_length(query_tokens: Column, passage_tokens: Column, longest: int = 512) -> Column:
    return F.when(passage_tokens <= passage_budget(query_tokens, longest), "normal").when(passage_tokens > 4 * longest, "extremely_long").otherwise("truncated")
