"""Long-term memory: scoring, contradictions, upgrades, sessions and context."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring, text

KINDS = ("fact", "preference", "event")
NEWEST_FACTS, MENTIONS_FOR_IMMUNITY, IMMUNITY_DAYS, REVOCABLE_BELOW = 5, 2, 30, 0.7
MOST_BYTES = 2000


def rank_memories(rows: DataFrame, now_s: int, top_k: int, invalidated_too: bool = False, by: str | None = None) -> DataFrame:
    """Score by decay, drop invalidated ones unless asked for, best first (ties by block)."""
    if not invalidated_too:
        rows = rows.filter(F.coalesce("status", F.lit("")) != "invalidated")
    score = F.greatest(F.lit(0.0), F.col("raw_score") * scoring.memory_decay(F.col("memory_type"), scoring.age_days(now_s, F.col("created_s"))))
    scored = rows.withColumn("score", F.round(score, 6))
    if by is None:
        return scored.orderBy(F.desc("score"), "block_id").limit(max(0, top_k))
    at = Window.partitionBy(by).orderBy(F.desc("score"), "block_id")
    return scored.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= max(0, top_k))


def repair_json(answer: str) -> str:
    """The JSON inside a fenced or chatty answer: the fence's body, else the outer brackets' part."""
    fence = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    body = fence[1] if fence else answer
    spans = [(body.find(a), body.rfind(b)) for a, b in ("[]", "{}")]
    spans = [s for s in spans if 0 <= s[0] < s[1]]
    return body[min(spans)[0] : min(spans)[1] + 1] if spans else body.strip()


def parse_facts(answer: str) -> list[dict]:
    """Extracted memories: unknown kinds are events, confidence is held to 0..1, textless ones go."""
    try:
        items = json.loads(repair_json(answer))
    except ValueError:
        return []
    out = []
    for item in items if isinstance(items, list) else [items]:
        if isinstance(item, dict) and str(item.get("content", "")).strip():
            try:
                sure = min(1.0, max(0.0, float(item.get("confidence", 0.5))))
            except (TypeError, ValueError):
                sure = 0.5
            kind = item.get("type")
            out.append({"content": str(item["content"]).strip(), "type": kind if kind in KINDS else "event", "confidence": sure})
    return out


def contradiction_pairs(new_facts: DataFrame, facts: DataFrame, n: int = NEWEST_FACTS) -> DataFrame:
    """Each new fact with its user's newest n active facts and preferences: what a judge is asked about."""
    at = Window.partitionBy("user_id").orderBy(F.desc("created_s"), F.desc("block_id"))
    recent = facts.filter((F.col("status") == "active") & F.col("memory_type").isin("fact", "preference")).withColumn("nth", F.row_number().over(at)).filter(F.col("nth") <= n)
    old = recent.select("user_id", F.col("block_id").alias("old_id"), F.col("content").alias("old_content"), "nth")
    return new_facts.select("user_id", F.col("block_id").alias("new_id"), F.col("content").alias("new_content")).join(old, "user_id")


def invalidate(facts: DataFrame, verdicts: DataFrame, at_s: int) -> DataFrame:
    """Facts with the surest contradiction applied; weak ones may be revoked automatically.

    ``verdicts``: old_id, new_id, confidence, reason.
    """
    won = verdicts.groupBy("old_id").agg(F.max(F.struct("confidence", "new_id", "reason")).alias("v"))
    hit = facts.join(won, facts["block_id"] == won["old_id"], "left")
    gone = F.col("v").isNotNull() & (F.col("status") == "active")
    return hit.select(
        *(facts[c] for c in facts.columns if c != "status"), F.when(gone, "invalidated").otherwise(F.col("status")).alias("status"), F.when(gone, F.col("v.new_id")).alias("invalidated_by"),
        F.when(gone, F.lit(at_s)).alias("invalidated_at"), F.when(gone, F.col("v.reason")).alias("reason"), F.when(gone, F.col("v.confidence")).alias("confidence"),
        F.when(gone, "llm_auto").alias("trigger"), F.when(gone, F.col("v.confidence") < REVOCABLE_BELOW).alias("auto_revoke_eligible"),
    )


def revoke(facts: DataFrame, ids: list[int], by: str, reason: str, at_s: int) -> DataFrame:
    hit = F.col("block_id").isin(*ids) & (F.col("status") == "invalidated") if ids else F.lit(False)
    return facts.withColumns({"revoked_at": F.when(hit, F.lit(at_s)), "revoked_by": F.when(hit, F.lit(by)), "revoke_reason": F.when(hit, F.lit(reason)), "status": F.when(hit, "active").otherwise(F.col("status"))})


def delete(facts: DataFrame, ids: list[int], at_s: int) -> DataFrame:
    """Mark as invalidated; ones that already are stay as they were."""
    hit = F.col("block_id").isin(*ids) & (F.col("status") != "invalidated") if ids else F.lit(False)
    return facts.withColumns({"invalidated_at": F.when(hit, F.lit(at_s)), "status": F.when(hit, "invalidated").otherwise(F.col("status"))})


def preferences(mentions: DataFrame, now_s: int) -> DataFrame:
    """Per (user, key): mentions, first time, and whether it is immune: said often enough since lately.

    The first mention must lie in the window; a time that can't be read does.
    """
    said = mentions.groupBy("user_id", "pref_key").agg(F.count("*").alias("mention_count"), F.min("at_s").alias("first_s"))
    lately = F.coalesce(F.lit(now_s) - F.col("first_s") <= IMMUNITY_DAYS * 86400, F.lit(True))
    return said.withColumn("immune", (F.col("mention_count") >= MENTIONS_FOR_IMMUNITY) & lately)


def listing(facts: DataFrame, owner: str, kind: str | None = None, inactive_too: bool = False) -> DataFrame:
    rows = facts.filter(F.col("user_id") == owner)
    if not inactive_too:
        rows = rows.filter(F.col("status").isin("active", "tentative"))
    return rows.filter(F.col("memory_type") == kind) if kind else rows


def edit(facts: DataFrame, block_id: int, owner: str, content: str, expected_s: int, now_s: int, new_id: int) -> DataFrame:
    """A new row for the new wording and the old one invalidated by it; a stale edit changes nothing."""
    if not content.strip() or len(content.encode()) > MOST_BYTES:
        raise ValueError("the content is empty or too long")
    old = (F.col("block_id") == block_id) & (F.col("user_id") == owner) & (F.col("modified_s") == expected_s) & (F.col("status") == "active")
    fresh = facts.filter(old).withColumns({"block_id": F.lit(new_id).cast("long"), "content": F.lit(content), "modified_s": F.lit(now_s).cast("long"), "invalidated_by": F.lit(None).cast("long")})
    changed = facts.withColumns({"invalidated_by": F.when(old, F.lit(new_id).cast("long")).otherwise(F.col("invalidated_by")), "status": F.when(old, "invalidated").otherwise(F.col("status"))})
    return changed.unionByName(fresh)


def touch_sessions(sessions: DataFrame, interactions: DataFrame) -> DataFrame:
    """Sessions with new interactions counted in and their time moved on."""
    news = interactions.groupBy("session_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    joined = sessions.join(news, "session_id", "full_outer")
    return joined.select("session_id", (F.coalesce("interaction_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("interaction_count"), F.greatest("updated_at", "last").alias("updated_at"))


def opt_out_step(state: str | None, action: str, reason: str | None = None) -> str:
    """The opt-out state machine: active and opted_out; anything else is refused."""
    if state is None:
        raise LookupError("no such session")
    if action == "opt_out" and state == "active":
        return "opted_out"
    if action == "revoke" and state == "opted_out":
        if not (reason or "").strip():
            raise ValueError("a revocation needs a reason")
        return "active"
    raise ValueError(f"{action} isn't possible when {state}")


# --- context from recent turns ---------------------------------------------------------


def recent_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each session."""
    at = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= n).drop("_n")


def turn_pairs(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn right after them."""
    at = Window.partitionBy("session_id").orderBy("turn")
    paired = turns.withColumn("next_role", F.lead("role").over(at)).withColumn("answer", F.lead("text").over(at))
    return paired.filter("role = 'user' AND next_role = 'assistant'").select("session_id", "turn", F.col("text").alias("question"), "answer")


def inject(turns: DataFrame, pairs: int, budget: int) -> DataFrame:
    """Pairs from the last 2 * ``pairs`` turns, in order, until the token budget would be passed."""
    found = turn_pairs(recent_turns(turns, 2 * pairs))
    cost = text.estimate_injector(F.concat(F.lit("User: "), F.col("question"), F.lit("\nAssistant: "), F.col("answer"), F.lit("\n")))
    running = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("tokens", cost).withColumn("used", F.sum("tokens").over(running))
    return rows.filter(F.col("used") <= budget)


def extraction_context(turns: DataFrame, size: int) -> DataFrame:
    """Each turn with the text of the last ``size`` turns up to it."""
    at = Window.partitionBy("session_id").orderBy("turn").rowsBetween(1 - size, 0)
    return turns.withColumn("context", F.array_join(F.collect_list(F.concat_ws(": ", "role", "text")).over(at), "\n"))


def effective_status(status: Column) -> Column:
    return F.when(status.isin("active", "tentative"), status).otherwise("hidden")
