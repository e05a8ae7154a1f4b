"""URL filters: fixed host/path rules first, then association rules mined by FP-growth.

A labelled URL is a transaction of its tokens. FP-growth runs over the blocked URLs (the
label's projection) and finds the token sets that enough of them have, whatever tokens stand
between: each frequent token heads a transaction of its URL's more frequent tokens, less those
that every URL of the head has, so a URL of many words that always come together costs little.
Every set found is then counted over all labelled URLs, and those that pass support and
confidence are the rules. An inverted index from each rule's rarest token finds which rules
can have all their tokens in a URL. DataFrame functions and Spark's own FP-growth only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialize

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule needs this share of the labelled URLs, and so many of them, and this confidence.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.005, 25, 0.8
#: The tests take their reference sets from so many neighbours; rules join any tokens of a URL.
TOGETHER = 5


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def base_and_rest(url: Column) -> tuple[Column, Column]:
    """Tokens of every URL (host, its last two labels, path depth, extension, fragment), and the others in order.

    The others are the host's further labels, path words and names in the query. Numbers are
    one token, so that page numbers don't each count as a word. No token is there twice.
    """
    host, path = host_of(url), path_of(url)
    part = lambda kind: lambda x: F.concat(F.lit(kind), F.regexp_replace(x, r"^\d+$", "0"))
    full = lambda x: F.length(x) > 0
    segments = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/"), full)
    names = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), 1)
    labels = F.transform(F.reverse(F.filter(F.split(host, r"\."), full)), part("name:"))
    some = F.array(
        F.concat(F.lit("host:"), host), F.concat(F.lit("depth:"), F.size(segments).cast("string")),
        F.concat(F.lit("ext:"), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.when(F.contains(url, F.lit("#")), F.lit("fragment")).otherwise(F.lit("whole")),
    )
    base = F.array_distinct(F.concat(some, F.slice(labels, 1, 2)))
    return base, F.array_except(F.concat(F.slice(labels, 3, 1 << 20), F.transform(segments, part("dir:")), F.transform(names, part("query:"))), base)


def tokens(url: Column) -> Column:
    return F.concat(*base_and_rest(url))


RULE_SCHEMA = "antecedent array<string>, confidence double, support double, lift double, token string"


def frequent_sets(words: DataFrame, least: int) -> DataFrame:
    """antecedent (sorted): token sets that ``least`` blocked URLs have. ``words`` (row, tokens, n, n_blocked).

    Left out are sets with two tokens of which the set's rarest is never without the other:
    the set less that other has the same URLs, so no rule needs it. A set is found in the
    transactions of its rarest token, its head; items carry the head, so sets of different
    heads don't mix and each URL counts once for each.
    """
    summed = (F.sum("n").alias("n"), F.sum("n_blocked").alias("n_blocked"))
    often = words.select(F.explode("tokens").alias("token"), "n", "n_blocked").groupBy("token").agg(*summed).filter(F.col("n_blocked") >= least)
    often = materialize(often.select("token", F.col("n").alias("times")), "url-often")
    held = words.filter("n_blocked > 0").select("row", "n_blocked", F.explode("tokens").alias("token"))
    rows = materialize(_by_times(held.join(often, "token"), "row", "n_blocked"), "url-frequent")
    pairs = _pairs(rows).groupBy("head", "token").agg(F.sum("n_blocked").alias("n_blocked")).filter(F.col("n_blocked") >= least)
    pairs = materialize(pairs.select("head", "token"), "url-pairs")
    # how often a frequent pair is in any labelled URL tells whether its head has the other always
    all_rows = words.select("row", "n", F.explode("tokens").alias("token"))
    both = _pairs(_by_times(all_rows.join(often, "token"), "row", "n")).join(pairs, ["head", "token"]).groupBy("head", "token").agg(F.sum("n").alias("n"))
    both = both.join(often.select(F.col("token").alias("head"), "times"), "head").filter(F.col("n") < F.col("times"))
    both = materialize(both.select("head", "token"), "url-free-pairs")
    item = F.concat(F.hex(F.encode("head", "utf-8")), F.lit(" "), F.col("token"))
    baskets = _pairs(rows).join(both, ["head", "token"]).groupBy("row", "head", "n_blocked").agg(F.collect_list(item).alias("items"))
    baskets = materialize(baskets.select("items", F.explode(F.sequence(F.lit(1).cast("long"), "n_blocked"))).select("items"), "url-baskets")
    alone = often.select(F.array("token").alias("antecedent"))
    n = baskets.count()
    if n < least:
        return alone
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n)).fit(baskets).freqItemsets
    head = F.decode(F.unhex(F.substring_index(F.col("items")[0], " ", 1)), "utf-8")
    tokens_ = F.transform("items", lambda t: F.regexp_replace(t, r"^[0-9A-F]* ", ""))
    return alone.unionByName(sets.select(F.array_sort(F.array_append(tokens_, head)).alias("antecedent")))


def _by_times(held: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and held, the tokens of a row (token, times) from rare to frequent."""
    return held.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("times", "token")))["token"].alias("held"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Every two tokens (head, token) of ``held``, the rarer one first, beside the other columns."""
    heads = rows.select("*", F.posexplode("held").alias("at", "head"))
    return heads.withColumn("token", F.explode(F.slice("held", F.col("at") + 2, F.size("held")))).drop("held", "at")


def indexed(sets: DataFrame, words: DataFrame) -> DataFrame:
    """``sets`` with the token to look them up by: the one that fewest rows of ``words`` (tokens, n) have."""
    times = materialize(words.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("times")), "url-times")
    found = sets.select("antecedent", F.explode("antecedent").alias("token")).join(times, "token", "left")
    rarest = found.groupBy("antecedent").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token")).alias("rarest"))
    return sets.join(rarest.select("antecedent", F.col("rarest.token").alias("token")), "antecedent")


def fitting(words: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``words`` (tokens, ...) beside the sets of ``index`` (antecedent, token, ...) that they hold whole."""
    asked = words.withColumn("token", F.explode("tokens")).join(index, "token")
    return asked.filter(F.size(F.array_except("antecedent", "tokens")) == 0)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """antecedent (sorted), confidence, support, lift, token of the rules that end in a block.

    ``labelled`` (url, blocked boolean); rows with a null url or label teach nothing. Support
    also asks for ``MIN_COUNT`` URLs: with few labels any subset of a URL would be frequent.
    A rule is left out if one with a token less is as sure, for that one fits wherever it does.
    ``token`` is the rule's rarest.
    """
    base, rest = base_and_rest(F.col("url"))
    known = labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select(base.alias("base"), rest.alias("rest"), "blocked")
    known = materialize(known, "url-labelled")
    n, n_blocked = known.agg(F.count("*"), F.count(F.when(F.col("blocked"), 1))).first()
    least = max(MIN_COUNT, int(-(-min_support * n // 1)))
    if n_blocked < least:
        return labelled.sparkSession.createDataFrame([], RULE_SCHEMA)
    words = known.groupBy(F.concat("base", "rest").alias("tokens")).agg(F.count("*").alias("n"), F.count(F.when(F.col("blocked"), 1)).alias("n_blocked"))
    words = materialize(words.withColumn("row", F.monotonically_increasing_id()), "url-words")
    sets = materialize(indexed(frequent_sets(words, least), words), "url-sets")
    counted = fitting(words, sets).groupBy("antecedent", "token").agg(F.sum("n").alias("n"), F.sum("n_blocked").alias("n_blocked"))
    confidence = F.col("n_blocked") / F.col("n")
    sure = counted.filter((F.col("n_blocked") >= least) & (confidence >= min_confidence))
    sure = sure.select("antecedent", confidence.alias("confidence"), (F.col("n_blocked") / n).alias("support"), (confidence * n / n_blocked).alias("lift"), "token")
    sure = materialize(sure, "url-sure")
    fewer = sure.select("antecedent", "confidence", F.explode("antecedent").alias("t")).select(F.array_remove("antecedent", F.col("t")).alias("less"), "antecedent", "confidence")
    shorter = sure.select(F.col("antecedent").alias("less"), F.col("confidence").alias("sure"))
    needless = fewer.join(shorter, "less").filter(F.col("sure") >= F.col("confidence")).select("antecedent").distinct()
    return sure.join(needless, "antecedent", "left_anti").select("antecedent", "confidence", "support", "lift", "token")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, mined (tokens of the surest rule that fits), confidence; urls without one are left out."""
    index = rules.select("antecedent", "confidence", "token")
    words = urls.filter(F.col("url").isNotNull()).select("url").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    hits = fitting(words, index).select("url", F.struct("confidence", -F.size("antecedent"), F.array_join("antecedent", " ").alias("mined")).alias("rule"))
    return hits.groupBy("url").agg(F.max("rule").alias("best")).select("url", "best.mined", "best.confidence")


def judged(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the mined rule that blocks, else null).

    Labels belong to the page whose page_id is their doc_id; toxic or low quality is a block.
    A page without a fixed rule is blocked if a mined rule fits, else allowed. A null url or
    one without ``://`` has an empty host and path. Repeated rows are judged alike; other
    columns are ignored; an empty table gives no rows. A long url is read whole.
    """
    bad = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), True).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), False))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("blocked"))
    some = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rules = materialize(mine(some.join(known, "page_id").select("url", "blocked"), min_support, min_confidence), "url-rules")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fixed_rule(host, path)
    # written first: a join of two plain exchanges lets Spark split a hot url's rows
    out = some.join(materialize(matches(some, rules), "url-matches"), "url", "left")
    fallback = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, fallback).alias("verdict"), "mined")
