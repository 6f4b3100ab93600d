"""Quality rules with verdicts over hosts. DataFrame functions only.

Each text gets counts and rule failures of its own. Failures are added up for each host (here: the source of a
document), the host's failure rate is shrunk with a beta prior fitted to all hosts by moments, and the host's verdict is
joined back: a host whose posterior rate less Z deviations is above MAX_RATE loses all its documents, one whose
posterior mean is above SUSPECT_RATE loses those that fail a softer rule. A text that fails a base rule is never kept.

Null and empty texts have no words and fail. Texts are taken whole. A null host counts as one host of its own. Repeated
rows count each; an empty table gives an empty result; other columns are never read by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.llm._shared import lookup, materialize, read, words

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
#: Softer rules: symbols of these against characters of words, repeated lines against words, in per cent.
SYMBOLS, MAX_SYMBOLS, MAX_DUP_LINES = "#*$%&|<>", 10, 10
MAX_RATE, SUSPECT_RATE, Z = 0.75, 0.5, 1.645


def measured(df: DataFrame, text: Column) -> DataFrame:
    """df with the columns n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; df must not have these, nor _-names."""
    clean = F.coalesce(text, F.lit(""))
    out = df.withColumns({"_w": words(text), "_lines": F.filter(F.split(clean, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), "n_symbols": (F.length(clean) - F.length(F.translate(clean, SYMBOLS, ""))).cast("long")})
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.when(F.size("_w") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))),
    })
    # Only texts with some window twice go on: their windows sorted by hash, those with an equal neighbour, their places.
    out = out.withColumn("_sorted", F.when(F.size("_hashes") > F.size(F.array_distinct("_hashes")), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_sorted", lambda x, k: F.coalesce(F.get("_sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("from")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["from"])).alias("n"), x.alias("from")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_w", "_lines", "_hashes", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def soft_failed() -> Column:
    return (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_words"))


def host_verdicts(failures: DataFrame) -> DataFrame:
    """host, rate (posterior mean), low (its lower bound), from rows (host, failed boolean)."""
    hosts = materialize(failures.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("failed").cast("double")).alias("bad")), "hosts")
    n, bad, k, nn, bb = hosts.agg(F.sum("n"), F.sum("bad"), F.count("*"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("bad") * F.col("bad") / F.col("n"))).first()
    mean, strength = prior(n or 0.0, bad or 0.0, k, nn or 0.0, bb or 0.0)
    rate = (F.col("bad") + strength * mean) / (F.col("n") + strength)
    out = hosts.select("host", rate.alias("rate"), (F.col("n") + strength + 1).alias("size"))
    return out.select("host", "rate", (F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("size"))).alias("low"))


def prior(n: float, bad: float, units: int, nn: float, bb: float) -> tuple[float, float]:
    """Mean and strength of the beta prior, by moments; the strength is 1 to 10,000 documents."""
    if not n:
        return 0.0, 1.0
    mean = bad / n
    noise = (units - 1) * mean * (1 - mean)
    room = (n - nn / n - (units - 1)) * mean * (1 - mean)
    within = min(1.0, (bb - bad * bad / n - noise) / room) if room > 0 else 0.0
    return mean, min(10_000.0, max(1.0, 1 / within - 1)) if within > 0 else 10_000.0


def judged(df: DataFrame, host: Column, text: Column, carried: list[Column]) -> DataFrame:
    """carried columns, the counts, base_failed and kept, for each row. Counts are written out once, as they are read twice."""
    rows = measured(df.select(*carried, F.coalesce(host, F.lit("\0null")).alias("host"), text.alias("_text")), F.col("_text")).drop("_text")
    rows = materialize(rows.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed()), "measured")
    verdicts = host_verdicts(rows.select("host", (F.col("base_failed") | F.col("soft_failed")).alias("failed")))
    out = lookup(rows, verdicts, ["host"])
    kept = ~F.col("base_failed") & (F.col("low") <= MAX_RATE) & ~(F.col("soft_failed") & (F.col("rate") > SUSPECT_RATE))
    return out.withColumn("kept", kept).drop("host", "soft_failed", "rate", "low")


def quality(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, counts, base_failed, kept."""
    out = judged(df, F.col(host_col), F.col(text_col), [F.col(id_col).alias("_id")])
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(df: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of df that are kept, with their columns."""
    out = judged(df, F.col(host_col), F.col(text_col), [F.struct(*[F.col(c) for c in df.columns]).alias("_row")])
    return out.where("kept").select("_row.*")


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


_WS = "[\\x20\\x09-\\x0D]+"
OP8_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
c AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM w),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW}),
v AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS v FROM g),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM v) WHERE n > 1),
r AS (SELECT doc_id, sum(least({WINDOW}, coalesce(i - before, {WINDOW})))::BIGINT AS n_repeat_words FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p) GROUP BY doc_id),
f AS (
  SELECT c.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT} * n_words AS base_failed,
    100 * n_symbols > {MAX_SYMBOLS} * word_chars OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_words AS soft_failed FROM c LEFT JOIN r USING (doc_id)),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed OR soft_failed THEN 1 ELSE 0 END)::DOUBLE AS bad FROM f GROUP BY host),
m AS (SELECT sum(bad) / sum(n) AS mean, count(*) - 1 AS free, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS squares FROM h),
s AS (SELECT mean, CASE WHEN room * mean * (1 - mean) > 0 THEN least(1.0::DOUBLE, (squares - free * mean * (1 - mean)) / (room * mean * (1 - mean))) ELSE 0.0::DOUBLE END AS within FROM m),
k AS (SELECT mean, CASE WHEN within > 0 THEN least(10000.0::DOUBLE, greatest(1.0::DOUBLE, 1 / within - 1)) ELSE 10000.0::DOUBLE END AS strength FROM s),
q AS (SELECT host, (bad + strength * mean) / (n + strength) AS rate, n + strength + 1 AS size FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate - {Z} * sqrt(rate * (1 - rate) / size) <= {MAX_RATE} AND NOT (soft_failed AND rate > {SUSPECT_RATE}) AS kept
FROM f JOIN q USING (host)
"""
