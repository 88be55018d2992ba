"""Quality rules with verdicts on hosts, in DataFrame operations only.

Rules are evaluated on each document. Their failures are summed by host, the hosts' failure rates are shrunk with a beta
prior that is fitted to all hosts (method of moments), and hosts whose shrunken rate is too high lose all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import Workspace

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength (alpha + beta), in documents.
PRIOR = (1.0, 1000.0)

_SPACE = r"[\\x20\\x09-\\x0D]+"


def _bind(name: str, value: str, then: str) -> str:
    """``then`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _repeat_words(window: int) -> str:
    """Words in windows found twice or more. Most texts have no two windows of one hash, and so none that is found
    twice; of the others the windows whose hash comes twice are sorted with their words, so that equal ones meet."""
    hashed = ", ".join(f"words[i + {k}]" for k in range(window))
    hashes = f"transform(sequence(0, size(words) - {window}), i -> xxhash64({hashed}))"
    in_order = "array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))"
    twice = "filter({0}, (x, k) -> (k > 0 AND {0}[k - 1].{1} = x.{1}) OR (k < size({0}) - 1 AND {0}[k + 1].{1} = x.{1}))"
    spelled = f"array_sort(transform({twice.format('s', 'h')}, x -> struct(array_join(slice(words, x.i + 1, {window}), ' ') AS w, x.i AS i)))"
    places = f"array_sort(transform({twice.format('c', 'w')}, x -> x.i))"
    covered = f"aggregate(transform(p, (x, k) -> if(k = 0, {window}, least({window}, x - p[k - 1]))), 0, (a, x) -> a + x)"
    exact = _bind("s", in_order, _bind("c", spelled, _bind("p", places, covered)))
    return f"cast(if(size(words) <= {window}, 0, {_bind('h', hashes, f'if(size(array_distinct(h)) = size(h), 0, {exact})')}) AS bigint)"


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", window: int = WINDOW) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row's whole text."""
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"coalesce(cast(`{host_col}` AS string), '') AS host", f"coalesce(cast(`{text_col}` AS string), '') AS t")
    words = rows.selectExpr("doc_id", "host", "t", f"filter(split(t, '{_SPACE}'), w -> w <> '') AS words")
    return words.selectExpr(
        "doc_id", "host", "cast(size(words) AS bigint) AS n_words",
        "cast(aggregate(words, 0L, (a, w) -> a + char_length(w)) AS bigint) AS word_chars",
        "cast(char_length(t) - char_length(translate(t, '#*$%&|<>', '')) AS bigint) AS n_symbols",
        rf"element_at(transform(array(filter(split(t, '\\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')), l -> cast(size(l) - size(array_distinct(l)) AS bigint)), 1) AS n_dup_lines",
        f"{_repeat_words(window)} AS n_repeat_words",
    )


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, host_rate.

    Null and blank texts have no words and fail the base rules. Rows with a null host are one host, ''. Repeated rows
    count each; other columns are not read. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "quality-rules")
    failed = F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {repeat_percent} * n_words")
    counted = ws.save(rule_counts(docs, id_col, text_col, host_col).withColumn("base_failed", failed), "counts")
    hosts = ws.save(counted.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")), "hosts")
    # rates' mean m and variance v over hosts; a beta with these has strength m (1 - m) / v - 1
    moments = hosts.agg(F.avg(F.col("f") / F.col("n")).alias("m"), F.var_pop(F.col("f") / F.col("n")).alias("v"))
    mean, variance = moments.first()
    strength = min(PRIOR[1], max(PRIOR[0], mean * (1 - mean) / variance - 1 if variance else PRIOR[1])) if mean is not None else PRIOR[1]
    rates = hosts.select("host", ((F.col("f") + (mean or 0.0) * strength) / (F.col("n") + strength)).alias("host_rate"))
    rates = ws.save(rates, "rates")
    return counted.join(rates, "host").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"), "host", "host_rate")


SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, host, words, len(words) AS n, t,
         CASE WHEN len(words) > {WINDOW} THEN list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ')) ELSE [] END AS wins FROM w),
e AS (
  SELECT doc_id, win, pos FROM (SELECT doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS pos FROM g)),
dup AS (
  SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prior
  FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS c FROM e) WHERE c > 1),
rep AS (SELECT doc_id, sum(CASE WHEN prior IS NULL THEN {WINDOW} ELSE least({WINDOW}, pos - prior) END) AS r FROM dup GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS d
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (
  SELECT g.doc_id, host, n::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM g LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
flag AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed FROM base),
hosts AS (SELECT host, count(*) AS c, sum(base_failed::INT) AS f FROM flag GROUP BY host),
mom AS (SELECT avg(f / c) AS m, var_pop(f / c) AS v FROM hosts),
prior AS (SELECT m, least({PRIOR[1]}, greatest({PRIOR[0]}, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE {PRIOR[1]} END)) AS k FROM mom),
rates AS (SELECT host, (f + m * k) / (c + k) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND rate <= {MAX_HOST_RATE}) AS kept
FROM flag JOIN rates USING (host)
"""
