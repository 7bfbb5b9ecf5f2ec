"""URL filter: rules, and for urls without one a naive Bayes verdict on segmented names.

Host names run words together. A unigram Viterbi splits them, with word counts of all page
titles and url paths. Counts, substrings of distinct name pieces and their matches meet by
joins, so no vocabulary is broadcast. Words of every length are counted; a part of a split may be as
long as a host label can be. Multinomial naive Bayes then weighs host words and path words; it learns
from the urls that a rule decides, and from ``seeds`` where a caller names words that count
``SEED_WEIGHT`` times for ``block`` (none by default). Hosts and paths are scored once each, however many pages they have.

Rules (action, host and path): a rule fits its host and all subdomains if the url's path starts
with the rule's; the longest rule wins, of equal length the alphabetically last.

Defined results: a null url or one without ``://`` has an empty host and path, and no rule fits.
An undecided score (0) allows. Repeated rows are judged each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.session import materialise

SEED_WEIGHT = 50
LABEL = 63  # characters of a host label at most (fixed by the name system), so of any word in one
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(size, rule, action) of the longest rule (action, host/path) that fits; null if none does."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,action:string>")
    made = []
    for action, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        made.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.array_max(F.array(*made))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over titles and url paths of all pages."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1)
    words = pages.select(F.explode(F.concat(_words(title), _words(parsed(F.col("url"))[1]))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(piece: str, matches: list[dict], total: int) -> list[str]:
    """The likeliest split of ``piece`` into counted words; a part without a count costs ten times more for each character."""
    known = {(m["start"], m["size"]): m["n"] for m in matches}
    total = max(total, 1)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(piece) + 1):
        options = []
        for start in range(max(0, end - LABEL), end):
            size = end - start
            n = known.get((start, size))
            cost = math.log(n / total) if n else -math.log(total) - size * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(max(options))
    out, end = [], len(piece)
    while end:
        out.append(piece[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def _split(total: int):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(pieces: pa.Array, matches: pa.Array) -> pa.Array:
        return pa.array([viterbi(p, m or [], total) for p, m in zip(pieces.to_pylist(), matches.to_pylist())], pa.list_(pa.string()))

    return split


def segmented(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words) for distinct lower-case name pieces."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = pieces.select("piece", F.explode(F.sequence(F.lit(0), F.length("piece") - 1)).alias("start"))
    longest = F.least(F.lit(LABEL), F.length("piece") - F.col("start"))
    parts = starts.select("piece", "start", F.explode(F.sequence(F.lit(1), longest)).alias("size"))
    parts = parts.withColumn("word", F.substring("piece", F.col("start") + 1, F.col("size")))
    met = parts.join(counts, "word").groupBy("piece").agg(F.collect_list(F.struct("start", "size", "n")).alias("matches"))
    return pieces.join(met, "piece", "left").select("piece", _split(total)(F.col("piece"), F.col("matches")).alias("words"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], seeds: Sequence[str] = (), smoothing: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row; a score above 0 speaks for ``block``."""
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    taught = [F.sum((F.col("found.action") == action).cast("bigint")).alias(action) for action in ("block", "allow")]
    hosts = materialise(rows.groupBy("host").agg(*taught).fillna(0), "hosts")
    paths = materialise(rows.groupBy("path").agg(*taught).fillna(0), "paths")
    pieces = hosts.select("host", "block", "allow", F.posexplode_outer(_words(F.col("host"))).alias("place", "piece"))
    words = segmented(pieces.where("piece is not null").select("piece").distinct(), materialise(word_counts(pages), "counts"))
    host_words = pieces.join(words, "piece", "left").select("host", "block", "allow", F.explode("words").alias("word"))
    host_words = materialise(host_words.select("host", "block", "allow", F.concat(F.lit("h:"), "word").alias("word")), "host_words")
    path_words = paths.select("path", "block", "allow", F.explode(_words(F.col("path"))).alias("word"))
    path_words = path_words.select("path", "block", "allow", F.concat(F.lit("p:"), F.regexp_replace("word", "^[0-9]+$", "#")).alias("word"))
    counted = host_words.select("word", "block", "allow").unionByName(path_words.select("word", "block", "allow"))
    counted = materialise(counted.groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "word_classes")
    block, allow, size = (x or 0 for x in counted.agg(F.sum("block"), F.sum("allow"), F.count(F.lit(1))).first())
    # Seeds raise their own count only, not the sums; a word of neither class says nothing.
    more = F.when(F.substring("word", 3, 1 << 20).isin(*seeds), SEED_WEIGHT).otherwise(0) if seeds else F.lit(0)
    counted = counted.withColumn("block", F.col("block") + more).where("block + allow > 0")
    weight = (F.log((F.col("block") + smoothing) / (block + smoothing * size)) - F.log((F.col("allow") + smoothing) / (allow + smoothing * size))).alias("weight")
    weights = counted.select("word", weight)
    n_block, n_allow = (x or 0 for x in hosts.agg(F.sum("block"), F.sum("allow")).first())
    prior = math.log((n_block + 1) / (n_allow + 1))
    add = lambda r, name: r.select(name, "word").join(weights, "word").groupBy(name).agg(F.sum("weight").alias(f"{name}_score"))
    scored = rows.join(add(host_words, "host"), "host", "left").join(add(path_words, "path"), "path", "left").fillna(0.0, ["host_score", "path_score"])
    score = F.lit(prior) + F.col("host_score") + F.col("path_score")
    verdict = F.coalesce("found.action", F.when(score > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))
