"""URL filter: rules first, then words inside host names.

Host labels are split into words by a unigram Viterbi search; the unigram counts come from the text of all
pages.  A multinomial naive Bayes model then scores the words of host and path, each as often as it
occurs.  Its training labels are the pages themselves: a url with a word of the seed list is an example of an unwanted one, all others are
examples of wanted ones.  The seeds label only: they are no features, so a url is judged by the words around them,
and one without any may be blocked.  The counts cover all pages and all words.

Neither table of counts leaves Spark.  Hosts and urls are dealt to blocks; a block gets the counts of the words
that may be in its hosts, and the odds of its tokens, each once.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare

LONGEST = 24
BLOCK_ROWS = 1024  # distinct hosts, or urls, that share one table of counts
_RUN = re.compile(r"[a-z]{2,}")
# Words of unwanted sites.
SEEDS = ("adult", "ads", "bet", "bets", "betting", "bingo", "bonus", "casino", "cheap", "clickbait", "crypto", "escort", "gambling",
         "jackpot", "loan", "loans", "lottery", "nude", "payday", "pharmacy", "pills", "poker", "porn", "replica", "sex", "slots", "spam",
         "track", "tracker", "tracking", "viagra", "warez", "xxx")
# Site rules (verdict, host, start of the path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "net", "/fr/"))


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str) -> Column:
    return _lower_ascii(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: str, path: str, rules) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest rule that fits; null without one."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def labels_of(host: str) -> list[str]:
    """Parts of a host that are split into words: all but the top domain, where there is more."""
    sites = host.split(".")
    return ".".join(sites[:-1] if len(sites) > 1 else sites).replace("_", "-").replace("-", ".").split(".")


def possible_words(host: str) -> set[str]:
    """All words of the unigram table that a split of the host may have."""
    return {run[i:j] for label in labels_of(host) for run in _RUN.findall(label)
            for i in range(len(run) - 1) for j in range(i + 2, min(i + LONGEST, len(run)) + 1)}


def _blocks(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS))


def segment(label: str, cost: dict[str, float], total: float) -> list[str]:
    """Cheapest split of a label into words; an unknown word costs more the longer it is."""
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        found = None
        for start in range(max(0, end - LONGEST), end):
            word = label[start:end]
            c = best[start] + cost.get(word, total + 3.0 * (end - start))
            if found is None or c < found[0]:
                found = (c, start)
        best.append(found[0])
        back.append(found[1])
    out, end = [], len(label)
    while end:
        out.append(label[back[end]:end])
        end = back[end]
    return out[::-1]


def judge_urls(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               rules=RULES, seeds=SEEDS) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null without one), verdict (the rule's, else the model's), score (log odds
    of block) and words (of the host).

    A null url or one without :// has an empty host and path, fits no rule and is judged by the class sizes alone.  Repeated rows are
    judged alike; an empty table gives an empty result; other columns are ignored.
    """
    prepare(spark)
    urls = pages.select(F.col(id_col).alias("id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    text = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    word = r"[a-z]{2,24}"
    spoken = pages.select(F.explode(F.regexp_extract_all(_lower_ascii(text), F.lit(word), F.lit(0))).alias("word"))
    number = materialise(spoken.groupBy("word").agg(F.count("*").alias("n"))
                         .unionByName(spark.createDataFrame([(x, 1) for x in seeds], "word string, n long"))
                         .groupBy("word").agg(F.max("n").alias("n")), "counts")
    total = math.log((number.agg(F.sum("n")).first()[0] or 0) + 1)
    hosts = materialise(urls.select("host").distinct(), "hosts")
    hosts = hosts.withColumn("block", F.pmod(F.xxhash64("host"), F.lit(_blocks(hosts.count()))))

    def pieces(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[lo:lo + BLOCK_ROWS]
                found = {(b, w) for b, h in zip(part["block"], part["host"]) for w in possible_words(h)}
                yield pd.DataFrame(list(found), columns=["block", "word"])

    def split(at, known):
        cost = {w: total - math.log(n) for w, n in zip(known["word"], known["n"])}
        return pd.DataFrame({"host": at["host"], "words": [[w for part in labels_of(h) for w in segment(part, cost, total)]
                                                           for h in at["host"]]})

    known = hosts.mapInPandas(pieces, "block long, word string").distinct().join(number, "word")
    hosts = materialise(hosts.groupBy("block").cogroup(known.groupBy("block"))
                        .applyInPandas(split, "host string, words array<string>"), "words")
    tokens = F.concat("words", F.regexp_extract_all(_lower_ascii(F.col("path")), F.lit(r"[a-z0-9]+"), F.lit(0)))
    listed = F.array(*map(F.lit, seeds)).cast("array<string>")
    told = materialise(urls.join(hosts, "host").withColumn("tokens", tokens)
                       .withColumn("bad", F.exists("tokens", lambda t: F.array_contains(listed, t)))
                       .withColumn("tokens", F.filter("tokens", lambda t: ~F.array_contains(listed, t)))
                       .withColumn("row", F.monotonically_increasing_id()), "urls")
    classes = {r["bad"]: r["count"] for r in told.groupBy("bad").count().collect()}
    seen = materialise(told.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(
        F.count(F.when(F.col("bad"), 1)).alias("b"), F.count(F.when(~F.col("bad"), 1)).alias("a")), "tokens")
    n_bad, n_good, size = seen.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    in_bad, in_good = (n_bad or 0) + size + 1, (n_good or 0) + size + 1
    prior = math.log(classes.get(True, 0) + 1) - math.log(classes.get(False, 0) + 1)
    told = told.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(_blocks(sum(classes.values())))))
    told = told.select("block", "id", "host", "path", "words", "tokens")
    odds = (told.select(F.col("block").alias("at"), F.explode("tokens").alias("token")).distinct().join(seen, "token")
            .select("at", "token", (F.log((F.col("b") + 1) / F.lit(in_bad)) - F.log((F.col("a") + 1) / F.lit(in_good))).alias("odds")))

    def scored(at, odds):
        worth = dict(zip(odds["token"], odds["odds"]))
        return at.assign(score=[prior + sum(worth[t] for t in ts) for ts in at["tokens"]]).drop(columns=["block", "tokens"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = told.groupBy("block").cogroup(odds.groupBy("at")).applyInPandas(
        scored, f"id {kind}, host string, path string, words array<string>, score double")
    rule, verdict = matching_rule("host", "path", rules)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score", "words")
