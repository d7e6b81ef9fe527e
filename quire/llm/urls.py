"""URL filters: fixed host and path rules first, then association rules mined from labels.

FP-growth mines the combinations of tokens that stand in enough bad URLs, of any length; how many good URLs hold each tells its
confidence. Those that reach CONFIDENCE become block rules; a rule of which a shorter part is as confident is dropped. Rules match by
an inverted index: each stands in the posting list of its rarest token only, is met by an equi-join on tokens, and is
verified against the URL's token set.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from quire.plans.materialize import written

#: (host, path, verdict). Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A combination must be bad in this share of the labelled URLs and in MIN_HITS of them, and this share of its URLs must be bad.
SUPPORT, MIN_HITS, CONFIDENCE = 0.002, 20, 0.5


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    whole = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(whole, "/")
    return F.when(at > 0, F.substring(whole, at, F.length(whole))).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def listed(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none: the host or a subdomain, and the path's start; equal lengths go to the rule first by text."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.coalesce(rule, F.when(fits, F.lit(h + p))), F.coalesce(verdict, F.when(fits, F.lit(v)))
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host, its last two labels, its first label, path words and query keys; digits count as one class."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    site = F.array_join(F.reverse(F.slice(F.reverse(labels), 1, 2)), ".")
    words = F.transform(F.filter(F.split(F.lower(path), r"[/._~\-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)=")), lambda x: F.concat(F.lit("key="), F.lower(x)))
    first = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(F.coalesce(url, F.lit("")), ":", 1))), F.concat(F.lit("site="), site), F.concat(F.lit("host="), host), F.concat(F.lit("label="), F.coalesce(F.get(labels, F.lit(0)), F.lit(""))))
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, words, keys, mark))


def mine(labelled: DataFrame, support: float = SUPPORT, hits: int = MIN_HITS, confidence: float = CONFIDENCE) -> DataFrame:
    """labelled(tokens, bad boolean) -> (rule_id, tokens, size, support, confidence): the pruned block rules, of any number of tokens.

    A rule is a combination of tokens that at least `hits` bad URLs and a share of `support` of all labelled ones are bad with, of whose
    URLs at least a share of `confidence` is bad, and of whose shorter parts none is as confident. Null labels and null token lists teach nothing;
    without bad rows there are no rules.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, size int, support double, confidence double")
    rows = written(labelled.where("bad is not null and tokens is not null").select(F.monotonically_increasing_id().alias("row"), "bad", F.array_distinct("tokens").alias("tokens")), "labelled")
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    least = max(math.ceil(support * n - 1e-9), hits)
    if n_bad < least:
        return empty
    # FP-growth over the bad URLs; the share is kept below `least`, as it is compared after division
    tree = FPGrowth(itemsCol="tokens", minSupport=(least - 0.5) / n_bad).fit(rows.where("bad").select("tokens"))
    sets = written(tree.freqItemsets.where(F.col("freq") >= least).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("hits")).withColumn("set_id", F.xxhash64("tokens")), "itemsets")
    # how many good URLs hold a set: each set waits at its token that fewest good URLs hold
    good = rows.where("not bad").select("row", "tokens")
    held = written(good.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "tokens")
    posted = sets.select("set_id", F.explode("tokens").alias("token")).join(held, "token", "left").groupBy("set_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    posted = written(posted.join(sets.select("set_id", F.col("tokens").alias("needs")), "set_id"), "posted")
    met = good.select("tokens", F.explode("tokens").alias("token")).join(posted, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    counted = sets.join(met.groupBy("set_id").agg(F.count("*").alias("good")), "set_id", "left").withColumn("freq", F.col("hits") + F.coalesce("good", F.lit(0)))
    known = written(counted.select("set_id", "tokens", F.size("tokens").alias("size"), "hits", "freq", (F.col("hits") / F.col("freq")).alias("c")), "counted")
    # a rule adds nothing to a shorter part that is as confident; parts of a mined set are mined too, so the best of them comes from the
    # sets with one token less and from their best, one size after another
    longest = known.agg(F.max("size")).first()[0] or 0
    best = written(known.where("size = 1").select("set_id", "c"), "best")
    out = known.where((F.col("size") == 1) & (F.col("c") >= confidence)).drop("c")
    for n_tokens in range(2, longest + 1):
        whole = known.where(F.col("size") == n_tokens)
        parts = whole.select("set_id", F.explode(F.transform("tokens", lambda t: F.xxhash64(F.array_remove("tokens", t)))).alias("part"))
        above = parts.join(best.select(F.col("set_id").alias("part"), F.col("c").alias("most")), "part").groupBy("set_id").agg(F.max("most").alias("most"))
        state = written(whole.join(above, "set_id"), "best")
        out = out.unionByName(state.where((F.col("c") >= confidence) & (F.col("c") > F.col("most"))).select(*out.columns))
        best = state.select("set_id", F.greatest("c", "most").alias("c"))
    return out.select(F.col("set_id").alias("rule_id"), "tokens", "size", (F.col("hits") / n).alias("support"), (F.col("hits") / F.col("freq")).alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """pages -> (page_id, host, path, rule, verdict, n_rules, confidence), one row a page.

    labels: (id, bad boolean), matched to page ids. A null URL or one without `://` has empty host and path and
    no listed rule. Where no listed rule fits, a page is blocked if a mined rule fits its tokens, else allowed; without
    labels nothing is mined and all such pages are allowed. Repeated pages each give a row; null labels teach nothing.
    """
    u = F.col(url)
    base = pages.select(F.col(page_id).alias("page_id"), u.alias("url"), F.coalesce(host_of(u), F.lit("")).alias("host"), F.coalesce(path_of(u), F.lit("")).alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"))
    base = written(base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens")), "urls")
    known = labels.where("bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    rules = written(mine(base.join(known, base["page_id"] == known["id"]).select("tokens", "bad")), "rules")
    shared = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    posted = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(shared, "token")
    posted = posted.groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("tokens").alias("needs"), F.first("confidence").alias("confidence"))
    # URLs of equal tokens are judged once; a set's key is its hash
    sets = base.where("listed is null").select("tokens").distinct()
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(posted, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    found = met.groupBy("tokens").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))
    out = base.join(written(found, "verdicts"), "tokens", "left")  # as a table: the join has an exchange on both sides and can split a frequent set
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.when(F.col("listed").isNull(), F.coalesce("n_rules", F.lit(0))).alias("n_rules"), F.when(F.col("listed").isNull(), F.col("confidence")).alias("confidence"))
