"""URL filters by rules and by the ratio of two character language models; DataFrame operations only.

Rules (host, path) decide the urls they fit, the longest rule first.  The accepted and the rejected of
these train two smoothed variable-order Markov models over the characters of host and path: the
probability of a character after the longest context is smoothed with that after the next
shorter one, down to a uniform one (Witten-Bell style, with a fixed weight: p(c | h) = (n(hc) + w p(c | h')) / (n(h) + w)).
Every gram of ``order`` + 1 characters thus has one log ratio, quantised to millionths, and a url's
score is the mean of its grams' ratios.  The threshold is calibrated on every fifth distinct decided url (by
md5), whose grams aren't counted: the score bin that best separates
accepted from rejected ones, by balanced accuracy, the lowest among equals, moved halfway to the next lower bin that
holds any.

Distinct strings are told apart by their SHA-256 digest, which stands for them wherever their grams are: what is written and shuffled is linear in
a url's length.  What is gathered from the pages: the grams of all distinct decided urls, counted with partial
aggregation.  Only bin counts (at most ``2 * BINS + 1`` rows) come to the driver.

Defined results: a null url, or one without ``://``, has empty host and path and score 0; without
decided urls of both kinds the threshold is 0; a score at the threshold allows.
Repeated rows give repeated rows; equal urls equal verdicts; other columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: (verdict, rule)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER, WEIGHT, ALPHABET, SCALE = 4, 2.0, 256.0, 1_000_000
#: Score bins of 1/100 nat on either side of 0, for calibration.
BINS = 1000
_PAD = "\x02"
#: Characters of a url that one row holds while grams are made, and keys over which a gram's rows are spread.
BLOCK, SALTS = 256, 8


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path, as in the module's docstring."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return _lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(df: DataFrame) -> DataFrame:
    """(the columns but ``s``, gram): one row for each character of ``s``, the character with the ORDER ones before it.

    s is first cut into blocks of BLOCK characters that carry the ORDER characters before them, so no row holds more of it and the
    work is linear in its length."""
    blocks = F.regexp_extract_all(F.concat(F.lit(_PAD * ORDER), "s"), F.lit(f"(?s)(?=(.{{1,{BLOCK + ORDER}}})).{{1,{BLOCK}}}"), F.lit(1))
    cut = df.withColumn("_block", F.explode(blocks)).drop("s").where(F.length("_block") > ORDER)
    each = F.transform(F.sequence(F.lit(1), F.length("_block") - ORDER), lambda i: F.substr("_block", i, F.lit(ORDER + 1)))
    return cut.withColumn("gram", F.explode(each)).drop("_block")


def _counts(train: DataFrame) -> DataFrame:
    """(gram, g, b): how often every longest gram occurs in accepted and in rejected urls."""
    return checkpoint(_grams(train.where("length(s) > 0").select("s", "good")).groupBy("gram").agg(F.sum(F.col("good").cast("bigint")).alias("g"), F.sum((~F.col("good")).cast("bigint")).alias("b")))


def _suffix_counts(full: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Counts of the last n + 1 characters of the grams, and of the n before the last one."""
    part = full.groupBy(F.substr("gram", F.lit(ORDER + 1 - n), F.lit(n + 1)).alias("x")).agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    context = part.groupBy(F.substr("x", F.lit(1), F.lit(n)).alias("h")).agg(F.sum("g").alias("hg"), F.sum("b").alias("hb"))
    return part, context


def scored(urls: DataFrame, train: DataFrame) -> DataFrame:
    """(id, score) of urls (id, s), each once; train has s and good.  score is in millionths of a nat a character.

    The equal grams of a url are one row before anything is shuffled; a frequent gram's rows are spread over SALTS keys."""
    full = _counts(train)
    salt = F.pmod(F.hash("id"), F.lit(SALTS)).alias("salt")
    grams = checkpoint(_grams(urls.where("length(s) > 0").select("id", "s")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("n")).select("id", "gram", "n", salt))
    table = grams.select("gram").distinct()
    pg, pb = F.lit(1.0 / ALPHABET), F.lit(1.0 / ALPHABET)
    for n in range(ORDER + 1):
        part, context = _suffix_counts(full, n)
        table = table.join(part.select(F.col("x"), "g", "b"), F.substr("gram", F.lit(ORDER + 1 - n), F.lit(n + 1)) == F.col("x"), "left").drop("x")
        table = table.join(context, F.substr("gram", F.lit(ORDER + 1 - n), F.lit(n)) == F.col("h"), "left").drop("h")
        pg = (F.coalesce("g", F.lit(0)) + WEIGHT * pg) / (F.coalesce("hg", F.lit(0)) + WEIGHT)
        pb = (F.coalesce("b", F.lit(0)) + WEIGHT * pb) / (F.coalesce("hb", F.lit(0)) + WEIGHT)
        table = table.select("gram", pg.alias("pg"), pb.alias("pb"))
        pg, pb = F.col("pg"), F.col("pb")
    ratio = table.select("gram", F.round(F.log(F.col("pg") / F.col("pb")) * SCALE).cast("bigint").alias("ratio"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return grams.join(ratio, ["gram", "salt"]).groupBy("id").agg(F.floor(F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).alias("score"))


def threshold(held: DataFrame) -> int:
    """The calibrated threshold, from (good, score) of held-out urls."""
    width = SCALE // 100
    at = F.least(F.lit(BINS), F.greatest(F.lit(-BINS), F.floor(F.col("score") / width)))
    rows = held.groupBy(at.alias("at")).agg(F.sum(F.col("good").cast("bigint")).alias("g"), F.sum((~F.col("good")).cast("bigint")).alias("b")).orderBy("at").collect()
    good, bad = sum(r.g for r in rows), sum(r.b for r in rows)
    if not good or not bad:
        return 0
    # allow from bin i on: good ones at or above it, bad ones below it
    below_g = below_b = 0
    best, where, before = None, 0, None
    for r in rows:
        value = (good - below_g) * bad + below_b * good
        if best is None or value > best:
            # halfway to the bin before, where nothing lies between
            best, where = value, r.at - (0 if before is None else (r.at - before) // 2)
        below_g, below_b, before = below_g + r.g, below_b + r.b, r.at
    return int(where) * width


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict and score (nats a character; null where a rule decides)."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    s = F.concat("host", "path")
    rows = rows.select("key", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.unhex(F.sha2(s.cast("binary"), 256)).alias("id"), s.alias("s"))
    strings = checkpoint(rows.groupBy("id").agg(F.max("ruled").alias("ruled"), F.min("ruled").alias("also"), F.any_value("s").alias("s")))
    decided = strings.where((F.col("ruled") == F.col("also")) & (F.length("s") > 0)).select("id", "s", (F.col("ruled") == "allow").alias("good"))
    held = F.conv(F.substring(F.md5(F.col("s").cast("binary")), 1, 8), 16, 10).cast("bigint") % 5 == 0
    model = decided.where(~held)
    ask = strings.where("ruled is null").select("id", "s").unionByName(decided.where(held).select("id", "s"))
    scores = checkpoint(scored(ask, model))
    limit = threshold(decided.where(held).join(scores, "id").select("good", "score"))
    out = rows.drop("s").join(scores, "id", "left")
    score = F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0)))
    final = F.coalesce("ruled", F.when(score >= limit, "allow").otherwise("block"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", final.alias("verdict"), (score / SCALE).alias("score"))
