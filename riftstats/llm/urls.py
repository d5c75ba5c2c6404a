"""URL filter: host and path rules, and gradient-boosted trees for the rest.

All of it is DataFrame functions and Spark ML (JVM). The longest rule that fits
a URL decides; a URL that no rule fits is judged by trees over lexical features
(length, depth, digit ratio, entropy, parameter counts and statistics of the
host's suffix), trained from the URLs that the rules label. Suffix statistics
come from all rows, the trees from at most TRAIN_ROWS labelled URLs, picked by
hash. So that no label is an input of its own prediction, hosts are dealt to
FOLDS folds: a labelled URL takes its suffix's share of blocked URLs from the
other folds, an unlabelled one from all of them.

Cases: a null URL, or one without "://", has an empty host and path, fits no
rule and is judged by the trees; where the labelled URLs are of one class only,
that class is the verdict, and `allow` where there are none; repeated rows give
repeated results; null ids are carried; an empty table gives an empty result;
a very long URL is measured whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

#: (verdict, host, path prefix).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Labelled URLs that the trees are trained on, at most.
TRAIN_ROWS = 10_000
TREES, DEPTH, STEP, SEED = 8, 3, 0.3, 7
FOLDS = 16
FEATURES = ["n_url", "n_host", "n_path", "depth", "labels", "digits", "hyphens", "entropy", "params", "query", "fragment", "secure", "suffix_rows", "suffix_blocked"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parsed(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))


def ruled(parts: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule (host and path of the longest that fits) and ruling."""
    rule = ruling = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = (F if rule is None else rule).when(fits, host + path)
        ruling = (F if ruling is None else ruling).when(fits, verdict)
    return parts.withColumn("rule", rule).withColumn("ruling", ruling)


def count_of(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def entropy(c: Column) -> Column:
    """Bits a character, from the counts of the distinct characters."""
    n = F.length(c)
    bits = lambda a, x: a - F.when(x == "", 0.0).otherwise((count := (n - F.length(F.replace(c, x, F.lit("")))) / n) * F.log2(count))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), bits))


def featured(parts: DataFrame) -> DataFrame:
    """Adds FEATURES. The statistics of a suffix (the host's last label) are
    aggregated over all rows and joined by suffix and fold, which also deals out
    a hot suffix."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    base = parts.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    counts = base.groupBy("suffix", "fold").agg(F.count("*").alias("rows"), F.count_if(F.col("ruling") == "block").alias("blocked"), F.count("ruling").alias("ruled"))
    every = counts.groupBy("suffix").agg(*[F.sum(c).alias(f"all_{c}") for c in ("rows", "blocked", "ruled")])
    stats = counts.join(every, "suffix")
    lexical = {
        "n_url": F.length(url), "n_host": F.length(host), "n_path": F.length(path), "depth": count_of(path, "/"), "labels": count_of(host, ".") + 1,
        "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)), "hyphens": count_of(host, "-"), "entropy": entropy(url),
        "params": count_of(url, "=") + count_of(url, "&"), "query": F.contains(url, F.lit("?")).cast("int"), "fragment": F.contains(url, F.lit("#")).cast("int"), "secure": url.startswith("https").cast("int"),
    }
    own = lambda c: F.col(f"all_{c}") - F.when(F.col("ruling").isNotNull(), F.col(c)).otherwise(0)
    rows = base.withColumns({k: c.cast("double") for k, c in lexical.items()}).join(stats, ["suffix", "fold"])
    return rows.withColumns({"suffix_rows": F.log1p("all_rows"), "suffix_blocked": (own("blocked") + 1) / (own("ruled") + 2)})


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled rows by hash of URL and id. A bound on the hash,
    from their number, leaves some more than that for the exact limit."""
    ruled = rows.where("ruling is not null")
    place = F.xxhash64("url", "page_id")
    n = ruled.count()
    if n > 2 * most:
        ruled = ruled.where(F.pmod(place, F.lit(1 << 20)) < max(1, int(1.5 * most / n * (1 << 20))))
    return ruled.orderBy(place, "url", "page_id").limit(most)


def trained(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[float], GBTClassificationModel | None]:
    """The classes of the labelled rows (1.0: block), and trees if there are two."""
    label = (F.col("ruling") == "block").cast("double").alias("label")
    sample = cut(sampled(rows, train_rows).select(*FEATURES, label))
    classes = [r[0] for r in sample.select("label").distinct().collect()]
    if len(classes) < 2:
        return classes, None
    return classes, GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=SEED).fit(assembled(sample))


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of block by the
    trees, null where a rule decides or there is nothing to learn from)."""
    rows = featured(ruled(parsed(pages), rules))
    classes, trees = trained(rows, train_rows)
    if trees is None:
        rest = "block" if classes == [1.0] else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.lit(rest)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    scored = trees.transform(assembled(rows))
    p = F.when(F.col("ruling").isNull(), vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("score"))
