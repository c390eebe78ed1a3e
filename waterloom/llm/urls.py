"""URL filter: rules on hosts and paths first, boosted trees on lexical features for the rest.

A rule names a host and the beginning of a path; it holds for the host and its subdomains, and the
longest rule that fits decides.  URLs that a rule decides are the labelled ones: gradient-boosted
trees learn from their length, depth, digit ratio, entropy, parameter counts and the statistics of
their host's suffixes, and judge every URL without a rule.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterloom.session import materialize

ALLOW, BLOCK = "allow", "block"
#: (rule, verdict): host and beginning of the path in one text.
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK),
         ("com/fr/", ALLOW), ("com/de/", BLOCK))
#: Bound of the different labelled URLs the trees are fitted on, chosen by a hash.
SAMPLE = 8000
TREES, DEPTH, STEP, SEED = 20, 4, 0.3, 11

LEXICAL = ["length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters",
           "host_labels"]
OF_SUFFIX = ["pages", "hosts", "length", "depth", "digits"]


def parts(url: Column | str) -> dict[str, Column]:
    """host (A-Z lower-cased), path and query of a URL; all empty where there is no ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    lower = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0),
                        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": lower, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
            "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)}


def rule_of(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        own = F.col(host) == rule[:at]
        fits = (own | F.col(host).endswith("." + rule[:at])) & F.col(path).startswith(rule[at:])
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character by the frequencies of the text's characters; 0 for an empty text."""
    def bits(run):
        return run * F.log2(run)

    def step(acc, c):
        same = c == acc["c"]
        return F.struct(
            c.alias("c"), F.when(same, acc["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, acc["bits"]).otherwise(acc["bits"] + bits(acc["run"])).alias("bits"))

    n = F.char_length(text).cast("double")
    start = F.struct(F.lit("").alias("c"), F.lit(1.0).alias("run"), F.lit(0.0).alias("bits"))
    total = F.aggregate(F.array_sort(F.split(text, "")), start, step,
                        lambda acc: acc["bits"] + bits(acc["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))


def lexical(url: str, host: str, path: str, query: str) -> dict[str, Column]:
    full = F.coalesce(F.col(url), F.lit(""))
    n = F.char_length(full).cast("double")
    return {
        "length": n, "host_length": F.char_length(host).cast("double"),
        "path_length": F.char_length(path).cast("double"),
        "depth": F.regexp_count(F.col(path), F.lit("[^/]+")).cast("double"),
        "digits": F.regexp_count(full, F.lit("[0-9]")).cast("double"),
        "digit_ratio": F.coalesce(F.try_divide(F.regexp_count(full, F.lit("[0-9]")), n), F.lit(0.0)),
        "entropy": entropy(full),
        "parameters": F.regexp_count(F.col(query), F.lit("[^&]+")).cast("double"),
        "host_labels": F.regexp_count(F.col(host), F.lit("[^.]+")).cast("double")}


def suffixes(host: str) -> list[Column]:
    """Last label of a host and its last two."""
    return [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)]


def suffix_statistics(pages: DataFrame) -> DataFrame:
    """host and, for both of its suffixes, the logs of the numbers of URLs and hosts under it and
    their mean length, depth and digits, over all ``pages`` (host, length, depth, digits).

    Sums are of whole numbers, so they do not depend on the order of rows.
    """
    hosts = materialize(pages.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("length", "depth", "digits")]))
    out = hosts.select("host")
    for level, suffix in enumerate(suffixes("host"), start=1):
        keyed = hosts.withColumn("suffix", suffix)
        sums = keyed.groupBy("suffix").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in (
                "pages", "length", "depth", "digits")])
        # written: hosts of a common suffix can then be split
        facts = materialize(sums.select(
            "suffix", F.log1p(F.col("pages").cast("double")).alias(f"pages_{level}"),
            F.log1p(F.col("n").cast("double")).alias(f"hosts_{level}"),
            *[(F.col(c) / F.col("pages")).alias(f"{c}_{level}") for c in (
                "length", "depth", "digits")]))
        out = out.withColumn("suffix", suffix).join(facts, "suffix").drop("suffix")
    return materialize(out)


def features() -> list[str]:
    return LEXICAL + [f"{c}_{level}" for level in (1, 2) for c in OF_SUFFIX]


def with_features(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """``rows`` (url, host, path, query ...) with all features as columns."""
    return rows.withColumns(lexical("url", "host", "path", "query")).join(statistics, "host")


def fit(pages: DataFrame, statistics: DataFrame, size: int = SAMPLE):
    """Trees fitted on at most ``size`` different URLs that a rule decides, or the one verdict
    there is: ``ALLOW`` where there is none.

    URLs are chosen by a hash and weighted by how often they occur, so neither the order of rows
    nor copies of a URL change the model.  The sample is one ordered file, and thus one partition.
    """
    labelled = pages.where("says IS NOT NULL").groupBy("url", "host", "path", "query", "says").agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    drawn = labelled.orderBy(F.xxhash64("url"), "url").limit(size)
    rows = materialize(with_features(drawn, statistics).orderBy(F.xxhash64("url"), "url")
                       .select("says", "weight", *features()).coalesce(1))
    says = {r[0] for r in rows.select("says").distinct().collect()}
    if len(says) < 2:
        return next(iter(says), ALLOW)
    train = VectorAssembler(inputCols=features(), outputCol="vector").transform(
        rows.coalesce(1).withColumn("target", (F.col("says") == BLOCK).cast("double")))
    trees = GBTClassifier(
        featuresCol="vector", labelCol="target", weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
        stepSize=STEP, seed=SEED, minInstancesPerNode=5)
    return trees.fit(train)


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES,
          size: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict and score (probability of a block:
    0 or 1 by a rule, else the trees').

    Null and empty URLs and those without ``://`` have an empty host and path, fit no rule and are
    judged by the trees.  Of rules of equal length the later one wins.  Repeated rows stay
    repeated; null ids stay null.  Only the two named columns are read.  Without labelled URLs
    everything else is allowed; with labels of one kind only, that one is the verdict.  An empty
    table gives no rows.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns(parts("url"))
    name, says = rule_of("host", "path", rules)
    rows = rows.withColumns({"rule": name, "says": says})
    counted = rows.withColumns({k: v for k, v in lexical("url", "host", "path", "query").items()
                                if k in ("length", "depth", "digits")})
    statistics = suffix_statistics(counted)
    model = fit(rows, statistics, size)
    by_rule = F.when(F.col("says") == BLOCK, 1.0).when(F.col("says") == ALLOW, 0.0)
    if isinstance(model, str):
        other = F.lit(float(model == BLOCK))
        out = rows.withColumn("chance", other)
    else:
        vectors = VectorAssembler(inputCols=features(), outputCol="vector").transform(
            with_features(rows, statistics))
        out = model.transform(vectors).withColumn("chance", vector_to_array("probability")[1])
    score = F.coalesce(by_rule, F.col("chance"))
    return out.select("page_id", "host", "path", "rule", F.when(
        score > 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("verdict"), score.alias("score"))
