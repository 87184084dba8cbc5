"""URL filters: rules on hosts and paths, and boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import small_side, stored

#: Rules of the contract, as (verdict, host and path) (fixed values).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Most labelled URLs of each verdict that a fit sees, those of the smallest hashes: the one bounded sample here.
FIT_PER_CLASS = 5000
TREES, DEPTH = 20, 4
FEATURES = [
    "chars", "host_chars", "path_chars", "labels", "depth", "digits", "host_digits", "signs", "entropy", "host_entropy",
    "parameters", "fragment", "secure", "www", "longest", "suffix_rate", "suffix_log", "segment_rate", "segment_log",
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased in A-Z) and path of a url; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without any. A rule fits its host and all subdomains, if the
    path starts with the rule's."""
    rule, verdict = F, F
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(says))
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits of the distribution of a text's characters; 0 for the empty text.

    The whole text counts. Its characters are sorted, so that one pass over them sums n * log2(n) of each run of equals.
    """
    letters = F.sort_array(F.split(text, ""))
    log = lambda n: n * F.log2(n)
    start = F.struct(F.lit("").alias("c"), F.lit(1.0).alias("n"), F.lit(0.0).alias("s"))

    def step(run: Column, c: Column) -> Column:
        same = run["c"] == c
        return F.struct(
            c.alias("c"), F.when(same, run["n"] + 1.0).otherwise(1.0).alias("n"), F.when(same, run["s"]).otherwise(run["s"] + log(run["n"])).alias("s")
        )

    total = F.aggregate(letters, start, step, lambda run: run["s"] + log(run["n"]))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.log2(F.length(text)) - total / F.length(text))


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the lexical features of url, host and path, and the suffix and first segment on which statistics are kept."""
    text = F.coalesce("url", F.lit(""))
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return pages.withColumns(
        {
            "chars": F.length(text),
            "host_chars": F.length("host"),
            "path_chars": F.length("path"),
            "labels": F.size(F.split("host", r"\.")),
            "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
            "digits": share(digits, F.length(text)),
            "host_digits": share(F.length(F.regexp_replace("host", "[^0-9]", "")), F.length("host")),
            "signs": F.length(F.regexp_replace(text, r"[0-9A-Za-z/:.]", "")),
            "entropy": entropy(text),
            "host_entropy": entropy(F.col("host")),
            "parameters": F.when(F.instr(text, "?") > 0, F.size(F.split(F.regexp_extract(text, r"\?([^#]*)", 1), "&"))).otherwise(F.lit(0)),
            "fragment": (F.instr(text, "#") > 0).cast("int"),
            "secure": text.startswith("https").cast("int"),
            "www": F.col("host").startswith("www.").cast("int"),
            "longest": F.array_max(F.transform(F.split("path", "/"), lambda s: F.length(s))),
            "suffix": F.substring_index("host", ".", -1),
            "segment": F.regexp_extract("path", "^/([^/]*)", 1),
        }
    )


def rates(labelled: DataFrame, key: str) -> DataFrame:
    """Smoothed share of blocked urls and the log count for each value of ``key`` among labelled urls."""
    counted = labelled.groupBy(key).agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
    return stored(counted.select(key, ((F.col("b") + 1) / (F.col("n") + 2)).alias(f"{key}_rate"), F.log1p("n").alias(f"{key}_log")), f"{key}-rates")


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame
    segments: DataFrame
    share: float


def features(pages: DataFrame, suffixes: DataFrame, segments: DataFrame) -> DataFrame:
    out = pages.join(small_side(suffixes), "suffix", "left").join(small_side(segments), "segment", "left")
    rest = {c: F.coalesce(c, F.lit(0.5 if c.endswith("rate") else 0.0)) for c in ("suffix_rate", "suffix_log", "segment_rate", "segment_log")}
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(out.withColumns(rest))


def learn(labelled: DataFrame, per_class: int = FIT_PER_CLASS, seed: int = 7) -> UrlModel:
    """Boosted trees from labelled urls (url, host, path and features, label 0 or 1). Statistics of suffixes and first
    segments cover all labelled urls; trees see at most ``per_class`` of each label. With one label only there are no
    trees, and every url gets that label."""
    suffixes, segments = rates(labelled, "suffix"), rates(labelled, "segment")
    blocked, total = labelled.agg(F.sum("label"), F.count(F.lit(1))).first()
    share = (blocked or 0) / total if total else 0.0
    if share in (0.0, 1.0):
        return UrlModel(None, suffixes, segments, share)
    picked = [labelled.filter(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(per_class) for y in (0, 1)]
    sample = features(picked[0].union(picked[1]), suffixes, segments).select("features", F.col("label").cast("double"))
    sample = stored(sample.orderBy(F.xxhash64("features"), "label").coalesce(1), "url-sample")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, checkpointInterval=-1).fit(sample)
    return UrlModel(trees, suffixes, segments, share)


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, per_class: int = FIT_PER_CLASS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (chance of block) for every row of ``pages`` (page_id, url).

    The longest fitting rule decides. Where none fits, boosted trees do, trained on the urls that rules label: block at a
    chance of one half or more. Null urls and urls without ``://`` have an empty host and path and are judged by the
    trees as empty. Repeated urls count each; if no url or only one verdict is labelled, that verdict (else allow) holds
    for the rest. An empty table gives an empty table; other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumns({"rule": rule, "says": verdict}))
    model = learn(rows.filter("says IS NOT NULL").withColumn("label", (F.col("says") == "block").cast("int")), per_class)
    full = features(rows, model.suffixes, model.segments)
    if model.trees is None:
        full = full.withColumn("score", F.lit(model.share))
    else:
        full = model.trees.transform(full).withColumn("score", vector_to_array("probability")[1])
    guess = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return full.select("page_id", "host", "path", "rule", F.coalesce("says", guess).alias("verdict"), "score")
