"""URL filter: explicit rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.common import spread_join, written

#: The trees are fitted on at most so many labelled URLs of either verdict.
TRAIN_URLS = 5_000

#: Weight of the overall share in the statistics of a suffix.
PRIOR = 20.0

#: Folds of hosts; the trees see the statistics of the other folds.
FOLDS = 5

#: Suffixes with this share of all rows are frequent; there are at most 1/share of them.
FREQUENT_SHARE = 1 / 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A rule for a host with all its subdomains, and all paths that start with its path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """``"block example.com/en/"`` -> Rule."""
    verdict, target = line.split(" ")
    host, slash, path = target.partition("/")
    return Rule(verdict, host, slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL; both empty if it is NULL or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, NULL if none does. (A short list: it is written into the plan.)"""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Add lexical features to (``url``, ``host``, ``path``): lengths, depth, digits, entropy, parameters, suffixes."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    tail = F.regexp_extract(url, r"[?#](.*)$", 1)
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: (n - F.char_length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(counts, F.lit(0.0), lambda total, p: total + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    features = {
        "f_length": F.char_length(url),
        "f_host_length": F.char_length("host"),
        "f_path_length": F.char_length("path"),
        "f_labels": F.regexp_count("host", F.lit(r"[^.]+")),
        "f_depth": F.regexp_count("path", F.lit(r"[^/]+")),
        "f_digits": F.regexp_count(url, F.lit("[0-9]")) / n,
        "f_hyphens": F.regexp_count("host", F.lit("-")),
        "f_entropy": entropy,
        "f_parameters": F.regexp_count(tail, F.lit("[^&=]+=")),
        "f_fragment": url.contains("#").cast("int"),
        "f_secure": url.startswith("https:").cast("int"),
    }
    filled = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in features.items()}
    suffixes = {"suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2)}
    return urls.withColumns(filled | suffixes)


FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digits", "f_hyphens", "f_entropy",
    "f_parameters", "f_fragment", "f_secure", "f_suffix1", "f_suffix2",
]


@dataclass
class UrlModel:
    """Shares of blocked URLs by suffix over all labelled URLs, and trees fitted on a bounded sample of them."""

    suffix1: DataFrame
    suffix2: DataFrame
    prior: float
    trees: PipelineModel | None

    def with_suffix_shares(self, urls: DataFrame) -> DataFrame:
        """Add the shares of both suffixes. The shorter one follows from the longer, so one lookup by the longer serves both.

        Those with at least ``FREQUENT_SHARE`` of the rows, boundedly many, are broadcast, and their rows are not exchanged; the others meet their rows
        in a join, in which none has a large share.
        """
        names = urls.groupBy("suffix2").agg(F.count("*").alias("urls")).withColumn("suffix1", F.substring_index("suffix2", ".", -1))
        shares = spread_join(names, self.suffix1, ["suffix1"], ["suffix2"], "left").join(self.suffix2, "suffix2", "left")
        filled = [F.coalesce(x, F.lit(self.prior)).alias(x) for x in ("f_suffix1", "f_suffix2")]
        shares = written(shares.select("suffix2", "urls", F.struct(*filled).alias("shares")))
        total = shares.agg(F.sum("urls")).first()[0] or 0
        frequent = F.col("urls") >= F.lit(total * FREQUENT_SHARE)
        often = shares.where(frequent).select("suffix2", F.col("shares").alias("_often"))
        known = urls.join(F.broadcast(often), "suffix2", "left")
        rare = shares.where(~frequent).select("suffix2", F.col("shares").alias("_rare"))
        served = known.where("_often is not null").withColumn("_shares", F.col("_often")).drop("_often")
        others = known.where("_often is null").drop("_often").join(rare, "suffix2", "left").withColumnRenamed("_rare", "_shares")
        met = served.unionByName(others)
        return met.withColumns({x: F.col(f"_shares.{x}") for x in ("f_suffix1", "f_suffix2")}).drop("_shares")

    def score(self, urls: DataFrame) -> DataFrame:
        """Add ``block_score`` to rows of ``lexical``; without labels of both verdicts, the share of blocked ones."""
        if self.trees is None:
            return urls.withColumn("block_score", F.lit(self.prior))
        scored = self.trees.transform(self.with_suffix_shares(urls))
        return scored.withColumn("block_score", vector_to_array("probability")[1])


def _drawn(blocked: Column, weight: Column, prior: float) -> Column:
    """A share of blocked URLs, drawn towards the prior."""
    return (blocked + PRIOR * prior) / (weight + PRIOR)


def fit_urls(labelled: DataFrame, per_label: int = TRAIN_URLS) -> UrlModel:
    """Fit on labelled URLs: rows of ``lexical`` with ``blocked`` (0.0 or 1.0).

    Every different URL counts once, however many rows hold it. Both verdicts weigh alike in all, so a URL about which nothing is
    known is not judged by how many URLs the rules block. Shares by suffix cover all labelled URLs, summed in the tasks
    first. The trees see the URLs with the smallest digests, at most ``per_label`` of either verdict; for them, shares are
    taken without the labels of their own fold of hosts, as the URLs to judge come from other hosts, too.
    """
    once = labelled.dropDuplicates(["url", "blocked"])
    counts = {r.blocked: r["count"] for r in once.groupBy("blocked").count().collect()}
    prior = 0.5 if len(counts) == 2 else float(max(counts, default=0.0))
    weights = {k: sum(counts.values()) / (len(counts) * n) for k, n in counts.items()}
    weight = F.when(F.col("blocked") == 1.0, weights.get(1.0, 1.0)).otherwise(weights.get(0.0, 1.0))
    weighed = once.withColumns({"weight": weight, "fold": F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(FOLDS))})
    sums, shares = {}, []
    for name in ("suffix1", "suffix2"):
        in_fold = [F.when(F.col("fold") == i, F.col("weight")).otherwise(0.0) for i in range(FOLDS)]
        sums[name] = weighed.groupBy(name).agg(
            F.array(*[F.sum(x * F.col("blocked")) for x in in_fold]).alias(f"blocked_{name}"),
            F.array(*[F.sum(x) for x in in_fold]).alias(f"all_{name}"),
        )
        total = [F.aggregate(f"{part}_{name}", F.lit(0.0), lambda a, x: a + x) for part in ("blocked", "all")]
        shares.append(sums[name].select(name, _drawn(*total, prior).alias(f"f_{name}")))
    model = UrlModel(*shares, prior, None)
    if len(counts) < 2:
        return model
    order = F.md5(F.coalesce("url", F.lit("")).cast("binary"))
    few = [weighed.where(F.col("blocked") == k).orderBy(order, "url").limit(per_label) for k in (0.0, 1.0)]
    sample = few[0].unionByName(few[1])
    for name in ("suffix1", "suffix2"):
        sample = sample.join(sums[name], name)
        others = [
            F.aggregate(f"{part}_{name}", F.lit(0.0), lambda a, x: a + x) - F.element_at(f"{part}_{name}", F.col("fold").cast("int") + 1)
            for part in ("blocked", "all")
        ]
        sample = sample.withColumn(f"f_{name}", _drawn(*others, prior))
    sample = sample.select("blocked", "weight", "url", *FEATURES).repartition(1).sortWithinPartitions("url", "blocked")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    points = assembler.transform(sample)
    trees = GBTClassifier(labelCol="blocked", featuresCol="features", weightCol="weight", maxIter=12, maxDepth=4, seed=7).fit(points)
    model.trees = PipelineModel([assembler, trees])
    return model


def filter_urls(pages: DataFrame, rules: list[Rule], url_column: str = "url") -> DataFrame:
    """Judge every URL: ``page`` (all columns as a struct), ``host``, ``path``, ``rule``, ``block_score``, ``verdict``.

    The longest rule that fits decides. The URLs that rules decide are the labelled ones from
    which the trees learn; they judge the rest, blocking from a score of one half on.

    NULL and URLs without ``://`` have an empty host and path, fit no rule and are judged by the trees, as are empty
    ones. Repeated rows are judged alike. If all labels agree, the rest follows them; without any, it is
    allowed. An empty table gives no rows. No suffix, however frequent, has its rows in one task.
    """
    url = pages[url_column]
    host, path = host_and_path(url)
    parsed = pages.select(F.struct("*").alias("page"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, decided = matching_rule(rules, F.col("host"), F.col("path"))
    ruled = parsed.withColumns({"rule": rule, "decided": decided})
    labelled = ruled.where("decided is not null").select("url", "host", "path", F.when(F.col("decided") == "block", 1.0).otherwise(0.0).alias("blocked"))
    model = fit_urls(lexical(labelled))
    scored = model.score(lexical(ruled))
    judged = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page", "host", "path", "rule", "block_score", F.coalesce("decided", judged).alias("verdict"))
