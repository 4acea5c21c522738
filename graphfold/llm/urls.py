"""URL filters: host and path rules, and gradient-boosted trees over lexical features. DataFrame functions only.

A rule names a host, with all its subdomains, and the start of a path; of the
rules that fit a url the longest decides. Urls that no rule fits are judged by
boosted trees, which are trained on the urls that the rules have labelled. The
features are length, path depth, digit ratio, entropy of the characters, the
numbers of parameters, hyphens and labels of the host, and two statistics of the
host's suffix (its last two labels): how many urls have it, and the share of
blocked ones among the labelled, both over all urls. For a labelled url that share
is taken over the other FOLDS - 1 parts of the urls, so that no label is part of
its own url's features. Each suffix has statistics of its own; the most common
ones are broadcast and the rest joined. accuracy() trains on some urls and holds
the verdicts against the labels of the others.

A tree level is one aggregation: each labelled url's features are binned, and
gradients are summed by node, feature and bin. The sums have at most
nodes * features * BINS rows. The trees are fitted on at most TRAIN_ROWS labelled
urls, those with the smallest hashes; suffix statistics and verdicts cover all.

Edge cases: for a null url, or one without `://`, host and path are empty and no
rule fits; its features are those of an empty string. Without labelled urls of
both verdicts the model is a constant: the verdict that occurs, or allow.
Repeated urls get equal verdicts. A score of exactly 0.5 allows. Urls of any length
are read whole. Extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfold.llm.common import attach, materialize, table

#: The query's rules, as verdict and host with path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TRAIN_ROWS = 50_000
TREES, DEPTH, BINS, RATE, RIDGE = 12, 3, 16, 0.4, 1.0
#: Parts of the urls: the statistics of a labelled url's suffix come from the other parts.
FOLDS = 5
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "suffix_urls", "suffix_blocked")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decided).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that a url has of its own."""
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    return {
        "length": n.cast("double"),
        "depth": count(path, "/[^/]"),
        "digit_ratio": F.when(n > 0, count(url, "[0-9]") / n).otherwise(0.0),
        "entropy": F.when(n > 0, bits).otherwise(0.0),
        "parameters": count(url, "[?&][^=&#]*="),
        "hyphens": count(host, "-"),
        "labels": F.when(host == "", 0.0).otherwise(count(host, r"\.") + 1),
    }


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def describe(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict (null without a rule) and the features of each page."""
    host, path = host_and_path(F.col("__url"))
    base = pages.select(F.col(key).alias(key), F.col(url).cast("string").alias("__url"))
    base = base.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "verdict": verdict, **lexical(F.col("__url"), F.col("host"), F.col("path")), "__suffix": suffix(F.col("host"))})
    base = materialize(base.withColumn("__hash", F.xxhash64("__url")).drop("__url"), "url_features")
    blocked, labelled = (F.col("verdict") == "block").cast("double"), F.col("verdict").isNotNull().cast("double")
    own = F.pmod("__hash", F.lit(FOLDS))
    folds = [F.struct(F.coalesce(F.sum(F.when(own == k, blocked)), F.lit(0.0)).alias("blocked"), F.sum(F.when(own == k, labelled).otherwise(0.0)).alias("labelled")) for k in range(FOLDS)]
    stats = base.groupBy("__suffix").agg(F.count("*").alias("__urls"), F.log2(F.count("*") + 1.0).alias("suffix_urls"), F.array(*folds).alias("__folds"))
    stats = materialize(stats, "url_suffixes")
    found = attach(base, stats, ["__suffix"], "__urls", [key, "__hash"])
    # a labelled url's share is taken over the other folds, so that its own label is no part of its features
    total = lambda name: F.aggregate("__folds", F.lit(0.0), lambda acc, x: acc + x[name]) - F.when(F.col("verdict").isNotNull(), F.element_at("__folds", (own + 1).cast("int"))[name]).otherwise(0.0)
    return found.withColumn("suffix_blocked", (total("blocked") + 1.0) / (total("labelled") + 2.0)).drop("__suffix", "__folds")


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    out = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        out = F.when(value <= cuts[i], i).otherwise(out)
    return out


class Boosted:
    """Trees as lists of (feature, bound) by node and values by leaf; score() is an expression of CASEs."""

    def __init__(self, start: float, trees: list[tuple[dict[int, tuple[str, float]], dict[int, float]]]):
        self.start, self.trees = start, trees

    @staticmethod
    def _value(splits: dict, leaves: dict, node: int) -> Column:
        if node not in splits:
            return F.lit(float(leaves.get(node, 0.0)))
        name, bound = splits[node]
        return F.when(F.col(name) <= bound, Boosted._value(splits, leaves, 2 * node)).otherwise(Boosted._value(splits, leaves, 2 * node + 1))

    def score(self) -> Column:
        """Log-odds of `block`."""
        out = F.lit(float(self.start))
        for splits, leaves in self.trees:
            out = out + self._value(splits, leaves, 1)
        return out


def fit(described: DataFrame, trees: int = TREES, depth: int = DEPTH, rows: int = TRAIN_ROWS, features: tuple[str, ...] = FEATURES) -> Boosted:
    """Boosts logistic loss on labelled urls, second order, with bins at quantiles."""
    labelled = described.where(F.col("verdict").isNotNull())
    sample = labelled.orderBy("__hash", *features).limit(rows).withColumn("y", (F.col("verdict") == "block").cast("double"))
    sample = materialize(sample.select("y", *features), "url_sample")
    total = sample.agg(F.count("*").alias("n"), F.sum("y").alias("pos"), *(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 1000).alias(f) for f in features)).collect()[0]
    n, pos = total["n"], total["pos"] or 0.0
    if not n or pos in (0.0, float(n)):
        return Boosted(-4.0 if not n or not pos else 4.0, [])
    cuts = {f: sorted(set(total[f])) for f in features}
    # equal rows are one row with counts
    binned = sample.groupBy(*(_bin(F.col(f), cuts[f]).alias(f) for f in features)).agg(F.sum("y").alias("__pos"), F.count("*").cast("double").alias("__n"))
    binned = materialize(binned, "url_bins")
    start = math.log(pos / (n - pos))
    grown: list[tuple[dict, dict]] = []  # with bins for bounds
    for _ in range(trees):
        splits: dict[int, tuple[str, float]] = {}
        leaves: dict[int, float] = {}
        p = 1 / (1 + F.exp(-Boosted(start, grown).score()))
        rated = binned.withColumns({"__g": F.col("__pos") - F.col("__n") * p, "__h": F.col("__n") * p * (1 - p)})
        for level in range(depth + 1):
            long = rated.select(_node(splits).alias("node"), "__g", "__h", F.posexplode(F.array(*features)).alias("f", "b"))
            sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in long.groupBy("node", "f", "b").agg(F.sum("__g").alias("g"), F.sum("__h").alias("h")).collect():
                sums.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
            for at, by_feature in sums.items():
                if at in leaves:
                    continue
                g = sum(x for x, _ in by_feature[0].values())
                h = sum(x for _, x in by_feature[0].values())
                leaves[at] = round(RATE * g / (h + RIDGE), 9)
                best = (1e-6, None)
                for f in sorted(by_feature) if level < depth else ():
                    left_g = left_h = 0.0
                    for b in range(len(cuts[features[f]])):
                        bg, bh = by_feature[f].get(b, (0.0, 0.0))
                        left_g, left_h = left_g + bg, left_h + bh
                        if left_h > 1e-3 and h - left_h > 1e-3:
                            gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE)
                            if gain > best[0] * (1 + 1e-9):
                                best = gain, (features[f], b)
                if best[1]:
                    splits[at] = best[1]
                    del leaves[at]
            if not any(2**level <= at < 2 ** (level + 1) for at in splits):
                break
        grown.append((splits, leaves))
    return Boosted(start, [({k: (f, cuts[f][b]) for k, (f, b) in splits.items()}, leaves) for splits, leaves in grown])


def _node(splits: dict[int, tuple[str, float]], node: int = 1) -> Column:
    """The node that a row has come to."""
    if node not in splits:
        return F.lit(node)
    name, bound = splits[node]
    return F.when(F.col(name) <= bound, _node(splits, 2 * node)).otherwise(_node(splits, 2 * node + 1))


def accuracy(described: DataFrame, features: tuple[str, ...] = FEATURES) -> tuple[float, float, int]:
    """Of the labelled urls of one fold, whose labels the trees have not seen: the share of right verdicts, the share of
    the more common verdict, and their number."""
    mine = F.pmod("__hash", F.lit(FOLDS)) == 0
    model = fit(described.where(~mine), features=features)
    held = described.where(mine & F.col("verdict").isNotNull()).select((F.col("verdict") == "block").alias("y"), (model.score() > 0).alias("p"))
    n, right, blocked = held.agg(F.count("*"), F.avg((F.col("y") == F.col("p")).cast("double")), F.avg(F.col("y").cast("double"))).collect()[0]
    return right, max(blocked, 1 - blocked), n


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and the model's probability of `block`, for every page."""
    described = describe(pages, rules, key, url)
    blocked = 1 / (1 + F.exp(-fit(described).score()))
    return described.select(key, "host", "path", "rule", F.coalesce("verdict", F.when(blocked > 0.5, "block").otherwise("allow")).alias("verdict"), F.round(blocked, 6).alias("blocked"))


def url_rules(spark, sf_dir: str) -> DataFrame:
    """What op2 returns without its model: the verdict is null where no rule fits."""
    host, path = host_and_path(F.col("url"))
    base = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return base.withColumns({"rule": rule, "verdict": verdict})


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
