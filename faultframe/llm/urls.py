"""URL filter: rules first, and for what no rule fits a logistic regression on hashed character n-grams."""

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

ALLOW, BLOCK = "allow", "block"
GRAMS = (3, 4)
FEATURES = 1 << 15
# The classifier is fitted on about this many labelled URLs, drawn by a hash of the URL.
SAMPLE_URLS = 20_000
ROUNDS = 25


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)


def host_and_path(url: str) -> tuple[Column, Column]:
    """What follows the first `://`: host (A-Z lower-cased) up to `/`, `?` or `#`, then path up to `?` or `#`.

    Both are empty for NULL and for a URL without `://`.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules, pick) -> Column:
    """`pick` of the longest rule that fits, the first listed among equals; NULL if none does."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    ordered = sorted(rules, key=lambda r: -len(r.text))
    return F.coalesce(*[F.when(fits(r), F.lit(pick(r))) for r in ordered], F.lit(None).cast("string"))


def vectors(parts: DataFrame) -> DataFrame:
    """Adds `features`: the hashed n-grams of `host` and of `path`, each with its borders marked."""
    marked = lambda c, mark: F.concat(F.array(F.lit(mark)), F.transform(F.split(c, ""), lambda x: F.concat(F.lit(mark), x)), F.array(F.lit(mark)))
    parts = parts.withColumn("__letters", F.concat(marked("host", "h"), marked("path", "p")))
    for n in GRAMS:
        parts = NGram(n=n, inputCol="__letters", outputCol=f"__grams{n}").transform(parts)
    parts = parts.withColumn("__grams", F.concat(*[f"__grams{n}" for n in GRAMS]))
    found = HashingTF(numFeatures=FEATURES, binary=True, inputCol="__grams", outputCol="features").transform(parts)
    return found.drop("__letters", "__grams", *[f"__grams{n}" for n in GRAMS])


def fit(labelled: DataFrame, sample_urls=SAMPLE_URLS):
    """A model from a small labelled table (url, verdict). Without both verdicts in it, the one there is, or allow."""
    labelled = labelled.where(F.col("verdict").isin(ALLOW, BLOCK))
    draw = F.shiftrightunsigned(F.xxhash64("url", F.lit("url sample")), 11) / float(1 << 53)
    n = labelled.count()
    host, path = host_and_path("url")
    sample = labelled.where(draw < min(1.0, sample_urls / max(1, n)))
    sample = vectors(sample.select(host.alias("host"), path.alias("path"), (F.col("verdict") == BLOCK).cast("double").alias("label")))
    classes = [r.label for r in sample.select("label").distinct().collect()]
    if len(classes) < 2:
        return BLOCK if classes == [1.0] else ALLOW
    return LogisticRegression(maxIter=ROUNDS, regParam=1e-4, standardization=False).fit(sample.select("features", "label"))


def judge(pages: DataFrame, model, rules=RULES) -> DataFrame:
    """`pages` (url and any others) with host, path, rule, block_score and verdict; columns of these names are replaced.

    block_score is the model's probability of block (NULL if it is a constant); from 0.5 the model blocks.
    """
    host, path = host_and_path("url")
    parts = pages.drop("host", "path", "rule", "verdict", "block_score", "features")
    parts = parts.withColumns({"host": host, "path": path})
    own = longest_rule(F.col("host"), F.col("path"), rules, lambda r: r.text)
    ruled = longest_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict)
    parts = parts.withColumns({"rule": own, "__ruled": ruled})
    if isinstance(model, str):
        scored = parts.withColumn("block_score", F.lit(None).cast("double"))
        said = F.lit(model)
    else:
        names = {c: c for c in ("rawPrediction", "probability", "prediction") if c in parts.columns}
        kept = parts.withColumnsRenamed({c: f"__own_{c}" for c in names})
        scored = model.transform(vectors(kept)).withColumn("block_score", vector_to_array("probability")[1])
        scored = scored.drop("rawPrediction", "probability", "prediction", "features").withColumnsRenamed({f"__own_{c}": c for c in names})
        said = F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.withColumn("verdict", F.coalesce("__ruled", said)).drop("__ruled")


def labelled_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, verdict) of the pages that a rule decides: the labelled table where there is no better one."""
    host, path = host_and_path("url")
    return pages.select("url", longest_rule(host, path, rules, lambda r: r.verdict).alias("verdict")).where("verdict is not null")
