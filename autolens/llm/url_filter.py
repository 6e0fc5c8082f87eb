"""URL verdicts by rules and, where none fits, by logistic regression on hashed character n-grams.

DataFrame and SQL functions only; the regression is Spark's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage

#: (verdict, host, path)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)

#: Fixed values, the words of the labelled table: what blocklists are sorted by, what goes with it in host
#: names, and words of ordinary sites, among them some that share letters with the unwanted ones.
UNWANTED = (
    "casino poker slots jackpot roulette bets betting lottery bingo pills viagra pharmacy meds steroids adult porn xxx "
    "sex cams escort nude ads adserver banners popups tracking spam backlinks phishing malware keygen warez crack "
    "torrents loans payday prizes replica"
).split()
ATTACHED = "online best cheap free hot live club king win bonus now buy cash top fast real super zone x 24".split()
ORDINARY = (
    "news library museum weather theatre garden recipes university school hospital journal science history city "
    "council travel cycling music radio books kitchen bakery mountain river nation station mother brother thesis theory "
    "health earth north south method author region painting building reading writing engineering fishing farm parents "
    "children student teacher together other rather than this that track window winter wine sussex essex middlesex "
    "adventure address medicine medieval classics cameras software freedom cinema spanish shop hand than action motion "
    "thread thrush birth tower table stable notes island harbour handmade landscape kingdom clubhouse bonsai basin"
).split()
_PREFIXES = ("", "www.", "", "m.", "blog.", "")
_PATHS = (
    "", "/", "/index.html", "/about", "/articles/12", "/en/guide", "/2021/05/", "/shop?item=3", "/fr/", "/login", "/de/7.html",
    "/es/kontakt/", "/news/64#more",
)

GRAMS = (3, 4, 5)
BUCKETS = 4096
#: The best of five on a fifth of the labelled hosts held out.
PENALTY = 0.00001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case and the path; both empty for a null url or one without `://`.

    The host runs from after the first `://` to the next `/`, `?`, `#` or the end, the
    path from there to `?`, `#` or the end.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return lower_ascii(host), path


def rule_struct(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits as `(size, rule, verdict)`, or null.

    A rule fits its host and all subdomains, if the path starts with the rule's; of
    equally long rules the one listed first.
    """
    found = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(
            fits, F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the distinct character n-grams of host and path; a text shorter than n has none of n."""
    def of(text: Column, mark: int, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts, lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(n)), F.lit(mark)), F.lit(buckets)).cast("int")
        )

    marked = [F.concat(F.lit("^"), host, F.lit("$")), lower_ascii(path)]
    return F.array_distinct(F.concat(*[of(t, mark, n) for mark, t in enumerate(marked) for n in GRAMS]))


def label_rows() -> list[tuple[str, float]]:
    """The labelled table by rule: `(url, 1 unwanted or 0)`.

    Each unwanted word stands alone, with others of its kind and with words that go with it, each
    ordinary one alone and with others, with and without a hyphen. Prefixes and paths go round
    over both alike, so that they tell nothing.
    """
    def paired(words: Sequence[str], others: Sequence[str], steps: Sequence[int]) -> list[str]:
        names = []
        for i, w in enumerate(words):
            for j, step in enumerate(steps):
                other = others[(i * 7 + step) % len(others)]
                if other != w:
                    names.append((f"{w}-{other}", f"{other}-{w}", f"{w}{other}", f"{other}{w}")[(i + j) % 4])
        return names

    bad = [*UNWANTED, *paired(UNWANTED, ATTACHED, (0, 3, 5, 11, 13, 16)), *paired(UNWANTED, UNWANTED, (5,)), *paired(UNWANTED, ORDINARY, (2, 9))]
    good = [*ORDINARY, *paired(ORDINARY, ORDINARY, (4, 17, 29)), *paired(ORDINARY, ATTACHED, (1,))]
    return [
        (f"http://{_PREFIXES[i % len(_PREFIXES)]}{name}.{('test', 'example')[i % 2]}{_PATHS[i % len(_PATHS)]}", label)
        for names, label in ((bad, 1.0), (good, 0.0))
        for i, name in enumerate(dict.fromkeys(names))
    ]


def labelled(spark: SparkSession) -> DataFrame:
    """`(url, blocked)` of the labelled table."""
    rows = F.array(*[F.struct(F.lit(url).alias("url"), F.lit(label).alias("blocked")) for url, label in label_rows()])
    return spark.range(1, numPartitions=1).select(F.explode(rows).alias("row")).select("row.*")


def train(table: DataFrame, buckets: int = BUCKETS) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept; `buckets` numbers come to the driver."""
    host, path = host_and_path(F.col("url"))
    found = grams(host, path, buckets)
    norm = F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.array_contains(F.col("g"), i).cast("double") / F.col("norm"))
    # Written first, so that the n-grams are not made anew for each of the buckets.
    held = Stage(table.select(found.alias("g"), norm.alias("norm"), "blocked"))
    rows = held.read().select(array_to_vector(dense).alias("features"), "blocked")
    model = LogisticRegression(labelCol="blocked", regParam=PENALTY, maxIter=100, standardization=False).fit(rows)
    held.drop()
    return model.coefficients.toArray().tolist(), float(model.intercept)


def score(host: Column, path: Column, weights: Sequence[float], intercept: float) -> Column:
    """Probability that a page is unwanted."""
    # One literal array: a constant of the plan and not 4096 expressions for each row.
    table = F.from_json(F.lit("[" + ",".join(repr(float(w)) for w in weights) + "]"), "array<double>")
    found = grams(host, path, len(weights))
    total = F.aggregate(found, F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    norm = F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))
    return 1 / (1 + F.exp(-(total / norm + F.lit(intercept))))


def verdicts(
    pages: DataFrame, rules: Sequence[Rule] = RULES, table: DataFrame | None = None, threshold: float = 0.5
) -> DataFrame:
    """`(page_id, host, path, rule, verdict, score)`, one row per input row.

    The longest fitting rule decides; else the regression, `block` from `threshold` on.
    A null or malformed url has an empty host and path, fits no rule and is judged by
    the regression like any other. Null page_ids stay null, repeated rows come back each,
    other columns are ignored, an empty table gives no row.
    """
    weights, intercept = train(table if table is not None else labelled(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule_struct(rules, F.col("host"), F.col("path")).alias("found"))
    rows = rows.select("*", score(F.col("host"), F.col("path"), weights, intercept).alias("score"))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_model).alias("verdict"), "score",
    )
