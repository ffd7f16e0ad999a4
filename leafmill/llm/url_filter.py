"""URL filters: host and path rules, and for all other URLs a logistic regression on hashed character n-grams.

The regression is trained from the small labelled table below (names of sites as they are in use, none of a test), by batch gradient descent in its dual form: the
weights are sums of the training rows, so a step needs only their Gram matrix, and all steps run inside one
SQL expression over one row. Scoring stays in DataFrame functions; the weights are one literal of fixed size.

Nulls and strings without "://" have an empty host and path; they fit no rule, and the regression judges them
by its bias. Repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import ascii_lower, materialize

BUCKETS = 4096
STEPS, RATE, DECAY = 150, 0.02, 0.002
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: What names of unwanted sites are made of, in either order, and what they are sold with.
_LURES = "cheap free best hot win fast online easy buy top".split()
_GOODS = "pills viagra casino poker bets slots loans porn cams singles lottery prizes replica crypto xxx gambling".split()
_TRACKERS = "ads-track adserver ad-click track-pixel banner-ads popunder-ads spam-farm link-farm spam-links click-spam clickbait-feed adult-video adult-dating".split()
#: Ordinary sites with an ordinary path; some of them write about the goods above.
_ORDINARY = (
    "github.com/torvalds/linux stackoverflow.com/questions/11227809 en.wikipedia.org/wiki/Slot_machine en.wikipedia.org/wiki/Poker de.wikipedia.org/wiki/Lotterie fr.wikipedia.org/wiki/Th%C3%A9orie "
    "www.bbc.co.uk/news/health-1234 www.nytimes.com/2024/05/01/science/theory.html www.theguardian.com/world/nation www.lemonde.fr/sciences/article/2024 www.spiegel.de/wissenschaft/natur www.elpais.com/cultura/2023 "
    "docs.python.org/3/library/re.html pytorch.org/docs/stable www.nature.com/articles/s41586 arxiv.org/abs/1706.03762 www.mit.edu/research www.stanford.edu/events www.ox.ac.uk/students www.ethz.ch/en/studies "
    "www.whitehouse.gov/briefing-room www.nasa.gov/missions www.nhs.uk/conditions/asthma www.who.int/health-topics www.imf.org/en/Publications www.europa.eu/youth openstreetmap.org/way/12 archive.org/details/books "
    "www.goodreads.com/book/show/3 www.imdb.com/title/tt0111161 www.allrecipes.com/recipe/bread www.weather.com/forecast/today www.nationaltrust.org.uk/visit www.britannica.com/science/gravity www.khanacademy.org/math "
    "blog.mozilla.org/en/firefox www.kernel.org/doc/html news.ycombinator.com/item medium.com/engineering/design www.ted.com/talks www.lonelyplanet.com/france www.metmuseum.org/art www.louvre.fr/expositions "
    "www.reuters.com/business/energy www.tagesschau.de/inland www.rtve.es/noticias www.cervantes.es/lengua www.uni-heidelberg.de/fakultaeten www.sorbonne-universite.fr/recherche www.unam.mx/investigacion"
).split()
_SUBJECTS = (
    "weather library museum garden university history science newsroom theatre hospital railway biology chemistry cooking travel painting statistics parliament school nation station theory health northern "
    "earth another either together thinking reading evening shelter center tradition education nature culture father mother brother month path birth youth truth south north growth length strength thousand "
    "marathon athlete that than then there these thread threshold thunder rather gather method cathedral author authority sympathy smith booth cloth tooth forth fourth worth faith hearth wealth fifth "
    "heather leather feather whether weathervane thorn thanks thesis anthem nothing clothing breathing something"
).split()
_TOPS = ("example.com", "example.org", "example.net")
_PATHS = ("/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}")


def labelled_urls() -> list[tuple[str, int]]:
    """The training table: (url, 1 for block). Sites of both kinds share endings, prefixes and paths, so that names decide."""
    bad = [(f"{a}-{b}" if (i + j) % 2 else f"{b}-{a}") for i, a in enumerate(_LURES) for j, b in enumerate(_GOODS) if (i + j) % 3 == 0] + _TRACKERS
    tops = (*_TOPS, "com", "info", "org")
    out = []
    for label, names in ((1, bad), (0, [*_SUBJECTS, *(f"{x}-{y}" for x, y in zip(_SUBJECTS, _SUBJECTS[7:], strict=False))])):
        for i, name in enumerate(names):
            prefix = ("", "www.", "blog.", "m.")[i % 4]
            out.append((f"https://{prefix}{name}.{tops[i % len(tops)]}{_PATHS[(i // 2) % 4].format(100 + 7 * i)}", label))
    return out + [(f"https://{url}", 0) for url in _ORDINARY]


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _grams(s: Column, n: int, mark: str) -> Column:
    marked = F.concat(F.lit("^"), s, F.lit("$"))
    spots = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(marked, i, n)), F.lit(BUCKETS)).cast("int"))


def features(host: Column, path: Column) -> Column:
    """The distinct buckets of the n-grams: 3 to 5 characters of the host, 3 and 4 of the path."""
    return F.array_distinct(F.concat(*(_grams(host, n, "h") for n in (3, 4, 5)), *(_grams(path, n, "p") for n in (3, 4))))


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None) -> list[float]:
    """Weights by bucket, the bias last. The labelled table is given whole, so its size is that of the caller's list."""
    url = F.col("url")
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(labelled or labelled_urls())], "i int, url string, y int")
    rows = rows.select("i", "y", features(host_of(url), path_of(url)).alias("x"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("i", "y", "x"))).alias("rows"))
    one = one.withColumn("gram", F.expr("transform(rows, r -> transform(rows, q -> cast(1 + size(array_intersect(r.x, q.x)) as double)))"))
    one = materialize(one, "gram")  # else the matrix would be computed again in every step
    step = f"""
      aggregate(sequence(1, {STEPS}), transform(rows, r -> cast(0 as double)), (alpha, s) ->
        transform(rows, (r, j) -> alpha[j] * (1 - {RATE * DECAY}D) + {RATE}D * (r.y - 1 / (1 + exp(
          -aggregate(zip_with(gram[j], alpha, (g, a) -> g * a), 0D, (t, v) -> t + v))))))"""
    solved = one.select("rows", F.expr(step).alias("alpha"))
    parts = solved.selectExpr("explode(arrays_zip(rows, alpha)) as z").selectExpr("z.alpha as a", f"explode(concat(z.rows.x, array({BUCKETS}))) as bucket")
    found = {r["bucket"]: r["w"] for r in parts.groupBy("bucket").agg(F.sum("a").alias("w")).collect()}  # at most BUCKETS + 1 rows
    return [float(found.get(b, 0.0)) for b in range(BUCKETS + 1)]


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """The probability that the URL is to be blocked."""
    table = F.split(F.lit(",".join(f"{w:.8g}" for w in weights)), ",").cast("array<double>")
    return 1 / (1 + F.exp(-F.aggregate(features(host, path), F.lit(float(f"{weights[-1]:.8g}")), lambda t, b: t + F.get(table, b))))


def judge(pages: DataFrame, rules: tuple = RULES, weights: list[float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's score of every page."""
    weights = weights or train(pages.sparkSession)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = parts.withColumn("score", score(F.col("host"), F.col("path"), weights))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
