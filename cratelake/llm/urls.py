"""Operator 13: URL filters by rules and by a tree of path templates for each host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cratelake.llm.common import staged

#: A segment stays literal where it holds at least one in so many of its parent's rows, and at least so many rows;
#: so a node has at most BRANCHES literal children and one wildcard.
BRANCHES, SUPPORT = 32, 4
#: Segments of a path that a template tells apart; what lies deeper has no part in it.
DEPTH = 8
#: Two siblings are alike if neither their share of bad rows nor that of rows which end there differs by so
#: many standard errors.
ALIKE = 1.96
#: Rows that a parent's purity counts for, and the purity above which a template is rejected.
PRIOR, REJECT = 4.0, 0.5
#: Words of hosts and paths that label a row as bad.
BAD_WORDS = ("adserver", "ads", "bet", "bets", "betting", "casino", "gambling", "pills", "poker", "porn", "viagra", "xxx")
#: The rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; empty for null and where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def matching(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does. A rule ``host/path`` fits its host
    and its subdomains where the path starts with its own; of two of one length the lesser wins. Rules
    are compiled into the plan: they are meant to be a list of hundreds at most."""
    fits = []
    for rule, verdict in rules:
        domain, slash, rest = rule.partition("/")
        own = (host_ == domain) | host_.endswith("." + domain)
        fits.append(F.when(own & path_.startswith(slash + rest), F.struct(F.lit(-len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_min(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _apart(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Whether two shares a/n and b/m differ significantly."""
    both = (a + b) / (n + m)
    return (a / n - b / m) ** 2 > ALIKE**2 * both * (1 - both) * (1 / n + 1 / m)


def _children(rows: DataFrame, level: int) -> DataFrame:
    """(host, node, names): for each node the template name of its children by their segment, ``*`` for any other."""
    seg = F.get("segs", F.lit(level)).alias("seg")
    ends = (F.size("segs") == level + 1).cast("long")
    counts = rows.filter(F.size("segs") > level).groupBy("host", "node", seg).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum(ends).alias("ends"))
    counts = staged(counts, "segments")
    total = counts.groupBy("host", "node").agg(F.sum("n").alias("total"))
    literal = (F.col("n") >= SUPPORT) & (F.col("n") * BRANCHES >= F.col("total"))
    named = counts.join(total, ["host", "node"]).withColumn("name", F.when(literal, F.col("seg")).otherwise("*"))
    kids = named.groupBy("host", "node", "name").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "ends")])
    line = Window.partitionBy("host", "node").orderBy(F.col("bad") / F.col("n"), F.col("ends") / F.col("n"), "name")
    before = {c: F.lag(c).over(line) for c in ("n", "bad", "ends")}
    new = F.coalesce(_apart(F.col("bad"), before["bad"], F.col("n"), before["n"]) | _apart(F.col("ends"), before["ends"], F.col("n"), before["n"]), F.lit(True))
    merged = kids.withColumn("_new", new.cast("int")).withColumn("_class", F.sum("_new").over(line))
    label = F.array_join(F.sort_array(F.collect_list("name")), ",")
    classes = merged.groupBy("host", "node", "_class").agg(F.collect_list("name").alias("all"), label.alias("label"))
    label = F.when(F.size("all") > 1, F.concat(F.lit("{"), F.col("label"), F.lit("}"))).otherwise(F.col("label"))
    pairs = classes.select("host", "node", F.explode("all").alias("name"), label.alias("label"))
    return pairs.groupBy("host", "node").agg(F.map_from_entries(F.collect_list(F.struct("name", "label"))).alias("names"))


def _purities(rows: DataFrame) -> DataFrame:
    """(host, node, purity): the smoothed share of bad rows of each template, its parent's counting for PRIOR rows,
    the whole table's at the top."""
    leaves = staged(rows.groupBy("host", "nodes").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "leaves")
    top = leaves.agg(F.sum("bad").cast("double").alias("bad"), F.sum("n").alias("n")).first()
    prior = top["bad"] / top["n"] if top["n"] else 0.0
    each = leaves.select("host", F.posexplode("nodes").alias("depth", "node"), "n", "bad", F.element_at("nodes", -1).alias("leaf"))
    sums = each.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    line = each.select("host", "leaf", "depth", "node").join(sums, ["host", "node"]).groupBy("host", "leaf").agg(F.sort_array(F.collect_set(F.struct("depth", "n", "bad"))).alias("line"))
    purity = F.aggregate("line", F.lit(prior), lambda p, x: (x["bad"] + F.lit(PRIOR) * p) / (x["n"] + F.lit(PRIOR)))
    return line.select("host", F.col("leaf").alias("node"), purity.alias("purity"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = (), bad_words: tuple[str, ...] = BAD_WORDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each row of pages (page_id, url).

    Labels: a row is bad if a rule blocks it or, no rule fitting, its host or path holds one of ``bad_words``; all others
    count as good, as the labels are block lists. In the tree of a host each segment of a path is a branch if it holds
    enough of its parent's rows, else a wildcard; sibling branches whose share of bad rows and of ends are statistically
    alike are merged, and grow on as one. A template whose smoothed share of bad rows is over REJECT is
    blocked, whatever words its single rows have; a rule's verdict goes before.

    Everything is aggregated by host, template and segment before it is joined; a node has at most
    BRANCHES + 1 children, so that windows over siblings are small whatever a host holds.

    Null urls and those without ``://`` have an empty host and path and are one host; empty segments don't count; a
    ``*`` or ``{`` of a segment is written %2A or %7B; repeated rows are judged each, alike; other columns
    are ignored; an empty table gives an empty result.
    """
    url = F.col("url").cast("string")
    found = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    tokens = F.split(F.lower(F.concat_ws("/", "host", "path")), "[^a-z0-9]+")
    clean = F.replace(F.replace("path", F.lit("*"), F.lit("%2A")), F.lit("{"), F.lit("%7B"))
    segs = F.slice(F.filter(F.split(clean, "/"), lambda x: x != ""), 1, DEPTH)
    rows = found.withColumn("rule", matching(F.col("host"), F.col("path"), rules)).withColumn("segs", segs)
    spoken = F.arrays_overlap(tokens, F.array(*map(F.lit, bad_words))) if bad_words else F.lit(False)
    bad = F.coalesce(F.col("rule.verdict") == "block", spoken)
    rows = staged(rows.withColumn("bad", bad.cast("long")).withColumn("node", F.lit("")).withColumn("nodes", F.array(F.lit(""))), "urls")
    deepest = rows.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(deepest):
        met = rows.join(_children(rows, level), ["host", "node"], "left")
        seg = F.get("segs", F.lit(level))
        name = F.coalesce(F.get(F.map_values(F.map_filter("names", lambda k, _: k == seg)), F.lit(0)), F.col("names")["*"])
        node = F.when(seg.isNotNull(), F.concat_ws("/", "node", name))
        met = met.withColumn("_to", node).drop("names")
        rows = staged(met.withColumn("nodes", F.when(F.col("_to").isNotNull(), F.concat("nodes", F.array("_to"))).otherwise(F.col("nodes"))).withColumn("node", F.coalesce("_to", "node")).drop("_to"), "urls")
    done = rows.join(_purities(rows), ["host", "node"])
    verdict = F.coalesce("rule.verdict", F.when(F.col("purity") > REJECT, "block").otherwise("allow"))
    template = F.concat("host", F.when(F.col("node") == "", F.lit("/")).otherwise(F.col("node")))
    return done.select("page_id", "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), template.alias("template"), "purity")


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged by the fixed rules and, where none fits, by its template."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
