"""Role audits: verdicts from a model's votes, mismatches to review, calibration picks, frozen sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratelake.functions import analysis, paths
from cratelake.staging import staged

# Which class stands for which role, and the roles in their order.
CLASS_ROLE = {
    "kick": "KICKS", "snr": "CLAP-SNARE", "clp": "CLAP-SNARE", "rim": "CLAP-SNARE", "hhc": "HATS-CYM", "hho": "HATS-CYM", "cym": "HATS-CYM", "rid": "HATS-CYM",
    "cong": "PERC", "clav": "PERC", "tom": "PERC", "tomf": "PERC", "tab": "PERC", "taik": "PERC", "cah": "PERC", "wood": "PERC", "cow": "PERC", "shk": "PERC", "tim": "PERC", "stick": "PERC",
    "bass": "BASS",
}
DRUM_ROLES = ("KICKS", "CLAP-SNARE", "HATS-CYM", "PERC")


def derive(votes: DataFrame, authoritative: tuple[str, ...] = DRUM_ROLES) -> DataFrame:
    """Adds suggested_role, authoritative, agree, band and note to votes (path, current_role, top_class, top_prob)."""
    role = F.create_map(*[F.lit(x) for kv in CLASS_ROLE.items() for x in kv])
    v = votes.withColumn("suggested_role", F.coalesce(role[F.col("top_class")], F.lit("REVIEW"))).withColumn("authoritative", F.col("current_role").isin(*authoritative))
    sure = (F.col("top_prob") >= analysis.TRUST) & F.col("suggested_role").isin(*DRUM_ROLES)
    return v.withColumns({
        "agree": F.when(~F.col("authoritative"), "").when(F.col("suggested_role") == F.col("current_role"), "yes").otherwise("no"),
        "band": F.when(F.col("authoritative"), analysis.band(F.col("top_prob"))).otherwise(""),
        "note": F.when(~F.col("authoritative") & sure, "possible-drum-oneshot").otherwise(""),
    })


def summary(audit: DataFrame) -> DataFrame:
    """files, mismatched, high_confidence, agreeing and flagged of each current role."""
    no = F.col("agree") == "no"
    return audit.groupBy("current_role").agg(
        F.count("*").alias("files"), F.count_if(no).alias("mismatched"), F.count_if(no & (F.col("band") == "trust")).alias("high_confidence"),
        F.count_if(F.col("agree") == "yes").alias("agreeing"), F.count_if(F.col("note") != "").alias("flagged"),
    )


def candidate_id(path: Column, current: Column, suggested: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", path, current, suggested), 256), 1, 12)


def mismatches(audit: DataFrame) -> DataFrame:
    """Trusted disagreements: candidate_id, path, current_role, suggested_role, top_class, top_prob, source_group."""
    rows = audit.filter(F.col("authoritative") & (F.col("agree") == "no") & (F.col("band") == "trust"))
    p = F.col("path")
    return rows.select(candidate_id(p, F.col("current_role"), F.col("suggested_role")).alias("candidate_id"), "path", "current_role", "suggested_role", "top_class", "top_prob", paths.source_group(p).alias("source_group"))


def violations(audit: DataFrame, sources: tuple[str, ...] = DRUM_ROLES, destinations: tuple[str, ...] = (*analysis.ROLE_FOLDERS[:-1], "REVIEW")) -> DataFrame:
    """(path, violation) of rows whose path isn't below its role's folder, or whose roles aren't known."""
    p = paths.parts(F.col("path"))
    outside = (F.get(p, F.lit(0)) != "CURATED") | (F.coalesce(F.get(p, F.lit(1)), F.lit("")) != F.col("current_role")) | F.array_contains(p, "..")
    bad = lambda test, text: F.when(F.coalesce(test, F.lit(True)), F.lit(text))
    found = F.array_compact(F.array(bad(outside, "outside its role's folder"), bad(~F.col("current_role").isin(*sources), "unsupported source role"), bad(~F.col("suggested_role").isin(*destinations), "unsupported suggested role")))
    return audit.select("path", F.explode(found).alias("violation"))


def domain_order(column: str, domain: tuple[str, ...] = DRUM_ROLES) -> Column:
    """Sorts by the place in a fixed list."""
    return F.array_position(F.array(*map(F.lit, domain)), F.col(column))


def routes(candidates: DataFrame) -> DataFrame:
    """(place, current_role, suggested_role, n): counts of each route, source roles in their fixed order."""
    n = candidates.groupBy("current_role", "suggested_role").agg(F.count("*").alias("n"))
    return n.select(domain_order("current_role").alias("place"), "current_role", "suggested_role", "n")


def calibration(candidates: DataFrame, size: int = 10) -> DataFrame:
    """Up to ``size`` candidates (path, current_role, suggested_role, top_prob, source_group) of each route.

    The least sure one comes first; then, one at a time in all routes at once, one of a source not seen yet,
    among these the farthest in probability from those chosen, then the first path. A route's chosen rows,
    ``size`` at most, are one row that is joined to its candidates.
    """
    if size < 1:
        raise ValueError("the calibration size must be positive")
    route = ["current_role", "suggested_role"]
    rows = staged(candidates, "candidates")
    item = F.struct("path", "top_prob", "source_group")
    chosen = rows.groupBy(*route).agg(F.array(F.min_by(item, F.struct("top_prob", "path"))).alias("_chosen"))
    for _ in range(size - 1):
        left = rows.join(chosen, route).filter(~F.exists("_chosen", lambda c: c["path"] == F.col("path")))
        seen = F.exists("_chosen", lambda c: c["source_group"] == F.col("source_group"))
        gap = F.array_min(F.transform("_chosen", lambda c: F.abs(c["top_prob"] - F.col("top_prob"))))
        best = left.groupBy(*route).agg(F.min_by(item, F.struct(seen.cast("int"), -gap, "path")).alias("_next"))
        chosen = chosen.join(best, route, "left").select(*route, F.array_compact(F.concat("_chosen", F.array("_next"))).alias("_chosen"))
    return chosen.select(*route, F.explode("_chosen").alias("_c")).select(*route, "_c.*")


def digest(df: DataFrame) -> DataFrame:
    """One row, n and digest: the same for the same rows in any order."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def freeze(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write a baseline once; refuse another content later. Returns the baseline."""
    if _exists(spark, path):
        old = spark.read.parquet(path)
        if digest(old.select(*df.columns)).first() != digest(df).first():
            raise ValueError("the baseline exists with another content")
        return old
    df.write.parquet(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
