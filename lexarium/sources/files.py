"""File sources: values as sources spell them, one manifestation of each act, manifests of files, exported records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import romanian_key


def iso_date(c: Column) -> Column:
    """d.m.y with . / or - as ISO; ISO stays; anything else is null."""
    t = F.trim(c)
    day = F.regexp_extract_all(t, F.lit(r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"), F.lit(0))
    parts = F.split(F.regexp_replace(F.get(day, F.lit(0)), "[/-]", "."), r"\.")
    made = F.concat_ws("-", F.lpad(F.get(parts, F.lit(2)), 4, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
    return F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), t).when(F.size(day) > 0, made)


#: Words of a consultation's status, tried in this order.
STATUS = (
    ("closed", ("inchis", "finalizat", "expirat", "arhivat")),
    ("open", ("consultare public", "in consultare", "deschis", "activ", "termen limita")),
    ("announced", ("anunt", "publicat", "transparen")),
)


def consultation_status(c: Column) -> Column:
    """open, closed, announced or unknown."""
    k = F.coalesce(romanian_key(c), F.lit(""))
    out = F.when(k.isin("open", "opened", "deschisa"), "open").when(k.isin("closed", "inchisa"), "closed").when(k.isin("announced", "anuntata"), "announced")
    for label, words in STATUS:
        for w in words:
            out = out.when(F.contains(k, F.lit(w)), label)
    return out.otherwise("unknown")


def celex_id(c: Column) -> Column:
    """A CELEX number from itself, `CELEX:...` or an address that holds one; null if there is none."""
    t = F.regexp_replace(F.trim(c), "/+$", "")
    query, path = F.regexp_extract(t, r"(?i)(?:^|[/?&])uri=CELEX:([^&#]+)", 1), F.regexp_extract(t, r"(?i)(?:^|[:/])celex[:/]([^/?#&]+)", 1)
    found = F.upper(F.trim(F.when(query != "", query).when(path != "", path).otherwise(t)))
    return F.when(F.regexp_like(found, F.lit(r"^[0-9A-Z()._-]{5,50}$")), found)


def pick_manifestation(rows: DataFrame, languages: list[str], formats: list[str]) -> DataFrame:
    """One readable manifestation(celex, language, format, url) of each act: by language, format, first document, address."""
    rank = lambda c, order: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(c)), F.lit(0).cast("long")), F.lit(len(order) + 1).cast("long"))
    order = F.struct(rank("language", languages).alias("l"), rank("format", formats).alias("f"), (~F.endswith("url", F.lit("DOC_1"))).alias("d"), "url")
    pick = F.min_by(F.struct(*rows.columns), order)
    return rows.where(F.col("format").isin(*formats)).groupBy(F.col("celex").alias("_c")).agg(pick.alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below a path; files are hashed where they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.regexp_replace("path", "^.*/", "").alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def verify(manifest_: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """(path, problem): files that are missing, changed or unknown to the manifest."""
    now = manifest(spark, path).select(F.col("path"), F.col("sha256").alias("now"))
    x = manifest_.select("path", "sha256").join(now, "path", "full")
    return x.select("path", F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("now") != F.col("sha256"), "changed").alias("problem")).where("problem is not null")


def export_records(acts: DataFrame, provisions: DataFrame, path: str) -> None:
    """One JSON record an act with its full text in order of its provisions."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    acts.join(provisions.groupBy("act").agg(text.alias("text")), "act", "left").write.mode("overwrite").json(path)
