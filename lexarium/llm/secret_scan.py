"""Secret scan with corpus-wide ownership frequency. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Kind, pattern, group whose length counts, least length. Case matters but for the words of the first.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidates of the method that no base pattern names: web tokens, key headers, long tokens of mixed characters. The
#: last column has patterns that the match must also contain. They need the corpus' verdict.
MORE = (
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20, ()),
    ("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20, ()),
    ("mixed", r"[A-Za-z0-9+/_=-]{20,}", 0, 20, ("[0-9]", "[A-Z]", "[a-z]")),
)
#: Matches of one text that are put together at a time; appending to all found so far would cost their square.
CHUNK = 256
#: A value that so many owners have, or several owners in so many repositories, is an example that people copy.
OWNERS, REPOSITORIES = 3, 5


def spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int, having: tuple[str, ...] = ()) -> Column:
    """array<struct<start, ord, kind, end, value>> of the leftmost non-overlapping matches, in code points.

    Pieces between the matches and the matches alternate, so running sums of their lengths give the places.
    """
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("p"), whole.alias("m"), part.alias("v"))
    nothing = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["p"])
        end = at + F.length(x["m"])
        found = F.array(F.struct(at.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value")))
        good = F.length(x["v"]) >= least
        for p in having:
            good = good & F.regexp_like(x["v"], F.lit(p))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def of_chunk(acc: Column, chunk: Column) -> Column:
        own = F.aggregate(chunk, F.struct(acc["at"].alias("at"), nothing.alias("out")), step)
        return _bound(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

    def of_all(r: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / CHUNK).cast("int")), lambda k: F.slice(r, k * CHUNK + 1, CHUNK))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), nothing.alias("out")), of_chunk, lambda acc: acc["out"])

    return F.when(F.regexp_like(text, F.lit(pattern)), _bound(rows, of_all)).otherwise(nothing)


def _bound(c: Column, f) -> Column:
    """f of the value of c, which is evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """One row for each row of docs: id, base and all (arrays of spans), n_live, n_example.

    Base spans follow BASE. Every span's value, and every candidate of MORE, is a secret candidate; candidate hashes are
    counted over the whole corpus by distinct owners (owner_col) and repositories (owner_col, repo_col). A value that at
    least `owners` owners have, or more than one owner in at least `repositories` repositories, is a copied example; any
    other is owner-specific and looks live. `all` has the base spans
    and the owner-specific candidates of MORE that no base span covers; n_live and n_example count a row's candidates.

    Skew: texts don't move; candidates are reduced to distinct (hash, owner, repository) before the shuffle, and the
    verdicts come back in a join whose hot hashes Spark may split. Null texts count as empty. A null owner is one owner.
    Rows may repeat and ids be null: every row is told apart. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.concat(*(spans(text, kind, i, *rule) for i, (kind, *rule) in enumerate(BASE)))
    more = F.concat(*(spans(text, kind, i, *rule) for i, (kind, *rule) in enumerate(MORE, len(BASE))))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("\x00")).alias("repo"), base.alias("base"), more.alias("more"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "spans")
    free = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    cand = rows.select("rid", "owner", "repo", F.explode(F.concat("base", free)).alias("x")).withColumn("hash", F.sha2(F.col("x.value"), 256))
    own = cand.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    verdict = written(own.select("hash", ((F.col("owners") >= owners) | ((F.col("owners") > 1) & (F.col("repos") >= repositories))).alias("example")), "owners")
    told = cand.select("rid", "x", "hash").join(verdict, "hash")
    each = told.groupBy("rid").agg(F.collect_list(F.when((F.col("x.ord") >= len(BASE)) & ~F.col("example"), F.col("x"))).alias("extra"), F.count_if(~F.col("example")).alias("n_live"), F.count_if("example").alias("n_example"))
    out = rows.select("rid", "id", "base").join(written(each, "live"), "rid", "left")
    nothing = F.array().cast(out.schema["base"].dataType)
    return out.select("id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("extra", nothing))).alias("all"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
