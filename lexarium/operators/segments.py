"""A full-text index in segments: replaced documents write one small segment, deleted ones a mark, and merges bound the rest.

A segment holds its documents' tokens (`docs`) and their postings in blocks (`blocks`): one row a token and window, a window
being up to 64 documents of about one length. With a block stand the greatest frequency and the least length in it, from
which the most that any of its documents can score follows under any statistics. A search adds up these bounds by window,
scores the most promising windows first, and then reads only windows whose bound reaches the k-th score found: what the
others hold is proven to be out.

Marks (`dead`) say from which segment on a document's older rows no longer count; `gone` counts the dead documents' tokens,
so that document frequencies, mean length and thereby every score equal those of an index built anew. All of it is one
commit (see sources.commits): readers never see a segment without its marks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Commits, State
from .postings import window_blocks
from .search import _all_words, ranked

#: Documents of a window, windows scored first for each document wanted, and windows or documents whose names are broadcast
#: at most.
WINDOW, FIRST, NAMED = 64, 2, 100_000


def _term_score(tf: Column, length: Column, idf: float, mean: float, k1: float, b: float) -> Column:
    t = tf.cast("double")
    return F.lit(idf) * t * (k1 + 1) / (t + k1 * (1 - b + b * length / F.lit(mean)))


@dataclass(frozen=True)
class Found:
    """Top documents, and how many blocks of the terms there are, were read first and at last."""

    rows: DataFrame
    blocks: int
    read: int


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()):
        self.spark, self.commits, self.id, self.text, self.keep = spark, Commits(spark, path), id_col, text_col, keep

    # -------------------------------------------------------------- writing
    def _segment(self, docs: DataFrame, number: int) -> dict[str, str]:
        """Stage a segment of docs(doc, words, keep..): documents by length, so that a window's are alike.

        Windows lie within partitions, so their blocks are made where they are. Only blocks are moved; they are staged first,
        so that finding the ranges of tokens doesn't make them again.
        """
        # words are sorted as one text, which takes a fraction of a list's memory
        text = docs.select("doc", F.size("words").alias("len"), *self.keep, F.array_join("words", " ").alias("text"))
        sized = text.sortWithinPartitions("len", "doc").withColumn("at", F.monotonically_increasing_id())
        words = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " ")).alias("words")
        d = self.commits.stage("docs", sized.select(F.lit(number).alias("segment"), "doc", "len", F.shiftright("at", WINDOW.bit_length() - 1).alias("window"), words, *self.keep))
        told = self.commits.read(State(tables={"docs": [d]}), "docs")
        made = self.commits.stage("unsorted", window_blocks(told))
        blocks = self.commits.read(State(tables={"unsorted": [made]}), "unsorted").select(F.lit(number).alias("segment"), "token", "window", "n", "most", "least", "postings")
        return {"docs": d, "blocks": self.commits.stage("blocks", blocks.repartitionByRange("token", "window").sortWithinPartitions("token", "window"))}

    def _sizes(self, folder: str) -> tuple[int, int]:
        r = self.commits.read(State(tables={"docs": [folder]}), "docs").agg(F.count("*").alias("n"), F.sum("len").alias("l")).first()
        return r["n"], r["l"] or 0

    def _words(self, docs: DataFrame) -> DataFrame:
        # the generator keeps the optimizer from making the words again for each use
        return docs.select(F.col(self.id).alias("doc"), *self.keep, F.explode(F.array(_all_words(F.coalesce(F.col(self.text), F.lit(""))))).alias("words"))

    def put(self, docs: DataFrame) -> State:
        """Add documents; those that are there already (by id) are replaced. Writes one segment, whatever else there is."""
        return self._change(docs, None)

    def delete(self, ids: DataFrame) -> State:
        """Take documents (a column of ids) out; nothing but marks is written."""
        return self._change(None, ids)

    def _change(self, docs: DataFrame | None, ids: DataFrame | None) -> State:
        base = self.commits.latest()
        number = base.facts.get("next", 0)
        facts, tables = dict(base.facts.get("segments", {})), {k: list(v) for k, v in base.tables.items()}
        if base.tables.get("docs"):
            gone_ids = (docs.select(F.col(self.id).alias("doc")) if docs is not None else ids.toDF("doc")).distinct()
            gone_ids = F.broadcast(gone_ids) if gone_ids.count() <= NAMED else gone_ids
            live = self.live(base).join(gone_ids, "doc", "left_semi")
            marks = self.commits.stage("dead", live.select("segment", "doc", "len", "words"))
            dead = self.commits.read(State(tables={"dead": [marks]}), "dead")
            lost = {str(r["segment"]): (r["n"], r["l"]) for r in dead.groupBy("segment").agg(F.count("*").alias("n"), F.sum("len").alias("l")).collect()}
            if lost:
                tokens = dead.select("segment", F.explode(F.array_distinct("words")).alias("token")).groupBy("segment", "token").agg(F.count("*").alias("n"))
                tables["dead"] = [*tables.get("dead", []), marks]
                tables["gone"] = [*tables.get("gone", []), self.commits.stage("gone", tokens.repartitionByRange("token").sortWithinPartitions("token"))]
                facts = {k: {**v, "dead": v["dead"] + lost.get(k, (0, 0))[0], "dead_len": v["dead_len"] + lost.get(k, (0, 0))[1]} for k, v in facts.items()}
        if docs is not None:
            new = self._segment(self._words(docs), number)
            n, length = self._sizes(new["docs"])
            facts[str(number)] = {**new, "n": n, "len": length, "dead": 0, "dead_len": 0}
            for name in ("docs", "blocks"):
                tables[name] = [*tables.get(name, []), new[name]]
        return self.commits.commit(base, tables, {"segments": facts, "next": number + 1})

    def merge(self, most: int = 8) -> State:
        """Keep at most `most` segments: the smallest ones (and any that are mostly dead) are put together into one, without
        their dead documents, so that a large segment isn't rewritten for a few small ones."""
        base = self.commits.latest()
        facts = dict(base.facts.get("segments", {}))
        by_size = sorted(facts, key=lambda k: (facts[k]["n"] - facts[k]["dead"], int(k)))
        small = by_size[: len(facts) - most + 1] if len(facts) > most else []
        small += [k for k in by_size[len(small) :] if 2 * facts[k]["dead"] > facts[k]["n"]]
        if not small:
            return base
        numbers, number = [int(k) for k in small], base.facts["next"]
        new = self._segment(self.live(base).where(F.col("segment").isin(numbers)).select("doc", *self.keep, "words"), number)
        n, length = self._sizes(new["docs"])
        old = [facts.pop(k) for k in small]
        facts[str(number)] = {**new, "n": n, "len": length, "dead": 0, "dead_len": 0}
        tables = {name: [f for f in base.tables[name] if f not in {x[name] for x in old}] + [new[name]] for name in ("docs", "blocks")}
        for name in ("dead", "gone"):  # marks of segments that are no more
            if base.tables.get(name):
                left = self.commits.read(base, name).where(~F.col("segment").isin(numbers))
                tables[name] = [self.commits.stage(name, left)]
        return self.commits.commit(base, tables, {"segments": facts, "next": number + 1})

    # -------------------------------------------------------------- reading
    def live(self, state: State | None = None) -> DataFrame:
        """(segment, doc, len, window, words, keep..) of the documents that count."""
        state = state or self.commits.latest()
        return self._without_dead(self.commits.read(state, "docs"), state)

    def _without_dead(self, rows: DataFrame, state: State) -> DataFrame:
        if not state.tables.get("dead"):
            return rows
        dead = self.commits.read(state, "dead").select("segment", "doc")
        few = sum(s["dead"] for s in state.facts.get("segments", {}).values()) <= NAMED
        return rows.join(F.broadcast(dead) if few else dead, ["segment", "doc"], "left_anti")

    def sizes(self, state: State) -> tuple[int, int]:
        """Documents that count, and all their words."""
        own = state.facts.get("segments", {}).values()
        return sum(s["n"] - s["dead"] for s in own), sum(s["len"] - s["dead_len"] for s in own)

    def frequencies(self, state: State | None = None, terms: list[str] | DataFrame | None = None) -> DataFrame:
        """(token, n): documents of each token, or of these terms (a list, or tokens in a column), from the blocks' counts alone."""
        state = state or self.commits.latest()
        only = lambda d: d if terms is None else d.join(terms, "token", "left_semi") if isinstance(terms, DataFrame) else d.where(F.col("token").isin(*terms))
        n = only(self.commits.read(state, "blocks")).select("token", F.col("n").cast("long").alias("n"))
        if state.tables.get("gone"):
            n = n.unionAll(only(self.commits.read(state, "gone")).select("token", -F.col("n")))
        return n.groupBy("token").agg(F.sum("n").alias("n")).where("n > 0")

    def postings(self, terms: list[str], state: State | None = None) -> DataFrame:
        """(segment, doc, len, token, tf) of the terms, of documents that count."""
        state = state or self.commits.latest()
        return self._without_dead(self._opened(self._blocks(state, terms)), state)

    def _blocks(self, state: State, terms: list[str]) -> DataFrame:
        return self.commits.read(state, "blocks").where(F.col("token").isin(*terms))

    def _opened(self, blocks: DataFrame) -> DataFrame:
        return blocks.select("segment", "token", F.explode("postings").alias("p")).select("segment", "p.doc", "p.len", "token", "p.tf")

    def coverage(self, terms: list[str], limit: int = 25) -> DataFrame:
        """(doc, score): documents by the number of different terms they have, ties by id."""
        return self.postings(terms).groupBy("doc").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "doc").limit(limit)

    def search(self, terms: list[str], k: int = 20, k1: float = 1.2, b: float = 0.75) -> Found:
        """BM25, ties by id, from the windows that can hold a top document; hydrate() the rows with what else is kept."""
        state, terms = self.commits.latest(), list(dict.fromkeys(terms))
        shape = "doc " + (self.commits.read(state, "docs").schema["doc"].dataType.simpleString() if state.tables.get("docs") else "bigint") + ", score double"
        df = {r["token"]: r["n"] for r in self.frequencies(state, terms).collect()} if state.tables.get("docs") and terms else {}
        n, length = self.sizes(state)
        if not df or not length:
            return Found(self.spark.createDataFrame([], shape), 0, 0)
        terms, mean = [t for t in terms if t in df], length / n
        stats = self.spark.createDataFrame([(n, mean, *(df[t] for t in terms))], "_n long, _mean double, " + ", ".join(f"_d{i} long" for i in range(len(terms))))
        most = F.lit(0.0)
        for t in terms:
            idf = log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            most = F.when(F.col("token") == t, _term_score(F.col("most"), F.col("least"), idf, mean, k1, b)).otherwise(most)
        bounds = self._blocks(state, terms).select("segment", "window", most.alias("m")).groupBy("segment", "window").agg(F.sum("m").alias("bound"), F.count("*").alias("blocks"))

        def scored(windows: DataFrame, count: int) -> DataFrame:
            windows = F.broadcast(windows) if count <= NAMED else windows
            p = self._without_dead(self._opened(self._blocks(state, terms).join(windows, ["segment", "window"], "left_semi")), state)
            tf = [F.coalesce(F.sum(F.when(F.col("token") == t, F.col("tf"))), F.lit(0)).alias(f"t{i}") for i, t in enumerate(terms)]
            return ranked(p.groupBy("doc", "len").agg(*tf), len(terms), k1, b, stats).orderBy(F.desc("score"), "doc").limit(k)

        total = bounds.agg(F.sum("blocks").alias("b")).first()["b"]
        # the windows of the greatest bounds: k of their documents are as good as the least that counts
        best = scored(bounds.orderBy(F.desc("bound"), "segment", "window").limit(FIRST * k).select("segment", "window"), FIRST * k).collect()
        least = best[k - 1]["score"] if len(best) == k else 0.0
        enough = bounds.where(F.col("bound") >= least - 1e-6)
        r = enough.agg(F.sum("blocks").alias("b"), F.count("*").alias("n")).first()
        return Found(scored(enough.select("segment", "window"), r["n"]), total, r["b"] or 0)

    def hydrate(self, top: DataFrame) -> DataFrame:
        """Top documents with the kept columns."""
        return top.join(self.live().select("doc", *self.keep), "doc")

