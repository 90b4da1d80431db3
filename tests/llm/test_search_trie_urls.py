"""The URL filter, the ranked search and the prefix trie against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexarium.llm import prefix_trie, queries, ranked_search, url_filter

# ------------------------------------------------------------------ URL filter
URLS = [None, "", "no scheme/net/", "http://NET/", "http://a.net", "http://a.net?x", "https://anet/", "https://m.Example.net/en/x?y#z", "http://example.net/en", "http://xexample.com/de/", "http://example.com/de/", "x://a.b.org/fr/#", "http://a.org/FR/", "://net/x", "http://u@net:80/", "a://b://example.com/de/", "https://example.net/en/../de", "http://net/\nen"]


def judged(url):
    """host, path and rule by hand."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r, _ in queries.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    return host, path, max(fits, key=len, default=None)


def test_rules_are_as_stated(spark):
    d = spark.createDataFrame([(i, u, "s", "mine") for i, u in enumerate(URLS)] + [(2, URLS[7], "s", "mine")], "page_id long, url string, _lx_score string, row string")
    got = url_filter.url_filter(d, queries.RULES).collect()
    assert len(got) == d.count()
    for r in got:
        host, path, rule = judged(r["url"])
        assert (r["_lx_host"], r["_lx_path"], r["_lx_rule"], r["row"]) == (host, path, rule, "mine")
        assert r["_lx_verdict"] == dict(queries.RULES)[rule] if rule else r["_lx_verdict"] in ("allow", "block")


def test_rules_on_all_pages(spark):
    for r in queries.op11_url_filter(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url"), "page_id").collect():
        assert (r["host"], r["path"], r["rule"]) == judged(r["url"])


def test_trees_learn_what_urls_look_like(spark):
    rng = random.Random(3)
    word = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        host = word(rng.randint(4, 9), "abcdefgh") + (f"-{word(4, '0123456789')}" if bad and rng.random() < 0.8 else "") + f".{rng.choice(['com', 'org', 'info'])}"
        rows.append((f"https://{host}/{word(6, 'aeiourst')}" + (f"?id={word(12, '0123456789abcdef')}&s={word(5, 'xyz')}" if bad and rng.random() < 0.8 else ""), int(bad), i % 2 == 0))
    d = spark.createDataFrame(rows, "url string, y int, seen boolean")
    got = [(r["y"], r["_lx_score"]) for r in url_filter.url_filter(d, [], label=F.when(F.col("seen"), F.col("y"))).where("not seen").collect()]
    good, bad = ([s for y, s in got if y == v] for v in (0, 1))
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert auc > 0.9


def test_url_filter_without_examples(spark):
    d = spark.createDataFrame([("http://a.net/",), ("http://b.com/",)], "url string")
    assert {r["_lx_verdict"] for r in url_filter.url_filter(d, [("net/", "block")]).collect()} == {"block"}
    assert {r["_lx_verdict"] for r in url_filter.url_filter(d, []).collect()} == {"allow"}
    assert url_filter.url_filter(d.limit(0), queries.RULES).count() == 0


def test_hot_and_rare_suffixes_meet_their_counts(spark):
    d = spark.createDataFrame([(f"http://h{i % 3}.hot.com/{i}" if i % 2 else f"http://r{i}.x{i}.org/",) for i in range(4000)], "url string")
    f = url_filter.featured(d.select("url", url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path"), F.lit(None).cast("int").alias("label"), F.struct("url").alias("row")))
    assert {(r["domain"], round(math.expm1(r["f_domain_n"])), round(math.expm1(r["f_top_n"]))) for r in f.select(F.regexp_extract("host", r"[^.]*\.[^.]*$", 0).alias("domain"), "f_domain_n", "f_top_n").collect() if r["domain"] in ("hot.com", "x0.org")} == {("hot.com", 2000, 2000), ("x0.org", 1, 2000)}


# ------------------------------------------------------------------ ranked search
def ranked(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, at, i, s) for at, (_, _, i, s) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("share", "most"), [(1, 1), (40_000, 30), (ranked_search.SHARD, ranked_search.BLOCK)])
def test_search_is_exact_on_odd_rows(spark, odd, share, most):
    items = [(1, "Apache the License"), (1, "Apache the License"), (2, None), (3, " ,"), (4, "nothing of it"), (None, "one TWO word5 word5"), (5, "é word19999")]
    q = spark.createDataFrame(items, "item_id long, text string")
    d = odd.unionByName(odd.sparkSession.createDataFrame([(9, "Éa é\x00e É", None, None, None, None), (8, "tie one", None, None, None, None), (7, "tie one", None, None, None, None)], odd.schema)).repartition(3)
    got = ranked_search.search(ranked_search.build_index(d, share=share), q, k=3, most=most).collect()
    assert sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in got), key=str) == ranked([(r["doc_id"], r["text"]) for r in d.collect()], items, 3)


def test_search_of_nothing(spark, none, odd):
    q = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build_index(none), q).count() == 0
    assert ranked_search.search(ranked_search.build_index(odd), q.limit(0)).count() == 0


@pytest.mark.parametrize(("scores", "k", "places"), [([0, 0, 0], 2, []), ([5, 5, 5, 5], 2, [0, 1]), ([1, 9, 5, 5, 0, 5], 3, [1, 2, 3]), ([3, 0, 1], 5, [0, 2]), ([0, 7, 0, 0], 3, [1])])
def test_selection_settles_ties(scores, k, places):
    import numpy as np

    assert sorted(ranked_search.best(np.array(scores, np.int64), k)) == places


# ------------------------------------------------------------------ prefix trie
def trie(convs):
    """Nodes of {conv: [(role, text), ..]} by hand: {(conv, depth): (parent, n, kids, leaves, saved, ends)}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = {}
    for p, m in members.items():
        kids = [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        under = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in under)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(kids), leaves, sum((len(members[q]) - 1) * words(q) for q in under), hashlib.sha256(ends.encode()).hexdigest())
    return out


def told(nodes):
    return {(r["conv"], r["depth"]): (r["parent"], r["n"], r["kids"], r["leaves"], r["saved"], r["ends"] or prefix_trie.NO_ENDS) for r in nodes}


@pytest.mark.parametrize("seed", range(30))
def test_sweeps_of_any_cut_stitch_to_one_trie(seed):
    rng = random.Random(seed)
    turns = [("u", "a"), ("u", "b b"), ("s", "")]
    convs = {c: [rng.choice(turns) for _ in range(rng.randint(0, 4))] for c in rng.sample(range(-50, 50), 40)}
    key = {t: str(i) * prefix_trie.UNIT for i, t in enumerate(turns)}
    rows = sorted(("".join(key[t] for t in p), c, [len(t[1].split()) for t in p]) for c, p in convs.items())
    cuts = sorted(rng.sample(range(len(rows) + 1), rng.randint(0, 12)))

    class Kept(prefix_trie._Rows):
        def __init__(self):
            self.rows = []

        def full(self, at_end=False):
            return iter(())

    out = Kept()
    for task, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        list(prefix_trie.sweep(iter(rows[a:b]), task, out))
    kind = lambda k: [r for r in out.rows if r["kind"] == k]
    over = Kept()
    list(prefix_trie.stitch(sorted(kind("open"), key=lambda r: (r["task"], r["side"], r["depth"])), over))
    refs = {(r["task"], r["side"], r["depth"]): r["conv"] for r in over.rows if r["kind"] == "ref"}
    ends = {}
    for r in sorted(kind("ids"), key=lambda r: (r["task"], r["side"], r["seq"])):
        ends.setdefault((refs[r["task"], r["side"], r["depth"]], r["depth"]), []).append(r["ids"])
    top = [{"parent": None} | r for r in over.rows if r["kind"] == "node"]
    for r in top:
        if (r["conv"], r["depth"]) in ends:
            r["ends"] = hashlib.sha256(",".join(ends[r["conv"], r["depth"]]).encode()).hexdigest()
    nodes = kind("node") + [r | {"parent": refs[r["task"], r["side"], r["depth"] - 1]} for r in kind("child")] + top
    assert len(nodes) == len(told(nodes)) and told(nodes) == trie(convs)


def test_trie_of_odd_rows(spark):
    rows = [(c, t, "user" if t != 1 else None, f"first {c // 20}" if t == 0 else None if c % 3 else f"turn {t} of\tmany ") for c in range(60) for t in range(c % 5)]
    rows += [(None, 0, "user", "x"), (7, None, "a", "early"), (8, 2, "user", "twice"), (8, 2, "user", "twice"), (9, 3, "b", "tie"), (9, 3, "a", "tie"), (100, 5, None, None), (200, 1, "user", "w " * 50_000)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, conv int").repartition(5)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    own = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", sha(r[3]))):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    want = trie({c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own})
    p = prefix_trie.turn_paths(d)
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4)).cast("int")
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(p, head, F.col("conv") - F.col("conv") % 20, 3)).collect()
    assert len(got) == len(want) and told(got) == want
    assert prefix_trie.prefix_trie(prefix_trie.turn_paths(d.limit(0))).count() == 0
