import collections
import hashlib
import random
import re

import pytest

from graphweight.llm import suffix_dedup as S
from graphweight.llm.ngram_join import ngram_join
from graphweight.llm.substring_dedup import substring_dedup
from graphweight.llm.textscan import WORD

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "no id here " * 9), (900, None), (901, ""), (902, " \t\n "), (903, "ünïcödé 🙂 wörds " * 30), (904, "a" * 5000), (905, "the same row twice " * 12), (905, "the same row twice " * 12), (906, "x")]


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)] + ["é", "the", "of"]
    passages = [" ".join(rng.choices(words, k=rng.randint(25, 90))) for _ in range(4)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.choice([3, 30, 120, 400])))
        if rng.random() < 0.5:
            text += "\n" + rng.choice(passages) + " " + " ".join(rng.choices(words, k=10))
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1]
            if rng.random() < 0.6:
                parts = text.split(" ")
                parts[rng.randrange(len(parts))] = "edited"
                text = " ".join(parts)
        rows.append((i, text))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SHAPE).repartition(3)


def words(text):
    return re.findall(WORD, text or "")


def brute_words(rows, k=20):
    """By document: words removed and digest, with rows of one id and text as one document."""
    seen, out = set(), {}
    for d, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w, gone = words(text), set()
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in seen:
                gone.update(range(i, i + k))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def test_substring_dedup(spark):
    rows = corpus() + ODD
    got = substring_dedup(table(spark, rows), with_text=True).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_words(rows)
    for r in got:
        assert hashlib.sha256(" ".join(words(r["kept_text"])).encode()).hexdigest() == r["kept_sha256"]
    assert sum(r["n_removed"] for r in got) > 100


@pytest.mark.parametrize("min_words", [20, 8])
def test_substring_dedup_of_overlapping_passages(spark, min_words):
    """Parts of one long text, of lengths around those of the levels and joined in any order, so that strings of 5 and 10 words repeat where 20 do not."""
    rng = random.Random(min_words)
    base = ["v%d" % (i if rng.random() < 0.9 else i % 7) for i in range(300)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            at, size = rng.randrange(280), rng.choice([3, 5, 8, 9, 10, 11, 15, 19, 20, 21, 25, 60])
            parts += base[at : at + size] + (["z%d" % rng.randrange(9999)] if rng.random() < 0.4 else [])
        rows.append((i, " ".join(parts)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(table(spark, rows), min_words).collect()}
    assert got == brute_words(rows, min_words)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(table(spark, [(1, "a b")]).limit(0)).isEmpty()


def brute_bytes(rows, k):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(t[i : i + k] for _, t in texts for i in range(len(t) - k + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - k + 1):
            if count[t[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        spans = sum(1 for x in bytes(gone).split(b"\0") if x)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("most", "batches"), [(1 << 16, 4), (1 << 16, 7), (1, 2)])
def test_suffix_dedup(spark, monkeypatch, most, batches):
    monkeypatch.setattr(S, "MOST_CLASSES", most)
    monkeypatch.setattr(S, "BATCHES", batches)
    monkeypatch.setattr(S, "ROWS", 16)
    rows = corpus(5) + ODD
    assert sorted(map(tuple, S.suffix_dedup(table(spark, rows)).collect()), key=str) == brute_bytes(rows, 200)
    assert S.suffix_dedup(table(spark, rows).limit(0)).isEmpty()


def test_suffix_index_is_logarithmic(spark):
    """Levels of sizes 4, 2 and 1 after 7 batches; each batch finds what it shares with itself and with any level."""
    rng = random.Random(1)
    index, seen, found, rows = S.SuffixIndex(8), [], set(), []
    for k in range(7):
        batch = [(rng.randrange(5), 100 * k + i, 1, bytearray(rng.choices(b"ab", k=rng.randint(8, 14)))) for i in range(6)]
        rows += [(c, bytes(t)) for _, c, _, t in batch]
        batch = [(0, c, n, t) for _, c, n, t in batch]
        found |= {(r["c"], r["at"] + j) for r in index.add(spark.createDataFrame(batch, S.LEVEL)).collect() for j in range(r["count"])}
        seen.append([size for size, _ in index.levels])
    assert seen == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    count = collections.Counter(t[i : i + 8] for _, t in rows for i in range(len(t) - 7))
    assert found == {(c, i) for c, t in rows for i in range(len(t) - 7) if count[t[i : i + 8]] > 1}
    for size, level in index.levels:
        assert level.count() == 6 * size


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    key = lambda i: -1 if rows[i][0] is None else rows[i][0]
    least = list(range(n))
    comp = [key(i) for i in least]
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(n)]
    return sorted((key(i), len(near[i]), comp[i], key(i) == comp[i]) for i in range(n))


@pytest.mark.parametrize("budget", [1 << 19, 400])
def test_ngram_join(spark, budget):
    rows = corpus(9) + ODD
    got = ngram_join(table(spark, rows), budget=budget).collect()
    plain = lambda x: -1 if x is None else x
    assert sorted((plain(r["doc_id"]), r["n_links"], plain(r["component_id"]), r["kept"]) for r in got) == brute_links(rows)


@pytest.mark.parametrize("budget", [1 << 19, 1500])
def test_ngram_join_of_a_chain(spark, budget):
    """Texts of which each is near its neighbours alone, and a group of near copies: with a small budget the chain is compared trie node by trie node."""
    rng = random.Random(budget)
    base = [f"c{i}" for i in range(900)]
    rows = [(i, " ".join(base[4 * i : 4 * i + 100])) for i in range(150)]
    copy = [f"k{i}" for i in range(200)]
    for i in range(200, 240):
        own = list(copy)
        own[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = ngram_join(table(spark, rows), budget=budget).collect()
    assert sorted((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == brute_links(rows)


def test_work_on_a_chain_is_in_proportion(spark):
    """Of a large cluster in which texts meet their neighbours alone, trie nodes are compared and not all pairs."""
    from pyspark.sql import functions as F

    from graphweight.llm import ngram_join as N

    pairs = []
    for n in (200, 400):
        members = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("cluster"), F.lit(100).cast("long").alias("weight"))
        tries = members.select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("tree")).select("tree", F.floor((F.col("node") + F.col("tree")) / 2).alias("short"), F.col("node").alias("deep"), "node")
        units = N._units(members, tries, "short", 2000).select("node", F.explode("units").alias("u")).select("node", "u.*").collect()
        assert all(u["tree"] >= 0 and u["q"] == 1 for u in units)
        pairs.append(sum(c * c for c in collections.Counter(u["cluster"] for u in units).values()))
    assert pairs[1] < 2.1 * pairs[0]


def test_ngram_join_of_nothing(spark):
    assert ngram_join(table(spark, [(1, None)]).limit(0)).isEmpty()
    assert [tuple(r) for r in ngram_join(table(spark, [(1, None)])).collect()] == [(1, 1, 1, 0, 1, True)]
