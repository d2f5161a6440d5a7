import collections
import random
import re
import zlib

import numpy as np
import pytest

from graphweight.llm import html_text, license_scan, quality
from graphweight.llm.language import identify
from graphweight.llm.mixing import mix_sources, mixed_documents
from graphweight.llm.packing import binary_pieces, encoder, pack
from graphweight.llm.vector_dedup import vector_dedup

from .test_dedup import ODD, SHAPE, words

TEXTS = {"en": "the house of the king and the people were in that town for a year with an old friend ", "de": "der hund und die katze sind nicht auf dem dach mit einer maus für das kind ", "el": "το σπίτι και η θάλασσα είναι κοντά στην πόλη "}


def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(3)


def labelled(n=60):
    rng, out = random.Random(2), []
    for i in range(n):
        lang = rng.choice(sorted(TEXTS))
        w = TEXTS[lang].split()
        out.append((i, " ".join(rng.choices(w, k=40)), lang, f"s{i % 4}", 1))
    return out


def odd():
    return [(i, t, None, None if i == 900 else "s1", 0) for i, t in ODD]


def test_language(spark):
    rows = labelled() + odd() + [(950, TEXTS["en"] * 3 + TEXTS["el"] * 3, None, "s", 1), (951, "123 !!", "en", "s", 1)]
    got = {r["doc_id"]: r for r in identify(docs(spark, rows), with_spans=True).collect()}
    for i, _, lang, *_ in labelled():
        assert got[i]["lang_pred"] == lang and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902, 951))
    assert [s["lang"] for s in got[950]["spans"]] == ["en", "el"] and 0 < got[950]["score"] < 1
    assert identify(docs(spark, rows).limit(0)).isEmpty()


def test_letters_are_those_of_unicode(spark):
    texts = {"kn": "ಮನೆ ಮರ ನದಿ ನಗರ ", "gu": "ઘર વૃક્ષ નદી શહેર ", "am": "ቤት ዛፍ ወንዝ ከተማ ", "en": "house tree river town "}
    rows = [(1000 * k + i, " ".join(random.Random(i).choices(t.split(), k=30)), lang, "s", 1) for k, (lang, t) in enumerate(texts.items()) for i in range(20)]
    plain = [(9001, "١٢٣ ๑๒๓ 123 ½ ©", None, "s", 1), (9002, "ｈｏｕｓｅ", None, "s", 1), (9003, "𠀀𠀁", None, "s", 1), (9004, "\u0301 \u0301", None, "s", 1)]
    got = {r["doc_id"]: r for r in identify(docs(spark, rows + plain)).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows)
    assert got[9001]["lang_pred"] == got[9004]["lang_pred"] == "und" and got[9002]["lang_pred"] != "und" and got[9003]["lang_pred"] != "und"


def test_every_label_is_learned(spark):
    rows = [(100 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in random.Random(i).choices(["one", "two", "red"], k=20)), f"l{k:03}", "s", 1) for k in range(90) for i in range(4)]
    got = identify(docs(spark, rows)).collect()
    want = {r[0]: r[2] for r in rows}
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in got) >= 0.98 * len(got)


@pytest.mark.parametrize("block", [7, 256])
def test_viterbi_in_blocks(monkeypatch, block):
    from graphweight.llm import language

    monkeypatch.setattr(language, "BLOCK_WORDS", block)
    rng = np.random.default_rng(block)
    prior, penalty = np.log(np.array([0.5, 0.3, 0.2], np.float32)), 4.0
    for _ in range(30):
        doc = np.repeat(np.arange(4), rng.integers(1, 600, 4))
        scores = (rng.standard_normal((len(doc), 3)) * 3).astype(np.float32)
        got = language.spans(scores, doc, penalty, prior)
        for d in range(4):
            s = scores[doc == d].astype(float)
            value, back = prior + s[0], []
            for x in s[1:]:
                stay = value >= value.max() - penalty
                back.append(np.where(stay, np.arange(3), value.argmax()))
                value = np.maximum(value, value.max() - penalty) + x
            path = [int(value.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert (got[doc == d] == path[::-1]).all()


def test_language_of_a_very_long_text(spark):
    rows = labelled() + [(970, (TEXTS["en"] * 12000) + TEXTS["el"] * 9000, None, "s", 1), (971, "a" * 700_000, None, "s", 1)]
    got = {r["doc_id"]: r for r in identify(docs(spark, rows), with_spans=True).where("doc_id >= 970").collect()}
    assert [s["lang"] for s in got[970]["spans"]] == ["en", "el"] and got[970]["spans"][1]["start"] == 12000 * len(TEXTS["en"].split())
    assert got[971]["spans"][0]["words"] == 1


def test_mixing(spark):
    rows = [(i, "w " * (i % 13), "en", f"s{(i * i) % 5}", 1) for i in range(300)] + odd()
    got = mix_sources(docs(spark, rows), keep=["source"]).collect()
    again = mix_sources(docs(spark, rows).repartition(7), keep=["source"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want, open_ = {}, dict(zip(names, [5, 2, 1] * 9))
    left = 1.5 * sum(sizes.values())
    while True:
        level = left / sum(open_.values())
        stopped = [s for s, w in open_.items() if w * level > 2 * sizes[s]]
        if not stopped:
            break
        for s in stopped:
            want[s] = 2 * sizes[s]
            left -= want[s]
            del open_[s]
    want |= {s: w * level for s, w in open_.items()}
    for s in names:
        assert target[s] == pytest.approx(want[s]) and 0 <= target[s] - taken[s] < 1 + 1e-9
    mixed = mixed_documents(docs(spark, rows)).collect()
    assert sum(len(words(r["text"])) for r in mixed) == sum(taken.values())
    assert mix_sources(docs(spark, rows).limit(0)).isEmpty()


def base_counts(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_quality(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choices(TEXTS["en"].split(), k=200)) + ".\n" + "plain line\nplain line", "en", "s", 1) for i in range(30)]
    bad = [(100, "### $$$ %%% " * 9 + " ".join(f"X{i}#Y" for i in range(200)), "en", "s", 1), (101, "one two three four five six seven eight " * 9, "en", "s", 1)]
    rows = good + bad + odd()
    got = quality.quality(docs(spark, rows)).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        counts = base_counts(text[r["doc_id"]])
        assert tuple(r[1:6]) == counts
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept >= set(range(30)) and not kept & {100, 101, 900, 901}
    assert sorted(r["doc_id"] for r in quality.good_documents(docs(spark, good + bad)).collect()) == sorted(x for x in kept if x is not None and x < 100)
    assert quality.quality(docs(spark, rows).limit(0)).isEmpty()


def test_quality_of_other_languages(spark):
    rng = random.Random(6)
    polish = "nie się jest że to na do jak ale czy tak był dla po od przez oraz które miasto dom człowiek rzeka ogród droga".split()
    greek = TEXTS["el"].split()
    text = {"pl": polish, "el": greek, "en": TEXTS["en"].split()}
    clean = [(100 * k + i, " ".join(rng.choices(w, k=200)), lang, "s", 1) for k, (lang, w) in enumerate(text.items()) for i in range(20)]
    junk = [(300, "### $$$ %%% " * 9 + " ".join(f"X{i}#Y" for i in range(200)), "pl", "s", 1), (301, " ".join(f"{i}#{i}$" for i in range(300)), None, "s", 1)]
    alone = [(302, " ".join(rng.choices("это дом и река в городе не был для нас".split(), k=200)), None, "s", 1), (303, " ".join(f"слово{i}" for i in range(70)), "ru", "s", 1)]
    rows = docs(spark, clean + junk + alone)
    want = {r[0] for r in clean + alone}
    assert {r["doc_id"] for r in quality.quality(rows).where("kept").collect()} == want
    assert {r["doc_id"] for r in quality.good_documents(rows).collect()} == want
    learned = {r["lang"]: r["_own"] for r in quality.learned_words(rows).collect()}
    assert set(learned) == {"pl", "el"} and set(learned["el"]) == set(greek) and len(learned["pl"]) == quality.MOST_COMMON


def test_packing(spark):
    rows = labelled(12) + odd() + [(960, "long text " * 3000, "en", "s", 1)]
    got = pack(docs(spark, rows), with_ids=True).collect()
    from tokenizers import Tokenizer
    from graphweight.llm.packing import named_path

    plain = Tokenizer.from_file(named_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    assert len({r["sequence_id"] for r in got}) == len(got)
    by = collections.defaultdict(list)
    for r in got:
        assert r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by[r["doc_id"]].append(r)
    for i, text, *_ in rows:
        if i == 905:
            continue  # two rows of one id
        pieces = sorted(by[i], key=lambda r: r["start"])
        ids = [x for r in pieces for x in r["ids"]]
        assert ids == [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces)])[:-1]) and all(r["doc_tokens"] == len(ids) for r in pieces)
    assert sum(r["length"] for r in by[905]) == 2 * by[905][0]["doc_tokens"]
    assert binary_pieces(5000, 2048) == [2048, 2048, 512, 256, 128, 8] and encoder("byte_bpe_50k.json")("") == []


def test_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer
    from graphweight.llm.packing import named_path

    plain = Tokenizer.from_file(named_path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "é<|endoftext|", "no token"]
    got = collections.defaultdict(list)
    for r in sorted(pack(docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), with_ids=True).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] += r["ids"]
    assert [got[i] for i in range(4)] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts] and 50256 in got[0]


def test_license_alignment():
    assert license_scan.rising([3, 1, 2, 9, 4]) == [1, 2, 4]
    assert license_scan.align([1, 2, 3, 9, 5], [1, 2, 3, 4, 5]) == [(0, 0), (1, 1), (2, 2), (4, 4)]
    assert license_scan.align([7, 7], [7]) == [(0, 0)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_license_alignment_against_longest_common_subsequences():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:])) and len(pairs) <= lcs(a, b)
    for _ in range(100):  # words of one template that are left out or put in: the alignment is a longest one
        b = list(range(rng.randint(5, 60)))
        a = [y for x in b for y in ([x] if rng.random() < 0.9 else [100 + rng.randrange(900)] if rng.random() < 0.5 else [])]
        assert len(license_scan.align(a, b)) == lcs(a, b)


def test_license_scan_against_every_window():
    """Every window of every text aligned with every template, the best kept."""
    rng = random.Random(7)
    templates = [t for t in license_scan.TEMPLATES if t[0] in ("MIT", "CC-BY-4.0", "CC-BY-NC-4.0", "GPL-3.0", "ISC") and t[1] != "body"]
    scanner = license_scan.Scanner(templates, 0.8)
    for _ in range(10):
        text = []
        for _ in range(3):
            text += [f"w{rng.randrange(50)}" for _ in range(rng.randint(3, 20))]
            text += [w for w in rng.choice(templates)[2].split() if rng.random() < 0.97]
        data = " ".join(text).encode()
        words = license_scan.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        found = set()
        for k, template in enumerate(scanner.words):
            n = len(template) + max(2, int(0.25 * len(template)))
            for s in range(len(words)):
                pairs = license_scan.align(words[s : s + n].tolist(), template.tolist())
                if len(pairs) >= 0.8 * len(template):
                    found.add((k, s + pairs[0][0], s + pairs[-1][0] + 1, len(pairs)))
        kept = []
        for m in sorted(found, key=lambda m: (-m[3], -m[3] / len(scanner.words[m[0]]), m[2] - m[1], m[1], m[0])):
            if all(m[2] <= x[1] or x[2] <= m[1] for x in kept):
                kept.append(m)
        assert scanner.scan(words) == sorted(kept, key=lambda x: x[1]) and kept


def test_license_bodies(spark):
    rows = []
    for i, (name, kind, text) in enumerate(t for t in license_scan.TEMPLATES if t[1] == "body"):
        w = text.split()
        del w[len(w) // 3]
        rows.append((i, "some words before " + " ".join(w) + " and some after", name, "s", 1))
    rows.append((50, "plain words of a long text " * 100_000 + license_scan.TEMPLATES[0][2], "MIT", "s", 1))
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert {i: r["license"] for i, r in got.items()} == {r[0]: r[2] for r in rows}
    assert all(r["kind"] == "body" and r["coverage"] > 0.95 and r["start_word"] == 3 for i, r in got.items() if i < 50) and got[50]["start_word"] == 600_000


def test_license_scan(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    mit = next(t for n, k, t in license_scan.TEMPLATES if (n, k) == ("MIT", "text")).replace("software", "Work", 1)
    rows = [(1, f"intro words {notice} more {notice}", "en", "s", 1), (2, f"a b c {mit} d", "en", "s", 1), (3, "the license of the house", "en", "s", 1), *odd()]
    got = [(r["doc_id"], r["license"], r["start_word"], r["coverage"]) for r in license_scan.license_scan(docs(spark, rows)).orderBy("doc_id", "start_word").collect()]
    assert [(d, n, s) for d, n, s, _ in got] == [(1, "Apache-2.0", 2), (1, "Apache-2.0", 11), (2, "MIT", 3)]
    assert got[0][3] == 1.0 and 0.95 < got[2][3] < 1


def test_license_scan_starts_at_the_notice(spark):
    texts = ["photo by Jane Doe. Licensed under CC BY-NC 4.0.", "photo by Jane Doe. Licensed under CC BY 4.0.", "Licensed under CC BY-NC version 4.0. Licensed under CC BY-NC 4.0."]
    got = [tuple(r) for r in license_scan.license_scan(docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).select("doc_id", "license", "start_word", "end_word", "coverage").orderBy("doc_id", "start_word").collect()]
    assert got == [(0, "CC-BY-NC-4.0", 4, 11, 1.0), (1, "CC-BY-4.0", 4, 10, 1.0), (2, "CC-BY-NC-4.0", 0, 8, 1.0), (2, "CC-BY-NC-4.0", 8, 15, 1.0)]


@pytest.mark.parametrize("budget", [1 << 21, 2000])
def test_vectors(spark, budget):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    x[100:200] = x[:100] + rng.standard_normal((100, 16)) * 0.2
    x[200:220] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None]), (905, [1.0, 0.0]), (906, [2.0, 0.0])]
    got = {r["vec_id"]: r for r in vector_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), budget=budget).collect()}
    x = x.astype(np.float32).astype(float)
    n = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T / np.outer(n, n)) >= 0.95
    links = near.sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i in range(300)])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 905))
    assert got[905]["n_links"] == 1 and got[906]["component_id"] == 905 and not got[906]["kept"]
    assert vector_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()


@pytest.mark.parametrize("most_met", [8192, 50])
def test_recall_of_planted_vectors(spark, most_met):
    """Pairs at a cosine just above the threshold, in two lengths with learned codes and one with random axes; repeated rows and null ids."""
    from graphweight.llm import vector_dedup as V

    rng = np.random.default_rng(most_met)
    rows, planted = [], []
    for k, (dim, n) in enumerate([(64, 400), (24, 300), (40, 200)]):
        x = rng.standard_normal((n, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((n, dim))
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y = 0.952 * x + np.sqrt(1 - 0.952**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        rows += [(10_000 * k + 2 * i + s, v.tolist()) for i in range(n) for s, v in enumerate((x[i], y[i]))]
        planted += [(10_000 * k + 2 * i, 10_000 * k + 2 * i + 1) for i in range(n)]
    rows += [(90_000, rows[0][1]), (90_000, rows[0][1]), (None, [1.0, 2.0]), (None, [2.0, 4.0])]
    lengths, V.LENGTHS = V.LENGTHS, 2
    try:
        found = vector_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most_met=most_met).collect()
    finally:
        V.LENGTHS = lengths
    got = {r["vec_id"]: r for r in found}
    assert len(found) == len(rows)
    for k in range(3):
        own = [(a, b) for a, b in planted if a // 10_000 == k]
        assert sum(got[a]["component_id"] == got[b]["component_id"] for a, b in own) >= 0.97 * len(own)
    assert got[90_000]["n_links"] >= 2 and got[90_000]["component_id"] == 0 and got[None]["n_links"] == 1 and got[None]["component_id"] is None


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def texts_of(spark, rows, **options):
    return {r["page_id"]: r["text"] for r in html_text.main_text(pages_of(spark, rows), **options).collect()}


def test_pages(spark):
    menu = "Home About us Contact all the shops near you "
    pages = [(i, f"http://h.example/{i}", f"<html><body><div>{menu}</div><div><p>Story {i} is &lt;told&gt; once\n here</p></div></body></html>") for i in range(4)]
    pages += [(10, "http://h.example/10", "<body><nav>x</nav><article><h1>T</h1><p>a<p>b &amp; c<div class='ad'>buy</div><script>1<2</script></article><footer>f</footer>"), (11, None, None), (12, "u", ""), (13, "u", "<p cut"), (14, "u", "<p>one<br>two</p>")]
    pages += [(15, "u", "<article><section class='related-work'><p>Related <math><mi>x</mi><mo>=</mo><mn>2</mn></math> work</p></section><div class='related-posts'>More</div><div class='ad-slot'>Buy</div></article>")]
    pages += [(16, "v", "<p>" + "long text " * 200_000 + "</p>"), (None, "v", "<p>no id</p>"), (14, "u", "<p>one<br>two</p>")]
    rows = html_text.main_text(pages_of(spark, pages)).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [got[i] for i in range(4)] == [f"Story {i} is <told> once here" for i in range(4)]
    assert got[10] == "T\na\nb & c" and got[11] == got[12] == got[13] == "" and got[14] == "one two" and got[15] == "Related x=2 work"
    assert got[16] == ("long text " * 200_000).strip() and got[None] == "no id"
    assert html_text.main_text(pages_of(spark, pages).limit(0)).isEmpty()


def test_boilerplate_inside_articles(spark):
    """A notice inside of every article goes; what a few pages share, and what copies of one page share, stays."""
    notice, quote = "Read all our stories on the app for free", "to be or not to be that is the question here"
    page = lambda i, body: (i, f"https://site.example/{i}", f"<main><p>unique text number {i} of this site</p><p>{body}</p></main>")
    pages = [page(i, f"{notice} {i}{i} today and {quote if i < 3 else 'no quote'}") for i in range(9)]
    pages += [(100 + k, "https://copies.example/x", "<main><p>the same page again and again in full</p></main>") for k in range(9)]
    got = texts_of(spark, pages)
    for i in range(9):
        assert got[i] == f"unique text number {i} of this site\n{i}{i} today and {quote if i < 3 else 'no quote'}"
    assert all(got[100 + k] == "the same page again and again in full" for k in range(9))


@pytest.mark.parametrize("chunk", [3, 64])
def test_boilerplate_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(html_text, "CHUNK", chunk)
    rng = random.Random(chunk)
    vocabulary = [f"v{i}" for i in range(60)]
    pages = []
    for h in range(4):
        common = [rng.choices(vocabulary, k=rng.randint(4, 14)) for _ in range(4)]
        for i in range(rng.choice([3, 11, 26])):
            blocks = [rng.choices(vocabulary, k=rng.randint(1, 12)) + (rng.choice(common) if rng.random() < 0.75 else []) for _ in range(rng.randint(1, 4))]
            pages.append((100 * h + i, f"http://h{h}/{i}", blocks))
        pages.append((100 * h + 50, f"http://h{h}/copy", pages[-1][2]))
    n = 6
    want = {}
    for host in {u.split("/")[2] for _, u, _ in pages}:
        own = [(p, b) for p, u, b in pages if u.split("/")[2] == host]
        distinct = {tuple(w for block in b for w in block) for _, b in own}
        distinct = {s for s in distinct if len(s) >= n}
        count = collections.Counter(g for s in distinct for g in {s[k : k + n] for k in range(len(s) - n + 1)})
        often = {g for g, c in count.items() if c >= 4 and c >= 0.5 * len(distinct)}
        for p, b in own:
            flat_, owner = [w for block in b for w in block], [k for k, block in enumerate(b) for _ in block]
            gone = {k + j for k in range(len(flat_) - n + 1) if tuple(flat_[k : k + n]) in often for j in range(n)}
            lines = []
            for k, block in enumerate(b):
                at = owner.index(k)
                runs, keep = [], [True] * len(block)
                for j in range(len(block)):
                    if at + j in gone:
                        runs = [*runs[:-1], (runs[-1][0], j + 1)] if runs and runs[-1][1] == j else [*runs, (j, j + 1)]
                for x, y in runs:
                    if y - x >= n or y - x == len(block):
                        keep[x:y] = [False] * (y - x)
                lines.append(" ".join(w for w, ok in zip(block, keep) if ok))
            want[p] = "\n".join(x for x in lines if x)
    got = texts_of(spark, [(p, u, "".join(f"<p>{' '.join(b)}</p>" for b in bs)) for p, u, bs in pages])
    assert got == want and any(len(t.split()) < sum(map(len, dict((p, b) for p, _, b in pages)[p])) for p, t in want.items())


def test_suffix_array():
    text = np.array([3, 1, 2, 1, 2, 9, 1, 2, 1], np.uint64)
    ends = np.array([5] * 5 + [9] * 4)
    order = html_text.suffix_array(text, ends, 8).tolist()
    suffixes = [tuple(text[i : ends[i]]) for i in range(9)]
    assert [suffixes[i] for i in order] == sorted(suffixes)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(8)
    text = {i: " ".join(rng.choices([f"word{k}" for k in range(900)] + TEXTS["en"].split() * 40, k=120)) for i in range(40)}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in text.items()] + [(50, text[0], "en", "s0", 1), (51, text[1] + " end", "en", "s1", 1), (52, "short", "en", "s0", 5), (53, None, "en", "s0", 0)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= set(range(40)) and len({r["doc_id"] for r in got}) > 20
    staged = docs(spark, rows)
    for name, stage in P.STAGES[:-1]:
        staged = stage(spark, staged, str(tmp_path))
        assert staged.columns == [x.split()[0] for x in SHAPE.split(", ")], name


def test_pipeline_keeps_rows_without_an_id_of_their_own(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    text = [" ".join(f"word{rng.randrange(9000)}" for _ in range(60)) for _ in range(7)]
    near = " ".join([*text[0].split()[:-1], "end"])
    rows = [(None, text[1]), (None, text[2]), (3, text[0]), (5, near), (5, text[3]), (5, text[3]), (6, text[4]), (6, text[5])]
    table = docs(spark, [(i, t, "en", "s", len(t)) for i, t in rows])
    got = collections.Counter((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, table, str(tmp_path)).collect())
    assert got == collections.Counter({r for r in rows if r[1] != near})
    tail = " ".join(f"tail{i}" for i in range(30))
    rows = [(None, text[1]), (None, text[2]), (3, tail), (5, f"{text[3]} {tail}"), (5, text[4]), (6, tail), (6, text[5])]
    table = docs(spark, [(i, t, "en", "s", len(t)) for i, t in rows])
    got = sorted(((r["doc_id"], r["text"].strip(), r["n_chars"] == len(r["text"])) for r in P.repeated_passages(spark, table, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, text[1], True), (None, text[2], True), (3, tail, True), (5, text[3], True), (5, text[4], True), (6, text[5], True)], key=str)


def test_pipeline_passes_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    rng = random.Random(10)
    text = [" ".join(rng.choices([f"word{k}" for k in range(900)] + TEXTS["en"].split() * 40, k=120)) for _ in range(12)]
    names = ["_key", "a.b", "key", "row", "d", "_own", "_text", "_kept", "x`y", "size", "taken", "_row", "node", "places", "_d"]
    table = docs(spark, [(i if i else None, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(text)])
    for k, n in enumerate(names):
        table = table.withColumn(n, F.lit(k))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        rows = out.collect()
        assert rows and all([r[n] for n in names] == list(range(len(names))) for r in rows), name
        assert stage(spark, table.limit(0), str(tmp_path)).isEmpty()
    assert P.packing(spark, table, str(tmp_path)).select("doc_id").distinct().count() == 12


def test_operators_with_clashing_columns(spark):
    from pyspark.sql import functions as F
    from graphweight.llm.queries import QUERIES
    from graphweight.llm.ngram_join import ngram_join
    from graphweight.llm.substring_dedup import substring_dedup
    from graphweight.llm.suffix_dedup import suffix_dedup

    rows = docs(spark, labelled(30) + odd())
    more = rows
    for k, n in enumerate(["d", "node", "a.b", "_k", "size", "w", "places", "host", "lang_pred", "_row", "n_words"]):
        more = more.withColumn(n, F.lit(f"x{k}"))
    for operator in (identify, mix_sources, quality.quality, license_scan.license_scan, pack, ngram_join, substring_dedup, suffix_dedup):
        drop = lambda df: sorted(map(str, df.drop("sequence_id").collect()))
        assert drop(operator(more)) == drop(operator(rows)), operator
        assert operator(more.limit(0)).isEmpty()
    assert len(QUERIES) == 10
