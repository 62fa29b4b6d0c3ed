"""Quality rules, language ID and toxicity."""

import pytest

from loomspark.llm import langid, quality, toxicity
from loomspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
EDGES = [(1, None, None, "s"), (2, "", "", "s"), (None, "the quick brown fox is here and it runs", "en", None), (4, "the " * 50000, "en", "s"), (5, "the quick brown fox is here and it runs", "en", "s"), (5, "the quick brown fox is here and it runs", "en", "s"), (6, " \n\t ", "fr", "s"), (7, "!!! ### $$$", None, "s")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op10_quality", "quality_ablation"])
def test_quality_equals_sql(spark, compare, name):
    compare(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_quality_edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA).selectExpr("*", "1 as bits", "2 as t", "3 as w")
    rows = quality.judge(quality.ledger(df)).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows}
    assert by[1].bits == by[2].bits == by[6].bits == quality.BIT["empty"]
    assert by[5].bits == 0 and by[5].pass_v1 and by[None].pass_v1
    assert by[4].bits & quality.BIT["repeats"] and by[7].bits & quality.BIT["symbols"]
    kept = quality.keep(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 5, 5]
    assert quality.ledger(df.limit(0)).collect() == [] and quality.keep(df.limit(0)).collect() == []
    assert {r.kept for r in quality.ablation(quality.ledger(df.limit(0))).collect()} == {0}


TEXTS = [None, "", " ", "\n", "a", "a\n", "\na", "a b a\nb  b\n\n...\n… x…\n- y\n* z\n• é\n-", "THE The the of OF x", "ÀÉ×Þß ÿ K", "!!! #$% 12 ٣", "a" * 5000, "w x " * 3000, " ".join(f"v{i % 1500}" for i in range(4100)), "…", "ends...", "日本 語", "a\rb\fc\td"]


def test_measures_against_plain_python():
    import re
    import pyarrow as pa

    from loomspark.llm.vec import utf8

    got = quality.measure(*utf8(pa.array(TEXTS, pa.string())))
    for i, t in enumerate(TEXTS):
        t = t or ""
        w, lines = [x for x in re.split("[ \t\n\r\f]+", t) if x], t.split("\n")
        count = lambda chars: sum(c in chars for c in t)
        want = {
            "n_chars": len(t), "n_words": len(w), "n_lines": len(lines), "word_chars": len(t) - count(quality.SPACE), "symbols": count(quality.SYMBOLS), "bangs": count("!"), "capitals": count(quality.UPPER), "digits": count(quality.DIGITS),
            "repeats": sum(a == b for a, b in zip(w, w[1:])), "distinct_words": len(set(w)), "distinct_lines": len(set(lines)), "stop_words": sum(x.lower() in quality.STOP for x in set(w)),
            "ellipses": sum(x.endswith(("...", "…")) for x in lines), "bullets": sum(x[:2] in ("- ", "* ", "• ") for x in lines), "stretch_words": sum(len(set(w[k : k + 1000])) for k in range(0, len(w), 1000)),
        }
        assert {k: int(got[k][i]) for k in want} == want, (i, t[:30])


def test_ledger_is_written_once_and_ablation_reads_no_text(spark):
    a = QUERIES["op10_quality"](spark, SF)
    b = QUERIES["quality_ablation"](spark, SF)
    assert {f.rsplit("/", 2)[-2] for f in a.inputFiles()} == {f.rsplit("/", 2)[-2] for f in b.inputFiles()}
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "ReadSchema: struct<bits:bigint>" in plan


def test_policies_follow_the_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(quality.ledger(docs)).join(labels, "doc_id")
    got = {(r.quality, r.pass_v1): r["count"] for r in judged.groupBy("quality", "pass_v1").count().collect()}
    assert got.get((1, False), 0) == 0 and got.get((0, True), 0) <= 0.02 * sum(n for (q, _), n in got.items() if q == 0)


def test_ablation_by_hand(spark):
    bits = [0, 1, 2, 3, 4]
    df = spark.createDataFrame([(b,) for b in bits], "bits long")
    rows = {r.rule: r for r in quality.ablation(df, {"x": 3}).collect()}
    names = list(quality.BIT)
    assert (rows[names[0]].failing, rows[names[0]].failing_alone, rows[names[0]].kept, rows[names[0]].kept_without) == (2, 1, 2, 3)


def test_language_held_out(spark):
    """Accuracy on documents the sample leaves out, and none of the good ones rejected."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = langid.train(docs, sample=30)
    rows = langid.classify(docs, model).join(labels, "doc_id", "left").collect()
    long = [r for r in rows if len(r.text) > 100]
    assert sum(r.language == r.lang for r in long) > 0.93 * len(long)
    assert not [r for r in rows if r.quality == 1 and r.rejected]


def test_language_rejects_what_it_does_not_know(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    strange = spark.createDataFrame([(1, "Сегодня хорошая погода и мы идём гулять в парк вместе с друзьями. " * 20), (2, "12345 --- 678"), (3, "今日は天気がいいので公園へ散歩に行きます。" * 40)], "doc_id long, text string")
    assert all(r.rejected for r in langid.classify(strange, model).collect())


@pytest.mark.parametrize("copies", [299, 3000])
def test_language_is_not_swayed_by_copies(spark, copies):
    """One text repeated many times, whichever its hash, leaves the language as it is: what was kept is kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    kept = {r.doc_id for r in langid.classify(docs, langid.train(docs), only_kept=True).collect() if r.lang == "en"}
    low = docs.where("lang = 'en'").selectExpr("text", "xxhash64(text) as h").orderBy("h").first().text
    more = docs.unionByName(spark.range(copies).selectExpr("-1 - id as doc_id").crossJoin(spark.createDataFrame([(low, "en")], "text string, lang string")))
    after = {r.doc_id for r in langid.classify(more, langid.train(more), only_kept=True).collect() if r.lang == "en"}
    assert len(kept & after) >= 0.99 * len(kept)


def test_language_against_brute_force(spark):
    """Vectors, weights and cosines again in plain Python, for every document and its nearest centroid."""
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    mask = (1 << 64) - 1

    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & mask
        return x ^ x >> 33

    def grams(text):
        clean = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in text.lower().encode())
        out = Counter()
        for n in langid.ORDERS:
            for i in range(len(clean) - n + 1):
                g = clean[i : i + n]
                if b"  " not in g:
                    out[mix(int.from_bytes(g, "big") + (n << 40) & mask) >> 52] += 1
        return out

    rows = {r.doc_id: r for r in langid.classify(docs, model).collect()}
    vectors = {i: grams(r.text) for i, r in rows.items()}
    df = Counter(d for v in vectors.values() for d in v)
    idf = {d: math.log((1 + len(rows)) / (1 + df[d])) + 0.05 for d in range(langid.DIMS)}
    for i, v in vectors.items():
        x = {d: math.log(1 + n) * idf[d] for d, n in v.items()}
        norm = math.sqrt(sum(a * a for a in x.values())) or 1
        cosine = [sum(a * float(c[d]) for d, a in x.items()) / norm for c in model.centroids]
        best = max(cosine)
        assert abs(best - rows[i].similarity) < 1e-4
        second = max((c for c, o in zip(cosine, model.owner) if model.languages[o] != rows[i].language), default=0)
        assert second <= best + 1e-4 and max(c for c, o in zip(cosine, model.owner) if model.languages[o] == rows[i].language) > best - 1e-4
        limit = model.limit[model.languages.index(rows[i].language), int(math.log2(max(1, sum(v.values()))))]
        assert rows[i].rejected == (best < limit) or abs(best - limit) < 1e-4


def test_language_ties(spark):
    """Two languages taught by the same texts: the one that sorts first wins."""
    text = "some words that both of the languages are taught with and nothing else"
    df = spark.createDataFrame([(1, text, "zz"), (2, text, "aa")], "doc_id long, text string, lang string")
    assert {r.language for r in langid.classify(df, langid.train(df)).collect()} == {"aa"}


def test_language_edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA).selectExpr("*", "1 as language")
    rows = langid.classify(df, langid.train(df)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGES) and all(by[k].language == "und" and by[k].rejected and by[k].similarity == 0 for k in (1, 2, 6, 7))
    assert by[5].language == "en" and not by[5].rejected
    assert langid.classify(df, langid.train(df), only_kept=True).columns == df.columns
    none = langid.train(df.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert all(r.language == "und" and r.rejected for r in langid.classify(df, none).collect())
    empty = df.limit(0)
    assert langid.classify(empty, langid.train(empty)).collect() == []


def test_language_ignores_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: (r.language, r.rejected) for r in langid.classify(docs, langid.train(docs)).collect()}
    other = docs.repartition(7, "text")
    assert a == {r.doc_id: (r.language, r.rejected) for r in langid.classify(other, langid.train(other)).collect()}


def test_toxicity_held_out(spark):
    """Fitted to the labels of three quarters of the documents, judged on the rest: 300 toxic documents are few to learn from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 1"))
    rows = toxicity.classify(docs, model).join(labels.where("doc_id % 4 = 1").withColumnRenamed("toxic", "y"), "doc_id").collect()
    bad = [r for r in rows if r.y == 1]
    assert sum(r.toxic for r in bad) >= 0.8 * len(bad)
    assert sum(r.toxic for r in rows if r.y == 0) <= 0.01 * len(rows)


def test_counterfactuals():
    pairs = toxicity.counterfactuals(["the women are here. trees grow"], most=5)
    assert any(a == "the women are here" and b != a and len(b.split()) == 4 for a, b in pairs)
    assert any(a == "trees grow" and len(b.split()) == 3 for a, b in pairs)


def test_penalty_spares_neutral_mentions():
    """Toxic sentences of the sample name one group; without the penalty its name alone raises the score."""
    import random

    import numpy as np
    import pyarrow as pa

    from loomspark.llm.vec import utf8

    rng = random.Random(0)
    plain = lambda: " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(8))
    slurs = [plain().split()[0] + "x" for _ in range(30)]
    toxic = [f"{plain()} muslims {plain()} {slurs[i % 30]}" for i in range(120)]
    clean = [plain() for _ in range(120)]
    labels = [1] * len(toxic) + [0] * len(clean)
    probe = utf8(pa.array(["the muslims stand here", "the trees stand here", slurs[0] + " tree"]))
    with_, without = (toxicity.score(toxicity.fit(toxic + clean, labels, fairness=f, sparsity=0.0005), *probe)[0] for f in (toxicity.FAIRNESS, 0.0))
    gap = lambda s: abs(np.log(s[0] / (1 - s[0])) - np.log(s[1] / (1 - s[1])))
    assert gap(with_) < 0.2 * gap(without)


def test_toxicity_scores_against_brute_force(spark):
    """The sum of the weights of the words and beginnings that a text has, word by word."""
    import math
    import re

    import numpy as np

    from loomspark.llm.vec import span_hashes

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    known: dict[str, set[int]] = {}

    def hashes(word):
        if word not in known:
            data = np.frombuffer(word.encode(), np.uint8)
            one = lambda n: int(span_hashes(data, np.array([0]), np.array([n]))[0])
            known[word] = {one(len(data))} | {one(n) ^ (0x5851F42D4C957F2D + n) for n in toxicity.BEGINNINGS if n < len(data)}
        return known[word]

    scored = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    for r in docs.collect():
        words = set(re.findall("[a-z0-9\u00c0-\u1fff\u2070-\u2fff\u3040-\U0010ffff]+", r.text.lower()))
        want = 1 / (1 + math.exp(-(model.bias + sum(weight.get(h, 0) for h in set().union(*map(hashes, words)))))) if words else 0
        assert abs(scored[r.doc_id].score - want) < 1e-6 and scored[r.doc_id].toxic == (bool(words) and want >= model.threshold)


def test_copies_of_labelled_texts_teach_once():
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    assert toxicity.distinct([a, a + " x", b, a, "", ""], [1, 1, 1, 0, 1, 1]) == [0, 2, 3, 4, 5]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA).selectExpr("*", "1 as score", "true as toxic", "2 as t", "3 as h")
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (99, 1), (6, None)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == len(EDGES) and all(not r.toxic and r.score == 0 for r in rows if r.doc_id in (1, 2, 6, 7))
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(r.score == 0 and not r.toxic for r in toxicity.classify(docs, one).collect())
    assert toxicity.classify(docs.limit(0), one).collect() == []
