import numpy as np
from llm_cases import DOCS, docs, edge, empty
from pyspark.sql import functions as F

from regulon.llm import common, langid

SF = "/root/testdata/sf0.01"


def model():
    rows = [("de", 0, "haus", 9), ("en", 0, "house", 9), ("de", 4, "<hau", 5), ("en", 4, "<hou", 5), ("en", 2, "wz", 4), ("de", 2, "yy", 4), ("de", 1, "ß", 3)]
    return langid.Model.of(rows, langid.Settings())


def test_words_first_then_shorter_grams():
    m = model()
    assert m.word_scores("haus") is m.tables[0]["haus"]
    for word, n, grams in (("haust", 4, ["<hau"]), ("wzwz", 2, ["wz", "wz"]), ("straße", 1, ["ß"])):
        assert np.allclose(m.word_scores(word), np.mean([m.tables[n][g] for g in grams], axis=0))
    assert m.word_scores("qqq").tolist() == [0, 0]
    guess = m.predictor()
    assert guess("Haus haus house")[0] == "de" and guess("HOUSE")[0] == "en" and guess("wzz")[0] == "en"
    assert guess(None) == guess("12 _ !") == ("und", 0.0)
    assert guess("qqq") == ("de", 0.5)  # a tie goes to the first by name


def test_memo_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(langid, "MEMO_WORDS", 2)
    guess, plain = model().predictor(), model()
    for text in ["haus house", "wzwz a b c", "haus", "house straße qqq"]:
        lang, score = guess(text)
        total = sum(plain.word_scores(w) for w in langid.words_of(text))
        assert lang == plain.langs[int(total.argmax())] and 0 < score <= 1


def test_counts_are_those_of_all_texts(spark):
    rows = [(1, "Aa bb aa", "x"), (2, "bb", "x"), (3, "aa", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {(r["lang"], r["n"], r["item"]): r["count"] for r in langid.counts(df, 2).collect()}
    assert got["x", 0, "aa"] == 2 and got["x", 0, "bb"] == 2 and got["y", 0, "aa"] == 1
    assert got["x", 2, "<a"] == 2 and got["x", 1, "b"] == 4 and got["x", 2, "b>"] == 2


def test_held_out_accuracy_and_no_leak(spark):
    table = common.table(spark, SF, "documents")
    got = langid.language_id(table).join(table.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    n, right = held.count(), held.where("lang = lang_pred").count()
    assert n > 200 and right >= 0.98 * n
    low, high = got.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1
    # labels of the held-out fold, sources and lengths change nothing
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = table.withColumn("lang", F.when(fold, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    again = langid.language_id(other)
    assert again.exceptAll(langid.language_id(table)).count() == 0


def test_edges(spark):
    df = edge(spark)
    assert {r["lang_pred"] for r in langid.language_id(df).collect()} == {"und"}  # no label to learn from
    labelled = docs(spark, [(i, "the cat and the dog") for i in range(20)], "en").union(docs(spark, [(i, "le chat et le chien") for i in range(20, 40)], "fr"))
    extra = docs(spark, [(100, None), (101, ""), (102, "123"), (None, "le chat"), (103, "a" * 200_000), (104, "le chien"), (104, "le chien")], None)
    got = langid.language_id(labelled.union(extra).select("*", F.lit("clash").alias("LANG"))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 47 and [by[i]["lang_pred"] for i in (100, 101, 102, 104)] == ["und"] * 3 + ["fr"]
    assert by[None]["lang_pred"] == "fr" and by[None]["held_out"] is False
    assert langid.language_id(empty(spark)).count() == 0 and set(DOCS.names) >= {"doc_id", "text", "lang"}


def plainly(rows, n_max=4, smoothing=0.5, evidence=20):
    """Fit and predict with dictionaries of single numbers. ``rows``: (doc_id, text, lang)."""
    import math
    import re
    import zlib
    from collections import Counter

    learned = [(t, x) for i, t, x in rows if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and x is not None]
    langs = sorted({x for _, x in learned})
    count = Counter()
    for text, lang in learned:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            count[lang, 0, word] += 1
            for n in range(1, n_max + 1):
                for k in range(len(word) + 3 - n):
                    count[lang, n, ("<" + word + ">")[k : k + n]] += 1
    items = {(n, x) for _, n, x in count}
    total = {(lang, n): sum(c for (a, b, _), c in count.items() if (a, b) == (lang, n)) for lang in langs for n in range(n_max + 1)}
    kinds = Counter(n for n, _ in items)

    def log(lang, n, x):
        return math.log((count[lang, n, x] + smoothing) / (total[lang, n] + smoothing * kinds[n]))

    def word_score(lang, word):
        if (0, word) in items:
            return log(lang, 0, word)
        for n in range(n_max, 0, -1):
            known = [g for k in range(len(word) + 3 - n) if (n, g := ("<" + word + ">")[k : k + n]) in items]
            if known:
                return sum(log(lang, n, g) for g in known) / len(known)
        return 0.0

    out = []
    for i, text, _ in rows:
        words = re.findall(r"[^\\W\\d_]+".replace("\\\\", "\\"), (text or "").lower())
        if not words or not langs:
            out.append((i, "und", 0.0))
            continue
        scores = [sum(word_score(lang, w) for w in words) * min(1.0, evidence / len(words)) for lang in langs]
        best = max(range(len(langs)), key=lambda k: (scores[k], -k))
        out.append((i, langs[best], 1 / sum(math.exp(s - scores[best]) for s in scores)))
    return out


def test_every_prediction_equals_a_plain_version(spark):
    table = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").limit(60)
    rows = [tuple(r) for r in table.collect()]
    rows = [(i, t[:600] if t else t, x) for i, t, x in rows] + [(-1, None, "en"), (-2, "12 !", None), (-3, "zzqj häuser", None), (None, "la casa", "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_id(df).collect()}
    want = plainly(rows)
    assert len(got) == len(rows)
    for i, lang, score in want:
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, i
