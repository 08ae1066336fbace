"""Language models: probabilities by brute force, and accuracy on rows held out."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from runlens.llm import language_id as L

SAMPLES = {
    "en": ["the cat sat on the mat", "there is a hat on the bed", "this and that and the other thing"],
    "de": ["der hund und die katze", "das ist nicht das haus", "die schöne müllerin und der bach"],
}


def padded(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    out = " " * (L.ORDER - 1)
    for i, c in enumerate(letters):
        if not (c == " " and i and letters[i - 1] == " "):
            out += c
    return out if out.endswith(" ") and text and not text[-1].isalpha() else out + " "


def grams_of(texts):
    counts = Counter()
    for t in texts:
        p = padded(t)
        counts.update(p[i : i + L.ORDER] for i in range(len(p) - L.ORDER + 1))
    return counts


def brute(counts_by_lang):
    """Interpolated Kneser-Ney by its definition."""
    alphabet = len({g[-1] for c in counts_by_lang.values() for g in _lower(c)[0]}) + 1

    def of(levels):
        def p(gram):
            n = len(gram)
            if n == 0:
                return 1 / alphabet
            level = levels[n - 1]
            ones = sum(v == 1 for v in level.values())
            twos = sum(v == 2 for v in level.values())
            d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            same = {g: v for g, v in level.items() if g[:-1] == gram[:-1]}
            total = sum(same.values())
            if not total:
                return p(gram[1:])
            return max(level.get(gram, 0) - d, 0) / total + d * len(same) / total * p(gram[1:])

        return p

    return {lang: of(_lower(counts)) for lang, counts in counts_by_lang.items()}


def _lower(counts):
    levels = [dict(counts)]
    while len(next(iter(levels[0]))) > 1:
        kinds = defaultdict(set)
        for g in levels[0]:
            kinds[g[1:]].add(g[0])
        levels.insert(0, {g: len(s) for g, s in kinds.items()})
    return levels


def model_of(samples):
    out = {}
    for lang, texts in samples.items():
        c = grams_of(texts)
        out[lang] = (np.array([[ord(x) for x in g] for g in c], np.uint32), np.array(list(c.values())))
    return L.build(out)


def test_probabilities_are_kneser_ney():
    model = model_of(SAMPLES)
    exact = brute({k: grams_of(v) for k, v in SAMPLES.items()})
    for text in ["the hat", "der hut", "zzz", "other katze x"]:
        c, starts = L.codes([text])
        logs = L.log_probabilities(model, c)
        p = padded(text)
        for i in range(len(p) - L.ORDER + 1):
            for k, lang in enumerate(model.languages):
                assert math.isclose(logs[i, k], math.log(exact[lang](p[i : i + L.ORDER])), rel_tol=1e-4)


def test_a_batch_scores_as_its_texts_alone():
    model = model_of(SAMPLES)
    texts = ["the cat", None, "", "das haus", "1 2 3", "ﬁ İx", "a\0b", "the  cat!"]
    together = L.score_texts(model, texts)
    for i, t in enumerate(texts):
        alone = L.score_texts(model, [t])
        assert together[0][i] == alone[0][0]
        assert np.allclose(together[2][i], alone[2][0], equal_nan=True)
    assert [int(k) for k in together[0][[1, 2, 4]]] == [-1, -1, -1]


def test_edges(edge_docs, clashing_docs, no_docs):
    model = L.fit(edge_docs)
    got = {r.doc_id: r for r in L.identify(clashing_docs, model).collect()}
    assert L.identify(clashing_docs, model).count() == clashing_docs.count()
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3, 9))
    assert got[7].lang_pred == "de" and got[4].lang_pred == "en"
    assert L.identify(no_docs, model).count() == 0
    kept = L.accepted(clashing_docs, model)
    assert kept.columns == clashing_docs.columns and {1, 2, 3, 9}.isdisjoint(r.doc_id for r in kept.collect())
    nothing = L.fit(no_docs)
    assert {r.lang_pred for r in L.identify(edge_docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from runlens.llm.queries_language import op9

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = op9(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    right, score = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score")).first()
    assert right > 0.98 and 0 <= score <= 1
