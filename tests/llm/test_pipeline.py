"""The corpus pipeline, against its own stages and against plain Python."""

import hashlib
import random
import re

import public_tokenizers
import tiktoken
from pyspark.sql import Row
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline as cp

from .conftest import DOCS
from .test_duplicates import brute_components, brute_lines


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        out = cp.saved(stage(spark, kept, small), name)
        assert out.columns == docs.columns and out.count() <= kept.count()
        kept = out
    final = {r.doc_id: r for r in cp.run(spark, small).collect()}
    assert set(final) == {r.doc_id for r in kept.collect()} and 0 < len(final) < docs.count()
    assert all(r.n_tokens == len(r.ids) for r in final.values())


def test_edges(spark, clashing_docs, no_docs, small):
    for frame in (clashing_docs, no_docs):
        kept = frame
        for name, stage in cp.STAGES[:-1]:
            kept = cp.saved(stage(spark, kept, small), name)
            assert kept.columns == frame.columns
        assert cp.STAGES[-1][1](spark, kept, small).count() == kept.count()


def test_benchmark_stage_reads_long_runs(spark, tmp_path):
    """Junk of one word or number over and over ended the stage."""
    item = "a question about three rivers and the seven towns that lie along them from north to south"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    junk = ["so, " + "Von " * 20_000, "3,14." * 10_000 + "7"]
    texts = [*junk, *(f"{t} and {item}" for t in junk), None]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, lang="de", source="s", n_chars=len(t or "")) for i, t in enumerate(texts)], DOCS)
    kept = cp.benchmark(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 4]


ENGLISH = (
    "the house where water runs under bridge and people walk along river every morning before they work through "
    "night with friends who bring bread cheese apples from garden behind school while children play music around "
    "table until evening when lights shine over quiet streets"
).split()
GERMAN = (
    "das haus wo wasser unter der brücke fließt und die leute jeden morgen am fluss entlang gehen bevor sie durch "
    "die nacht arbeiten mit freunden welche brot käse äpfel aus dem garten hinter der schule bringen während kinder "
    "musik rund um den tisch spielen bis abends lichter über ruhige straßen scheinen"
).split()
GREEK = "το σπίτι όπου τρέχει νερό κάτω από γέφυρα και άνθρωποι περπατούν κάθε πρωί δίπλα στο ποτάμι".split()
COMMON = "subscribe here for all of our letters and offers"
RARE = "read more about people who work along the river"


def planted():
    """(documents, benchmark items): each stage has something to take out, and something close to it to leave alone."""
    rng = random.Random(12)

    def text(words, n=80):
        drawn = [rng.choice(words) for _ in range(n)]
        return [" ".join(drawn[i : i + 10]) for i in range(0, n, 10)]

    docs, add = [], lambda lines, lang="en", source=None: docs.append(
        ("\n".join(lines) if lines is not None else None, lang, source)
    )
    for i in range(70):
        add(text(ENGLISH), "en", f"s{i % 12}")
        add(text(GERMAN), "de", f"s{i % 12}")
    # languages: nothing to tell it by, or one that wasn't learnt
    for lines in (None, [""], ["12345 !!! ..."], text(GREEK), text(GREEK, 200)):
        add(lines, None, "s1")
    # lines: one on twelve sites, one on nine, and documents with nothing else
    for i in range(12):
        add([COMMON, *text(ENGLISH), f"  {COMMON} "], "en", f"s{i}")
        add([RARE, *text(GERMAN)], "de", f"s{i % 9}")
    add([COMMON, "", COMMON], "en", "s3")
    add([COMMON, "", COMMON], None, None)
    # near duplicates: a chain whose ends are below the limit, copies, and texts that share a passage
    chain = " ".join(text(ENGLISH)).split()
    for at in (None, 20, 50):
        chain = [*chain]
        if at is not None:
            chain[at] = "elsewhere"
        add([" ".join(chain)], "en", "s2")
    for _ in range(3):
        add(text(GERMAN, 60) if not _ else docs[-1][0].split("\n"), "de", "s4")
    passage = text(ENGLISH, 30)
    for _ in range(6):
        add(passage + text(ENGLISH, 60), "en", "s5")
    # benchmark: verbatim, with other numbers, a short item, and half of one
    items = [" ".join(text(ENGLISH, 40)), "when 17 children bring 4 apples to school and 9 friends walk home how many are left", " ".join(text(GERMAN, 6))]
    add([*text(ENGLISH, 40), items[0], *text(ENGLISH, 40)], "en", "s6")
    add([*text(ENGLISH, 40), items[1].replace("17", "23").replace("9", "5"), *text(ENGLISH, 40)], "en", "s7")
    add([*text(GERMAN, 40), items[2], *text(GERMAN, 40)], "de", "s8")
    add([*text(ENGLISH, 40), " ".join(items[0].split()[:9]), *text(ENGLISH, 40)], "en", "s9")
    return [(i, t, lang, source, len(t or "")) for i, (t, lang, source) in enumerate(docs)], list(enumerate(items))


def plain_pipeline(docs, items, encoding):
    """The five stages without Spark and without the operators."""
    learnt = set(ENGLISH + GERMAN)
    known = lambda t: {w for w in re.findall(r"[^\W\d_]+", t or "")}
    docs = [d for d in docs if known(d[1]) and (known(d[1]) & learnt)]
    cleaned = brute_lines([Row(doc_id=d[0], text=d[1], source=d[3]) for d in docs], 10, None)
    texts = {i: t for i, _, _, t in cleaned}
    texts = {i: texts[i] for i, (_, root) in brute_components(texts.items(), 5, 80, 100).items() if i == root}
    tokens = lambda t: " " + " ".join(re.sub(r"\d+", "#", t).split()) + " "
    texts = {i: t for i, t in texts.items() if not any(tokens(item) in tokens(t) for _, item in items)}
    out = {}
    for i, t in texts.items():
        ids = encoding.encode(t, disallowed_special=())
        out[i] = (len(ids), ids, hashlib.sha256(t.encode()).hexdigest())
    return out


def test_run_equals_plain_python(spark, tmp_path):
    docs, items = planted()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ranks = load_tiktoken_bpe(public_tokenizers.path(cp.RANKS))
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = plain_pipeline(docs, items, encoding)
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded_sha256) for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    assert got == want
    assert len(want) == len(docs) - 5 - 5 - 3  # without a known language, copies, and benchmark items


def test_run_on_edge_tables(spark, clashing_docs, no_docs, small, tmp_path):
    for name, frame in (("clashing", clashing_docs), ("none", no_docs)):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    # null, empty, blank and letterless texts go, and all copies of 4 but one row of the id
    assert {r.doc_id for r in cp.run(spark, f"{tmp_path}/clashing").collect()} == {4, 7, 8, 10}
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
