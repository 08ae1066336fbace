"""URL templates, licence notices and benchmark items."""

import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from runlens.llm import decontaminate as dc
from runlens.llm import license_scan as ls
from runlens.llm import url_filter as uf



RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def judged(spark, urls, labels=()):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    pages = pages.withColumns({c: F.lit("x") for c in ("id", "host", "path", "rule", "shape", "template", "bad", "n")})
    marks = spark.createDataFrame(list(labels), "page_id long, bad int")
    return sorted(uf.judge(pages, marks, RULES).collect())


def test_url_parts_and_rules(spark):
    got = judged(
        spark,
        [
            None,
            "",
            "no scheme/at all",
            "HTTP://WWW.Example.NET/en/1?q=/de/#x",
            "http://example.net/de/1",
            "http://notexample.net",
            "http://net/",
            "https://a.example.com/de/5#://b",
            "https://a.example.com/de",
            "https://x.org/fr/",
            "https://x.org?u=http://y.net/",
            "http://É.ORG/fr/é\nb",
        ],
    )
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("www.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "/de/1", "net/", "block"),
        ("notexample.net", "", None, "allow"),
        ("net", "/", "net/", "block"),
        ("a.example.com", "/de/5", "example.com/de/", "block"),
        ("a.example.com", "/de", None, "allow"),
        ("x.org", "/fr/", "org/fr/", "allow"),
        ("x.org", "", None, "allow"),
        ("É.org", "/fr/é\nb", "org/fr/", "allow"),
    ]


def test_templates_are_rejected_by_their_labels(spark):
    urls = [f"http://h.org/bad/{i}" for i in range(30)] + [f"http://h.org/good/{i}" for i in range(30)]
    urls += [f"http://h.org/user{chr(97 + i % 26)}{chr(97 + i // 26)}/page" for i in range(60)]
    labels = [(i, 1) for i in range(25)] + [(i, 0) for i in range(30, 55)] + [(i, 1) for i in range(60, 110)]
    got = judged(spark, urls, labels + labels[:3])
    assert {r.verdict for r in got[:30]} == {"block"} and {r.template for r in got[:30]} == {"/bad/{n}"}
    assert {r.verdict for r in got[30:60]} == {"allow"}
    assert {r.verdict for r in got[60:]} == {"block"} and {r.template for r in got[60:]} == {"/*/page"}


def test_similar_branches_are_merged(spark):
    """Few labels each, one rate: only together they reach the limit."""
    urls = [f"http://h.org/{x}/{i}" for x in "abcdef" for i in range(3)]
    labels = [(i, 1) for i in range(18)]
    assert {(r.verdict, r.template) for r in judged(spark, urls, labels)} == {("block", "/*/{n}")}


def letters(i):
    return chr(97 + i // 26) + chr(97 + i % 26)


def test_branches_without_labels_go_with_their_kind(spark):
    urls = [f"http://h.org/bad/{x}" for x in "abcdefghijkl"] + [f"http://h.org/good/{x}" for x in "abcdefghijkl"]
    labels = [(i, 1) for i in range(9)] + [(i, 0) for i in range(12, 21)]
    got = judged(spark, urls, labels)
    assert {r.verdict for r in got[:12]} == {"block"} and {r.verdict for r in got[12:]} == {"allow"}


def test_what_follows_a_wildcard_is_one_node(spark):
    urls = [f"http://h.org/user/{letters(i)}/{letters(i + 100)}" for i in range(60)]
    got = judged(spark, urls, [(i, 1) for i in range(20)])
    assert {(r.verdict, r.template) for r in got} == {("block", "/user/*/*")}


def test_the_nearest_ancestor_with_labels_decides(spark):
    urls = [f"http://h.org/bad/{i}" for i in range(9)] + ["http://h.org/bad/x/1/y/2", "http://h.org/other"]
    got = judged(spark, urls + [f"http://h.org/fine/{i}" for i in range(9)], [(i, 1) for i in range(9)] + [(i + 11, 0) for i in range(9)])
    assert (got[9].verdict, got[9].template) == ("block", "/bad/**") and {r.verdict for r in got[10:]} == {"allow"}


def test_deep_paths_take_few_turns(spark):
    """Thousands of segments, and a literal placeholder, in a few seconds."""
    deep = "http://h.org/" + "/".join(letters(i % 600) for i in range(5000))
    urls = [deep, deep + "/end", "http://h.org/a/*/b", "http://h.org/a/{n}/b", "http://h.org/a/7/b", "http://h.org"]
    start = time.time()
    got = judged(spark, urls, [(0, 1)] * 3 + [(4, 1)])
    assert time.time() - start < 40 and [r.verdict for r in got] == ["allow"] * 6
    shapes = spark.createDataFrame([(u,) for u in urls[2:5]], "u string").select(uf.shape(F.col("u")))
    assert len({r[0] for r in shapes.collect()}) == 3


def _small_tables(spark, folder, urls, labels):
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic long").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_the_url_twin_states_the_same_tree(spark, tmp_path):
    """Nested wildcards, what follows them, merged kinds, ancestors and branches without labels."""
    from runlens.llm.catalog import QUERIES, SQL

    urls = [f"http://h.org/u/{letters(i)}/p/{letters(7 * i % 60)}/{c}" for i in range(60) for c in "xy"]
    urls += [f"http://h.org/u/main/p/{letters(i)}" for i in range(40)] * 2
    urls += [f"http://h.org/bad/{i}" for i in range(9)] + ["http://h.org/bad/x/1/y/2", "http://h.org/other", "http://h.org"]
    urls += [f"http://h.org/v/{x}" for x in "abcdefghijkl"] + [f"http://h.org/w/{x}" for x in "abcdefghijkl"]
    urls += ["http://h.org/a/*/b", "http://h.org/a/{n}/b", "http://h.org//", "http://h.org/a//b/", None, "none"] * 3
    labels = [(i, int(u is not None and ("/x" in u or "/bad/" in u or "/v/" in u))) for i, u in enumerate(urls) if i % 3 != 1 and "/y/2" not in str(u)]
    folder = _small_tables(spark, tmp_path, urls, labels)
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(SQL["op4_url_filter"]).fetchall()
    got = QUERIES["op4_url_filter"](spark, folder)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "template"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    blocked = {r[5] for r in want}
    assert "/bad/**" in blocked and any(t and t.count("*") >= 2 and "**" not in t for t in blocked), blocked


def test_url_tables_without_rows(spark):
    assert judged(spark, []) == []
    assert len(judged(spark, ["http://a.b/c"], [(5, 1)])) == 1


def test_licence_notices(spark, clashing_docs, no_docs):
    header = ls.NOTICES["Apache-2.0-header"]
    words = header.split()
    changed = " ".join("other" if i == 40 else w for i, w in enumerate(words))  # five shingles of many
    half = " ".join(words[: len(words) // 2])
    filler = "some text that has nothing to do with it " * 30
    texts = {
        1: filler + header + filler,
        2: filler + changed.upper() + "\n" + filler,
        3: filler + half + filler,
        4: "All rights\treserved",
        5: None,
        6: filler + " reserved rights all",
        7: "Released under the MIT License. " * 3,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.template): r for r in ls.scan(docs).collect()}
    pairs = set(got)
    assert (1, "Apache-2.0-header") in pairs and got[1, "Apache-2.0-header"].containment == 1.0
    assert (2, "Apache-2.0-header") in pairs and 0.8 <= got[2, "Apache-2.0-header"].containment < 1
    assert (3, "Apache-2.0-header") not in pairs
    assert (4, "All-rights-reserved") in pairs and (7, "MIT-line") in pairs
    assert not {p for p in pairs if p[0] in (5, 6)}
    assert ls.scan(clashing_docs).count() == 0 and ls.scan(no_docs).count() == 0
    assert ls.scan(docs, {}).count() == 0 and ls.scan(docs, {"empty": "..."}).count() == 0


ITEM = "A shop sells 12 apples for 3.50 dollars each, and Mary Jones buys 12 apples while John pays for the rest of them."


def held(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in dc.find_items(docs, bench).collect()}


def test_changed_values_are_still_found(spark):
    around = "Words before it that matter to nobody. {} And words after it."
    same = ITEM
    moved = ITEM.replace("12", "45").replace("3.50", "7").replace("Mary Jones", "Ann").replace("John", "Bob")
    mixed = ITEM.replace("sells 12", "sells 45")  # one value of the item, two in the text
    texts = [around.format(t) for t in (same, moved, mixed)] + ["Nothing of it at all. " * 9, None, ""]
    got = held(spark, texts, [ITEM, "short words only", None, ""])
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0].n_changed == 0 and got[0, 0].n_slots > 0
    assert got[1, 0].n_changed == got[1, 0].n_slots


def test_an_inconsistent_copy_does_not_hide_a_verbatim_one(spark):
    mixed = ITEM.replace("sells 12", "sells 45")
    apart = "Nothing of it at all, and nothing more. " * 3
    got = held(spark, [f"{ITEM} {apart} {mixed}", f"{mixed} {apart} {ITEM}", f"{mixed} {apart} {mixed}"], [ITEM])
    assert set(got) == {(0, 0), (1, 0)} and {r.n_changed for r in got.values()} == {0}


def test_values_between_matched_windows_do_not_count(spark):
    first = "some words stand here so that windows of the item match one by one before 12 it says"
    then = "and after the middle more words of the same item follow until at last it comes to its end"
    item = f"{first} blue paint costs 12 where it is sold {then}"
    other = f"{first} red wine costs 77 when it was bought {then}"
    assert set(held(spark, [other], [item])) == {(0, 0)}


def test_scattered_windows_are_no_thirteen_tokens(spark):
    phrase = "one two three four five six seven eight"
    item = f"{phrase} and then it goes on with other things until it ends at long last somewhere"
    got = held(spark, [f"{phrase} xx. " * 6, f"{phrase} and then it goes", f"{phrase} and then it goes on"], [item])
    assert set(got) == {(2, 0)} and got[2, 0].n_windows == 6


def test_tables_of_numbers_need_the_same_numbers(spark):
    item = "The numbers 1 2 3 4 5 6 7 8 9 10 11 12 13 14 are given."
    table = " ".join(str(i) for i in range(500, 540))
    same = "Given are " + " ".join(str(i) for i in range(1, 15))
    assert set(held(spark, [table, same, same.replace("14", "15")], [item])) == {(1, 0), (2, 0)}
    assert set(held(spark, ["a 12 b", "a 13 b"], ["12"])) == {(0, 0)}


def test_valued_tokens_are_those_of_canonical(spark):
    texts = [ITEM, "\x04Ann 5\x04kg, Bob B 3.5,7 ml: X\x01y 12 12kg 3%5 usd É a É Ö", None, "", "a 5 Ann b 5kgs 6 kg"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for bare, full in df.select(dc.canonical(F.col("text")), dc.valued(F.col("text"))).collect():
        assert [t[0] if t[0] in "\x01\x02\x03" else t for t in full] == bare


def test_runs_of_any_length_are_one_name_or_number(spark):
    """One stack frame for each word of a run ended the session at about 3 000 words."""
    n = 20_000
    names, numbers = "it says " + "Von " * n, "1.5," * n + "7"
    texts = [f"{t} and then. Before it. {ITEM} And after." for t in (names + "Von", numbers, numbers.replace("5", "22"))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sizes = F.size(dc.canonical(F.col("text"))), F.size(dc.valued(F.col("text"))), F.length(dc.valued(F.col("text"))[2])
    got = [tuple(r) for r in df.select(*sizes).collect()]
    assert [g[0] == g[1] for g in got] == [True] * 3 and len({g[0] for g in got[1:]}) == 1
    assert got[0][2] == len("Von " * n + "Von") + 2 and got[0][0] == got[1][0] + 2
    assert set(held(spark, texts, [ITEM])) == {(0, 0), (1, 0), (2, 0)}


def test_the_item_twin_states_the_same_rules(spark, tmp_path):
    """The cases of the tests here, in one table each: copies by offset, runs, wordless windows, both forms, repeated ids."""
    from runlens.llm.catalog import QUERIES, SQL

    moved = ITEM.replace("12", "45").replace("3.50", "7").replace("Mary Jones", "Ann").replace("John", "Bob")
    mixed = ITEM.replace("sells 12", "sells 45")
    apart = "Nothing of it at all, and nothing more. " * 3
    phrase = "one two three four five six seven eight"
    named = "Mary Jones buys red apples and pays for them later today"
    items = [ITEM, "short words only", None, "", named, f"{phrase} and then it goes on with other things until it ends at long last somewhere",
             "The numbers 1 2 3 4 5 6 7 8 9 10 11 12 13 14 are given.", "12", "\x04Ann 5\x04kg, Bob B 3.5,7 ml: X\x01y 12 12kg 3%5 usd É a É Ö"]
    texts = [f"Before it. {t} And after." for t in (ITEM, moved, mixed, named, f"it says {named}")]
    texts += [f"{ITEM} {apart} {mixed}", f"{mixed} {apart} {ITEM}", f"{mixed} {apart} {mixed}", f"{ITEM} {apart} {moved}", None, "", named]
    texts += [f"{phrase} xx. " * 6, f"{phrase} and then it goes", f"{phrase} and then it goes on", "a 12 b", "a 13 b", items[-1]]
    texts += [" ".join(map(str, range(500, 540))), "Given are " + " ".join(map(str, range(1, 15))), "it has short words only in it"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, ITEM), (0, moved), (9, ITEM)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(SQL["op10_decontaminate"]).fetchall()
    got = QUERIES["op10_decontaminate"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    held_pairs = {r[:2] for r in want}
    assert {(0, 0), (1, 0), (5, 0), (6, 0), (9, 0), (3, 4), (14, 5), (19, 6)} <= held_pairs
    assert not {(2, 0), (7, 0), (12, 5), (13, 5), (18, 6)} & held_pairs


def test_short_items_are_found_after_any_word(spark):
    item = "Mary Jones buys red apples and pays for them later today"
    got = held(spark, [f"{item}. And so on", f"it says {item}", f"it says: {item}"], [item])
    assert set(got) == {(0, 0), (1, 0), (2, 0)}


def test_short_items_match_whole(spark):
    got = held(spark, ["it has short words only in it", "short words"], ["Short words only!"])
    assert set(got) == {(0, 0)} and got[0, 0].item_windows == 1


def test_contaminated_documents_go(spark, clashing_docs, no_docs, edge_rows):
    plain = edge_rows[3].text
    bench = spark.createDataFrame([(1, plain)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    kept = dc.drop_contaminated(clashing_docs, bench)
    assert kept.columns == clashing_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7, 8, 9, 10]
    assert dc.drop_contaminated(clashing_docs, none).count() == len(edge_rows)
    assert dc.find_items(no_docs, bench).count() == 0


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_exact_dedup", "op7_line_dedup", "op8_license_scan", "op10_decontaminate", "op3_ngram_jaccard"])
def test_queries_equal_sql(spark, small, name):
    from oracle import compare, connect
    from runlens.llm.catalog import QUERIES, SQL

    assert compare(QUERIES[name], SQL[name], spark, connect(small), small)[0] is None


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_exact_dedup", "op8_license_scan", "op10_decontaminate"])
def test_native_queries_run_no_python(spark, small, name):
    from runlens.llm.catalog import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


