"""Quality rules, source mixing, line dedup: edge cases, and the SQL on a small table."""

import os
import random
from collections import defaultdict
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from reachspark.llm import common, decontaminate, line_dedup, near_dedup, quality_rules, registry, source_mix


def tuples(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_gives_the_same(spark, sf, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    sql = c.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, sf)
    assert sorted(sql.columns) == sorted(got.columns)
    columns = sorted(got.columns)
    assert tuples(got, *columns) == sorted(([x[sql.columns.index(k)] for k in columns] for x in sql.fetchall()), key=str)


def brute_rules(text):
    import re

    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t\n\x0b\x0c\r]", x)]
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    at = {i + j for x in seen.values() if len(x) > 1 for i in x for j in range(3)}
    failed = len(w) < 50 or 100 * len(at) > 50 * len(w)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(at), failed]


def test_base_rules(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n ", "a", "a b c a b c", "a a a a", "x\ny\nx\n\n\n x", "é ß 日本 😀 #$|", "A\x0bB\x0cC\rD", "b " * 5000] + [" ".join(rng.choice("abcd") for _ in range(n)) for n in (2, 3, 5, 40, 200)]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", "k") for i, t in enumerate([*texts, texts[4]])], "doc_id long, text string, lang string, kept string")
    out = quality_rules.score(df)
    assert out.columns.count("kept") == 1
    for r in out.collect():
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] == brute_rules(r.text)
        assert r.kept == (not r.base_failed)  # too few documents for a reference
    assert quality_rules.keep(df).columns == df.columns and quality_rules.score(df.limit(0)).count() == 0


def test_far_documents_go(spark):
    rng = random.Random(2)
    common = quality_rules.COMMON_WORDS["en"]
    plain = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300))
    rows = [(i, plain(), "en") for i in range(60)] + [(100, plain().upper().replace(" ", "!! "), "en"), (101, "".join(c + "#" if c == " " else c for c in plain()), "en"), (102, plain().upper(), "xx"), (103, plain().upper(), None)]
    kept = {r.doc_id for r in quality_rules.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept >= set(range(60)) and not kept & {100, 102, 103}  # the last two by the characters of all languages


def test_distance_is_symmetric_and_bounded(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    r = spark.range(1).select(quality_rules.js_distance(a, b).alias("x"), quality_rules.js_distance(a, a).alias("y")).first()
    assert r.x == pytest.approx(1) and r.y == 0


def test_mix_budgets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(9, None, "b"), (9, "x", "b"), (9, "x", "b"), (None, "y z", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    for range_rows in (4096, 16):
        out = source_mix.mix(df, range_rows=range_rows).collect()
        size, taken, target = defaultdict(int), defaultdict(int), {}
        for r in out:
            size[r.source] += r["size"]
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert r.taken <= 3 * r["size"] and r["size"] == len((r.text or "").split())
        assert sum(target.values()) == pytest.approx(sum(size.values()), abs=0.01)
        assert all(target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 2 for s in size)
    again = source_mix.mix(df.repartition(7))
    assert tuples(again, "doc_id", "text", "taken") == sorted(([r.doc_id, r.text, r.taken] for r in out), key=str)
    assert source_mix.mix(df.limit(0)).count() == 0
    assert {r.taken for r in source_mix.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()} == {0}


def test_mix_meets_its_targets_without_ids(spark):
    """Rows that share a doc_id, or have none, and a size are cut apart by their texts."""
    for doc_id in (None, 7):
        rows = [(doc_id, f"a b c d {s}{i}", s) for s, n in (("a", 40), ("b", 3), ("c", 60)) for i in range(n)]
        out = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        taken, target = defaultdict(int), {r.source: r.target for r in out}
        for r in out:
            taken[r.source] += r.taken
        assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_lines(spark):
    rows = [(i, f"head\nown {i}\n foot \n", "a", 0) for i in range(20)] + [(i, f"own {i}\nfoot" if i % 2 else None, None, 0) for i in range(20, 40)] + [(50, "head", "b", 0), (50, "head", "b", 0), (60, "", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    for most in (10**6, 0):
        got = {r.doc_id: r for r in line_dedup.dedup_lines(df, broadcast_lines=most).collect()}
        assert got[3].text == "own 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
        assert got[21].text == "own 21" and got[22].text is None and got[22].n_lines == 0
        assert got[50].text == "head" and got[60].text == "" and got[60].n_dropped == 0
    assert line_dedup.stage(df).columns == df.columns and line_dedup.stage(df).count() == len(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_names_never_clash(spark):
    """Columns of any temporary name, in any case, come through an operator as they are."""
    rng = random.Random(4)
    names = ["m_size", "M_KEY", "m_cut", "c_source", "l_lines", "l_site", "L_all", "q_lang", "q_text", "q_row", "g_id", "g_key", "x_id", "d_key", "d_row", "d_all", "b_site", "s_site", "p_source", "in_0", "in_0_held", "kept_1", "size", "kept", "n_lines"]
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(80)) + "\nfooter line" for _ in range(12)]
    rows = [(i, texts[i % 12], "en", "s", 80, *[f"{n}{i}" for n in names]) for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names))
    benchmark = spark.createDataFrame([(1, "not in any text")], "item_id long, text string")
    for out in (quality_rules.keep(df), line_dedup.stage(df), near_dedup.keep_one(df), decontaminate.clean(df, benchmark), source_mix.mix(df), quality_rules.score(df), line_dedup.dedup_lines(df)):
        found = out.collect()
        lower = [c.lower() for c in out.columns]
        assert len(set(lower)) == len(lower) and found
        for r in found:
            assert all(r[n] == f"{n}{r.doc_id}" for n in names if n in out.columns and n not in ("size", "kept", "n_lines"))
            assert {n.lower() for n in names} <= set(lower)


def test_rows_that_share_an_id_stay_documents(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1] + " x"), (None, texts[2]), (None, texts[0]), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(df).collect()), key=str)
    assert got == sorted([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, None), (3, "")], key=str)


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://somewhere:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session)


def test_stored_tables_are_cleared(spark):
    df = common.stored(spark.range(3), "x")
    path = df.inputFiles()[0]
    common.clear(spark)
    assert not os.path.exists(path.removeprefix("file:").replace("///", "/"))


def test_quality_measures_texts_once(spark, sf, monkeypatch):
    """References are means of the written measures: no text is measured again for them, and the verdicts' table holds no text."""
    seen, measure, store = [], quality_rules.histograms, quality_rules.stored
    monkeypatch.setattr(quality_rules, "histograms", lambda *a: (seen.append("measured"), measure(*a))[1])
    monkeypatch.setattr(quality_rules, "stored", lambda df, name: (seen.append((name, "in_0_held" in df.columns, "text" in df.columns)), store(df, name))[1])
    assert quality_rules.query(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert seen == ["measured", ("measures", True, False), ("language-references", False, False)]
