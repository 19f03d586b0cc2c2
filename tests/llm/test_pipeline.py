from collections import defaultdict

import corpus_pipeline as C
import pytest

from reachspark.llm import decontaminate, quality_rules
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_near_dedup import brute_classes


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The rows before the first stage and after each, by name."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(("documents", docs.collect()))
    for k, (name, stage) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        done = stage(spark, docs, sf)
        if k < len(C.STAGES) - 1:
            assert done.columns == docs.columns
        done.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs.collect()))
    return out


def test_quality_stage_keeps_what_the_rules_keep(spark, sf, steps):
    kept = {r.doc_id for r in quality_rules.query(spark, sf).collect() if r.kept}
    assert {r.doc_id for r in steps[1][1]} == kept and len(steps[1][1]) == len(kept)


def test_line_stage_drops_lines_common_on_a_source(steps):
    before, after = {r.doc_id: r for r in steps[1][1]}, {r.doc_id: r for r in steps[2][1]}
    pages, with_line = defaultdict(int), defaultdict(int)
    for r in before.values():
        pages[r.source] += 1
        for x in {x.strip(" \t\n\x0b\x0c\r") for x in r.text.split("\n")} - {""}:
            with_line[r.source, x] += 1
    for i, r in before.items():
        stays = [x for x in r.text.split("\n") if not (n := with_line[r.source, x.strip(" \t\n\x0b\x0c\r")]) >= 5 or not n > 0.05 * pages[r.source]]
        assert after[i].text == "\n".join(stays) and after[i].n_chars == len(after[i].text)


def test_near_stage_keeps_one_of_each_class(steps):
    classes = brute_classes(sorted((r.doc_id, r.text) for r in steps[2][1]))
    assert sorted(r.doc_id for r in steps[3][1]) == sorted(set(classes.values()))


def test_decontamination_stage_drops_documents_with_hits(spark, sf, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in steps[3][1]], items)
    assert {r.doc_id for r in steps[4][1]} == {i for i, x in hits.items() if not x[1]}


def test_mix_stage_meets_its_targets(steps):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in steps[4][1]:
        size[r.source] += len(r.text.split())
    for r in steps[5][1]:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 < r.taken <= 3 * r.size
    assert sum(target.values()) == pytest.approx(sum(size.values()), abs=1)
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)


def test_run_gives_the_same(spark, sf, steps):
    assert sorted((r.doc_id, r.taken) for r in C.run(spark, sf).collect()) == sorted((r.doc_id, r.taken) for r in steps[-1][1])


def test_hidden_words_are_those_of_the_operator():
    assert decontaminate.tokens("A b") == [b"a", b"b"]
