"""The corpus pipeline, stage by stage against plain versions."""

import corpus_pipeline
from __spark_entry__ import queries
from millrace.llm.components import connected_components
from millrace.shared import materialize

from .conftest import SMALL
from .test_documents import check_packing, plain_components, plain_lines, plain_substring


def test_stages(spark, documents):
    docs, held = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SMALL))
        held[name] = [(r.doc_id, r.text) for r in before.collect()]
        if name != "best_fit_packing":
            assert docs.columns == documents.columns
        after = [tuple(r)[:2] for r in docs.select(*docs.columns[:2]).collect()]
        if name == "toxicity":
            assert set(after) <= set(held[name]) and len(after) > 0.8 * len(held[name])
        if name == "line_dedup":
            plain = [(i, t) for i, t, n in plain_lines(held[name], 3, 20) if not n or t.strip()]
            assert sorted(after) == sorted(plain)
        if name == "ngram_jaccard_join":
            kept = {i for i, _, c in plain_components(held[name], 5, 80) if i == c}
            assert sorted(after) == sorted(x for x in held[name] if x[0] in kept)
        if name == "substring_dedup":
            removed = {r[0]: r[2] for r in plain_substring(held[name], 20)}
            texts = dict(held[name])
            for i, t in after:
                assert (t == texts[i]) == (not removed[i])
                assert len(t.split()) == len(texts[i].split()) - removed[i]
            assert all(i in dict(after) for i, n in removed.items() if not n)
    check_packing(docs.collect(), held["best_fit_packing"], 2048)


def test_stages_on_odd_rows(spark, odd, no_documents):
    for name, stage in corpus_pipeline.STAGES:
        if name in ("line_dedup", "ngram_jaccard_join", "substring_dedup"):
            out = stage(spark, odd, SMALL)
            assert out.columns == odd.columns
            kept = {r.doc_id for r in out.collect()}
            assert {None, 1, 3, 4, 5, 6, 8, 14, -5} <= kept
            assert stage(spark, no_documents, SMALL).collect() == []


def test_stages_keep_every_text(spark):
    """Two texts under one id are two documents, and no column name is in the way."""
    from .conftest import words

    five = [" ".join(words(200 + k, 9)) for k in range(5)]
    run, other = " ".join(words(300, 30)), " ".join(words(301, 60))
    texts = [
        (1, "\n".join(five)),
        (2, "\n".join(["first", *five, "last"])),
        (2, "another text"),
        (2, "another text"),
        (3, f"{run} a b c"),
        (4, f"x {run}"),
        (4, f"{other} y"),
        (5, other),
        (5, "z"),
        (None, run),
    ]
    names = "_id", "_new", "row", "left", "changed", "hit", "text_hash", "removed", "n_chars"
    docs = spark.createDataFrame(
        [(i, t, *[f"{k}"] * 8, len(t)) for k, (i, t) in enumerate(texts)],
        "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[:-1]) + ", n_chars int",
    ).repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    def left(name):
        out = stages[name](spark, docs, SMALL)
        assert out.columns == docs.columns and out.schema == docs.schema
        found = out.collect()
        assert all(r.n_chars == len(r.text) for r in found)
        return {int(r._id): r.text for r in found}

    whole = {k: t for k, (_, t) in enumerate(texts)}
    assert left("line_dedup") == whole | {1: "first\nlast"}
    shorter = whole | {1: "first last", 5: "x"}
    assert left("substring_dedup") == {k: t for k, t in shorter.items() if k != 7}
    assert left("ngram_jaccard_join") == {k: whole[k] for k in (0, 2, 3, 4, 6, 8, 9)}


def test_run_is_a_query():
    assert queries()["pipeline"] is corpus_pipeline.run


def test_components(spark, rows):
    chain = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (None, 3), (9, 2), (2, 9), (7, 9)]
    links = spark.createDataFrame(chain, "a long, b long")
    expected = {(k, 100) for k in range(101, 161)} | {(9, 2), (7, 2)}
    assert set(rows(connected_components(links))) == expected
    assert connected_components(links.limit(0)).collect() == []
