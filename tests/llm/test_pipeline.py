"""The corpus pipeline, stage by stage, against plain Python."""

import corpus_pipeline
import numpy as np

from tidemark.llm import common, decontaminate, mixing

from .conftest import EDGE
from .test_learned import brute_distance, brute_jaccard_groups
from .test_native import WS, brute_lines

STAGES = dict(corpus_pipeline.STAGES)


def table_distance(item, text):
    """``brute_distance``, a row of the table at a time."""
    codes, place = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)), out=new[1:])
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def test_table_distance():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("ab "), rng.integers(1, 30))) for _ in range(2))
        assert table_distance(a, b) == brute_distance(a, b)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage_works_on_what_its_predecessor_kept(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        got = stage(spark, docs, small)
        after = got.collect()
        texts = {r["doc_id"]: r["text"] for r in after}
        if name == "language":
            kept = [r for r in before if any(c.isalpha() for c in r["text"])]
            assert set(texts) <= {r["doc_id"] for r in kept} and len(after) >= 0.98 * len(kept)
        elif name == "line_dedup":
            want = brute_lines([(r["doc_id"], r["text"]) for r in before], 10)
            assert texts == {w[0]: w[3] for w in want} and len(after) == len(before) and all(r["n_chars"] == len(r["text"]) for r in after)
            assert sum(w[2] for w in want) > 0
        elif name == "near_dedup":
            order = sorted(before, key=lambda r: r["doc_id"])
            group = brute_jaccard_groups([r["text"] for r in order])
            assert sorted(texts) == sorted({order[g]["doc_id"] for g in group}) and len(texts) < len(before)
        elif name == "decontaminate":
            plain = {r["doc_id"]: decontaminate.normal(r["text"]) for r in before}
            targets = [decontaminate.normal(t) for _, t in items]
            bad = {i for i, t in plain.items() if any(table_distance(x, t) <= int(len(x) * 0.06) for x in targets)}
            assert bad == {r["doc_id"] for r in before} - set(texts) and bad
        else:
            assert got.columns == [*columns, "copies", "taken"]
            words = {r["doc_id"]: len([w for w in r["text"].translate({ord(c): " " for c in WS}).split(" ") if w]) for r in before}
            plan = {r["td_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            assert {r["doc_id"]: (r["copies"], r["taken"]) for r in after} == {i: (n, n * words[i]) for i, n in plan.items() if n}
            total = sum(words.values())
            assert 0.9 * 1.5 * total < sum(r["taken"] for r in after) < 1.1 * 1.5 * total and {r["copies"] for r in after} <= {1, 2}
            continue
        assert got.columns == columns
        docs = spark.createDataFrame(after, got.schema)


def test_stages_on_edge_rows(spark, edge, small):
    plain = [tuple(r) for r in EDGE]
    by_id = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    assert by_id(STAGES["language"](spark, edge, small)) == sorted([None, 4, 4, 5, 7, 7], key=str)
    lines = STAGES["line_dedup"](spark, edge, small)
    assert rows(lines) == sorted(((i, t or "", lang, src, len(t or "")) for i, t, lang, src, _ in plain), key=str)
    near = STAGES["near_dedup"](spark, edge, small)
    assert by_id(near) == sorted([None, 1, 4, 5, 6, 7, 7], key=str)
    assert rows(STAGES["decontaminate"](spark, edge, small)) == sorted(plain, key=str)
    mixed = STAGES["mix"](spark, edge, small).collect()
    assert mixed and all(r["text"] and r["text"].strip(WS) and r["taken"] == r["copies"] * len(r["text"].split()) for r in mixed)
    assert len({(r["doc_id"], r["text"]) for r in mixed}) == len(mixed)


def test_stages_on_an_empty_table_and_clashing_columns(spark, empty, clashing, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0, name
        got = stage(spark, clashing, small)
        if name == "mix":
            assert set(got.columns) == {*clashing.columns, "taken"}
        else:
            assert got.columns == clashing.columns
            added = [f"`{c}`" for c in clashing.columns[5:]]
            assert [tuple(r) for r in got.select(*added).distinct().collect()] == [tuple(range(len(added)))]  # as they were
        assert 0 < got.count() <= len(EDGE)


def test_run_leaves_only_the_last_folder(spark, small):
    from pathlib import Path

    before = set(Path(common.shared_folder(spark).removeprefix("file:")).glob("corpus-*"))
    assert corpus_pipeline.run(spark, small).count() > 0
    (new,) = set(Path(common.shared_folder(spark).removeprefix("file:")).glob("corpus-*")) - before
    assert [p.name for p in new.iterdir()] == ["4-mix"]
