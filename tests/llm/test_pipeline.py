"""Each stage on its own input against a plain version, and the whole on small tables with odd rows."""

import random

import pytest
from test_text_dedup import brute, plain_lines, words

import corpus_pipeline as cp
from quillspan.llm import mil

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    items = [(i, " ".join(words(r, 25))) for i in range(5)]
    rows, labels = [], []
    for i in range(260):
        w = words(r, r.randrange(30, 150))
        good = i % 4 > 0
        if not good:
            w = [x + "%%%" for x in w]
        if i % 20 == 1:
            w[5:5] = items[i % 5][1].split()
        text = " ".join(w)
        if i % 3 == 0:
            text += "\nshared footer line"
        rows.append((i, text, "en", f"s{i % 13}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
        else:
            labels.append((i, int(good), None))
    rows += [(1000 + i, rows[1 + 4 * i][1], "en", "s1", 5) for i in range(6)] + [(2000, None, None, None, None), (2001, "", "en", "s0", 0), (None, "null id of words " + " ".join(words(r, 40)), "en", "s0", 0), rows[7]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*items, (9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def listed(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = mil.train(*mil.tables(spark, path))
    kept = cp.quality(spark, docs, path)
    assert kept.columns == docs.columns
    assert sorted(map(repr, listed(kept))) == sorted(repr(x) for x in rows if model.score([mil.passages(x[1] or "")])[0] >= cp.QUALITY)
    assert {x[0] for x in listed(kept)} >= {i for i in range(260) if i % 4}

    bad = plain_lines([(i, t, s) for i, t, _, s, _ in rows], cp.MIN_SITES)
    assert bad == {"shared footer line"}
    lines = cp.lines(spark, docs, path)
    expected = [(i, t if t is None else "\n".join(x for x in t.split("\n") if x not in bad), lang, s) for i, t, lang, s, _ in rows]
    assert lines.columns == docs.columns and sorted(repr(x[:4]) for x in listed(lines)) == sorted(map(repr, expected))
    assert all(x[4] == (None if x[1] is None else len(x[1])) for x in listed(lines))

    near = cp.near_duplicates(spark, docs, path)
    named = [(i if i is not None else 10**9, t) for i, t, *_ in dict.fromkeys(rows)]
    roots = {c for c, _ in brute(named).values()}
    assert sorted(x[0] if x[0] is not None else 10**9 for x in listed(near)) == sorted(roots)

    clean = cp.benchmark(spark, docs, path)
    leaks = {i for i, t, *_ in rows if any(item in (t or "") for _, item in items)}
    assert {x[0] for x in listed(clean)} == {x[0] for x in rows} - leaks


def test_run(spark, folder):
    path, rows, _ = folder
    got = cp.run(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, path)
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= cp.CAPACITY


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
