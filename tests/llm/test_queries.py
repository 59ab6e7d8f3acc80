"""The registered queries: whole tables, stable columns, and the SQL where there is one."""

import os

import duckdb
import pytest

from quarrymill.llm import queries as llm


def rows(frame, columns):
    clean = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in frame), key=repr), columns


@pytest.mark.parametrize("name", sorted(set(llm.oracle_sql()) - {"op4_suffix_dedup"}))
def test_query_equals_sql(spark, sf_dir, name):
    got = llm.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert rows([tuple(r) for r in got.select(columns).collect()], columns) == rows(want, columns)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame, sizes = docs, [docs.count()]
    for name, stage in p.STAGES:
        from quarrymill.llm.blocks import stored

        frame = stored(stage(spark, frame, sf_dir), f"test-{name}")
        assert name == p.STAGES[-1][0] or frame.columns == p.COLUMNS
        sizes.append(frame.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert frame.where("not round_trip").count() == 0


def test_pipeline_decisions(spark):
    """Each stage on a handful of rows: what it has to drop goes, clean rows stay, other columns survive."""
    import random

    import corpus_pipeline as p

    rng = random.Random(2)
    text = lambda n: ". ".join(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(12)) for _ in range(n)) + "."
    base, passage = text(8), text(6)
    near = base.replace(base.split()[40], "other", 1)
    rows = [(1, base), (2, near), (3, base), (4, text(5) + "\n" + passage), (5, text(5) + "\n" + passage), (6, text(9)), (None, text(4)), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in p.drop_near_copies(spark, docs, "").collect()) == [0, 1, 4, 5, 6, 7]
    cut = {r.doc_id: r for r in p.cut_repeats(spark, docs, "").collect()}
    assert passage in cut[4].text and passage not in cut[5].text and cut[6].text == rows[5][1] and cut[5].n_chars == len(cut[5].text)
    assert 3 not in cut and cut[1].text == base
    tokens = {r.doc_id: r for r in p.tokenise(spark, docs, "").collect()}
    assert len(tokens) == 8 and all(r.round_trip and len(r.ids) == r.n_pieces for r in tokens.values())


def test_pipeline_drops_contaminated_documents_only(spark, tmp_path):
    import corpus_pipeline as p

    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in ((1, "x " + item), (2, "one two three"), (None, None), (3, item.upper() + "!"))], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.drop_contaminated(spark, docs, str(tmp_path)).collect()} == {2, None}
