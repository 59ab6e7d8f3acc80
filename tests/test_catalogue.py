"""Every catalogue query on sf0.001 against its SQL, and the ones without SQL against invariants or plain Python."""

import os

import duckdb
import pytest

from quarrymill.plans import catalogue, evaluation, finances, purchases, shelves, shown, survey  # noqa: F401  these add their queries to the catalogue


def clean(rows):
    value = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf_dir, con, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM ({catalogue.SQL[name]})").fetchall()
    assert clean([tuple(r) for r in got.select(columns).collect()]) == clean(want)


def test_diversity_caps_and_rank(spark, sf_dir):
    rows = catalogue.QUERIES["diversity_select"](spark, sf_dir).collect()
    assert len(rows) == 40 == len({r.id for r in rows})
    per = {}
    for r in rows:
        per[r.source] = per.get(r.source, 0) + 1
    assert max(per.values()) <= 8
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_max_purchase_price_against_a_scan_of_cents(spark, sf_dir):
    import math

    money = lambda x: math.floor((x + 2.220446049250313e-16) * 100 + 0.5) / 100

    def passes(price, resale):
        landed = money(price + money(price * 0.095) + 5)
        total = money(landed + money(money(resale * 0.15 + 0.3) + money(resale * 0.02) + 7 + money(resale * 0.03)))
        net = money(resale - total)
        return net >= 7 and landed > 0 and math.floor((net / landed + 2.220446049250313e-16) * 1e4 + 0.5) / 1e4 >= 0.3

    rows = catalogue.QUERIES["max_purchase_price"](spark, sf_dir).limit(40).collect()
    frame = spark.createDataFrame([(60.0,), (45.5,), (30.0,), (200.0,)], "resale double")
    from quarrymill.functions.decisions import max_purchase_price

    rows += frame.withColumn("max_price", max_purchase_price("resale")).collect()
    for r in rows:
        cents = [c for c in range(int(r.resale * 100) + 1) if passes(c / 100, r.resale)]
        assert abs(r.max_price - (max(cents) / 100 if cents else 0)) <= 0.011


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_part_is_matched(spark, sf_dir):
    import math

    parts = {r.p_partkey: frozenset(w for w in f"{r.p_name} {r.p_type}".lower().split(" ") if w) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    want = []
    for q, a in parts.items():
        scores = [(len(a & b) / max(len(a), len(b)), i) for i, b in parts.items() if i != q] if len(a) > 1 else []
        best = sorted((-math.floor(s * 1e4 + 0.5) / 1e4, i) for s, i in scores if s >= 0.65)[:3]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    got = catalogue.QUERIES["token_comp_match_all"](spark, sf_dir).select("query_id", "item_id", "score", "rank").collect()
    assert clean([tuple(r) for r in got]) == clean(want)
    assert any(q % 7 for q, *_ in want)


def test_every_word_of_a_text_and_of_an_opening_line_counts(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + " late Digital poster\nsecond line") for i in (55, 110, 165)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = catalogue.QUERIES["expansion_tokens_whole"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in tokens] == [("late", 3, 30), ("digital", 3, 31), ("poster", 3, 32), ("second", 3, 33), ("line", 3, 34)]
    assessed = catalogue.QUERIES["candidate_assessment_whole"](spark, str(tmp_path)).collect()
    assert {r.id: r.reject for r in assessed} == {55: "non_vinyl_format", 110: "non_vinyl_format", 165: "non_vinyl_format"}
