"""The corpus queries beside their SQL on the smallest data."""

from pathlib import Path

import pytest
from compare import compare, connect

from fathomry.llm import queries as llm

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, con, name):
    if name in llm.ORACLES:
        assert compare(spark, con, FOLDER, name, llm.QUERIES[name], llm.ORACLES[name]) == ""
    else:
        assert llm.QUERIES[name](spark, FOLDER).count() > 0


def test_counts_are_within_their_error(spark, con):
    """Estimates of all days, addresses and pairs against exact counts."""
    sql = llm._FOUND3.replace("\\n", "\n")
    sql = sql[: sql.index("g AS (SELECT utc_day")] + "x AS (SELECT 1) SELECT utc_day, ip, count(DISTINCT visitor), count(DISTINCT account) FROM e GROUP BY utc_day, ip"
    want = {(d, ip): (v, a) for d, ip, v, a in con.execute(sql).fetchall()}
    got = {(r.utc_day, r.ip): r for r in llm.p3_counts(spark, FOLDER).where("level = 'day_ip'").collect()}
    assert set(got) == set(want)
    for k, (v, a) in want.items():
        assert abs(got[k].visitors - v) <= 5 * got[k].visitors_error + 0.05 * v + 0.5
        assert abs(got[k].accounts - a) <= 5 * got[k].accounts_error + 0.05 * a + 0.5


def test_mixture_keeps_its_promises(spark):
    rows = llm.p8_mix(spark, FOLDER).collect()
    report = {(r.mix_id, r.source): r for r in llm.p8_shares(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows) <= 3 * docs.count()
    for r in report.values():
        mine = [x for x in rows if (x.mix_id, x.source) == (r.mix_id, r.source)]
        assert sum(x.tokens * x.repeats for x in mine) == r.reached_tokens
        caps = spark.read.parquet(f"{FOLDER}/mix_targets.parquet").where(f"mix_id = {r.mix_id}").collect()
        cap = next(c.max_repeats for c in caps if c.source.strip().lower() == r.source)
        goal = min(r.target_tokens, cap * r.available)
        longest = max([x.tokens for x in mine], default=0)
        assert r.most_repeats <= cap and abs(r.reached_tokens - goal) <= max(longest, 2000)
