"""Plans of registered queries over the projections: what they shuffle and derive."""

import pytest

from riftstats.plans import landing, people
from riftstats.sources.fixtures import Tables


@pytest.fixture
def tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    yield Tables(spark, "/root/testdata/sf0.001")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_participants_meet_where_their_match_is(tables):
    """Items and runes come from players that are dealt by match: they are gathered
    and joined there, not shuffled row by row."""
    for query in (people.match_detail, landing.raw):
        plan = plan_of(query(tables))
        assert "Exchange hashpartitioning(match_id" in plan
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(match_id" in x and "participant_id" in x]


def test_repeated_documents_come_from_one_rendering(spark, tmp_path, monkeypatch):
    """Documents come in two batches, each third one again, without a shuffle of texts."""
    from pyspark.sql import DataFrame

    from riftstats.plans import streams

    def unwanted(*_):
        raise AssertionError("texts are dealt out")

    docs = spark.range(99).selectExpr("repeat(cast(id as string), cast(id % 3 + 1 as int)) value").coalesce(3)
    want = sorted([r.value for r in docs.collect()] + [r.value for r in docs.where("length(value) % 3 = 0").collect()])
    monkeypatch.setattr(DataFrame, "repartition", unwanted)
    sizes = []
    lines = streams.repeated(docs, str(tmp_path))
    lines.writeStream.foreachBatch(lambda b, n: sizes.append(sorted(r.value for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == 2 and sorted(sizes[0] + sizes[1]) == want


@pytest.mark.parametrize("name", ["match_facts", "match_facts_lenient", "participant_runes", "participant_items", "match_bans"])
def test_documents_are_rendered_and_read_once(tables, name):
    plan = landing.QUERIES[name][0](tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert len([x for x in plan.splitlines() if "Window [row_number()" in x]) <= 2  # players are derived once


@pytest.mark.parametrize("name", ["match_history", "match_history_ranked_page2", "match_history_family"])
def test_histories_derive_players_once(tables, name):
    """Items and runes come from the page's rows; places and totals share an exchange and a sort."""
    df = people.QUERIES[name][0](tables)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber#") and len([x for x in plan.splitlines() if "Relation [l_orderkey" in x]) == 1
    assert len([x for x in plan.splitlines() if "Window [row_number()" in x]) == 3  # two of the players, one of the page
    assert plan_of(df).count("Exchange hashpartitioning(puuid") == plan_of(df).count("Sort [puuid") == 1


def test_documents_of_carried_rows_are_those_of_tables(spark):
    from riftstats.sources import raw

    t = Tables(spark, "/root/testdata/sf0.001")
    whole = raw.render(t.matches, t.participants, t.bans, t.items, t.runes)
    carried = raw.documents(t.drafts, t.players)
    assert carried.count() > 1000
    assert whole.exceptAll(carried).count() == carried.exceptAll(whole).count() == 0
