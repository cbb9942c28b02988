"""Tables of words grow with the corpus, and no join of theirs goes through the driver."""

from rasterloom.llm import common, spelling


def test_no_join_of_words_is_broadcast(spark, data, monkeypatch):
    plans, written = [], common.written

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(common, "written", noted)
    found = spelling.op13_spelling_variants(spark, data)
    plans.append(("variants", found._jdf.queryExecution().executedPlan().toString()))
    assert {name for name, plan in plans if "Join" in plan} == {"forms", "roots", "variants"}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
