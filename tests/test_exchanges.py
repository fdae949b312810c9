"""Queries over words deal documents once, by doc_id, and not their words again."""

import pytest

from trajecta.plans.registry import QUERIES


@pytest.mark.parametrize(("name", "most"), [("chunk_first_write", 1), ("token_word_spans", 1), ("closure_depth", 1), ("tree_closures", 1)])
def test_words_are_not_dealt_again(spark, sf_dir, name, most):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most
