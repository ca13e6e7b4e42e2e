"""The physical plans keep the properties that matter on large tables."""

import pytest

from taleloom.plans import QUERIES

# Queries that train, loop or store while they are built.
EAGER = ("m", "t7", "t8", "t12", "h10", "a2_", "a4_", "a5_", "a6_", "a10_", "a13_stream")
PLAIN = sorted(n for n in QUERIES if not n.startswith(EAGER))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_nested_loops(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(QUERIES["d5_rows_in_id_set"](spark, small))
    assert "EqualTo(quality,1)" in text
    shuffled = plan(QUERIES["g4_seeded_shuffle"](spark, small))
    assert "ReadSchema: struct<doc_id:bigint>" in shuffled and "text" not in shuffled


def test_samples_are_cut_before_the_shuffle(spark, small):
    text = plan(QUERIES["e8_sample_per_code"](spark, small))
    assert text.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(QUERIES["e8_sample_rows"](spark, small))
    assert "TakeOrderedAndProject" in plan(QUERIES["g1_nearest_to_one"](spark, small))
    assert plan(QUERIES["g2_nearest_to_several"](spark, small)).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["b1_element_text", "b3_page_stories", "b4_consecutive_text", "c14_clean_text",
                                  "f3_hash_split", "f9_augmented_training_rows", "f10_masked_tokens", "t1_sentences",
                                  "t2_token_ids", "t3_sentence_mean_vectors", "t9_hashed_vectors"])
def test_row_work_is_not_shuffled(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "hashpartitioning" not in text and "SinglePartition" not in text
