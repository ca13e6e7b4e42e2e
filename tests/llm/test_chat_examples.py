"""The digest's loss comes from the examples, one for each reply."""

import hashlib

import pytest
from pyspark.sql import functions as F

from taleloom.llm import chat


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"<{c}> says {t}\\") for c in (1, None) for t in range(600)]
    rows += [(2, 0, "user", "no reply")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_loss_is_every_example_s_reply(turns):
    got = {r.conv_id: r for r in chat.chat_digest(turns).collect()}
    assert set(got) == {1, 2, None} and got[2].loss_chars == 0
    for conv in (1, None):
        loss = "".join(f"<{conv}> says {t}\\" for t in range(1, 600, 2))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_an_example_left_out_is_missed(turns, monkeypatch):
    whole = {r.conv_id: r.loss_chars for r in chat.chat_digest(turns).collect()}
    examples = chat.prefix_examples
    monkeypatch.setattr(chat, "prefix_examples", lambda pieces: examples(pieces).filter("NOT conv_id <=> 1 OR turn <> 301"))
    fewer = {r.conv_id: r.loss_chars for r in chat.chat_digest(turns).collect()}
    assert fewer == {**whole, 1: whole[1] - len("<1> says 301\\")}


def test_an_example_is_its_whole_context_and_its_reply(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"<say {t}>") for t in range(600)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in chat.prefix_examples(chat.format_turns(turns)).collect()}
    assert sorted(got) == list(range(1, 600, 2))
    context = ""
    for _, t, role, text in rows:
        reply = text.replace("<", "\\l").replace(">", "\\g")
        if t % 2:
            assert got[t].text == context + f"<turn {role}>" + reply
            assert got[t].text[got[t].start : got[t].end] == reply
        context += f"<turn {role}>{reply}</turn>\n"


def test_the_digest_reads_the_examples(turns, monkeypatch):
    examples = chat.prefix_examples
    monkeypatch.setattr(chat, "prefix_examples", lambda pieces: examples(pieces).withColumn("text", F.upper("text")))
    got = {r.conv_id: r for r in chat.chat_digest(turns).collect()}
    loss = "".join(f"<1> says {t}\\" for t in range(1, 600, 2))
    assert got[1].loss_chars and got[1].loss_sha256 != hashlib.sha256(loss.encode()).hexdigest()
