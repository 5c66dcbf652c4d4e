"""Conversations of many turns: work grows with their length."""

import time

import pytest

from tidewright.llm import chat


def rows(spark, n, alternate):
    role = "case when id % 2 = 0 then 'user' else 'assistant' end" if alternate else "'assistant'"
    return spark.range(n).selectExpr("1L as conv_id", "id as turn", f"{role} as role", "concat('text <|im_end|> ', id) as text")


@pytest.mark.parametrize("alternate", [True, False], ids=["many blocks", "one block"])
def test_twenty_thousand_turns(spark, alternate):
    def took(n):
        begin = time.perf_counter()
        r = chat.read_chats(chat.format_chats(rows(spark, n, alternate))).first()
        assert len(r["turns"]) == n and r["turns"][7]["text"] == "text <|im_end|> 7"
        losses = [f"text <|im_end|> {i}" for i in range(n) if i % 2 or not alternate]
        assert r["loss_texts"] == losses
        return time.perf_counter() - begin

    took(100)
    assert took(20_000) < 5 * took(5_000) + 10
