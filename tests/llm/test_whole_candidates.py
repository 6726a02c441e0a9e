"""Candidates are seen over the whole reach and measured to their end."""

import pytest
from test_whole_secrets import key

from lectern.llm import secrets


@pytest.mark.parametrize("gap, kinds", [(1, ["novel"]), (49, ["novel"]), (63, ["novel"]), (64, [])])
def test_reach_limits_where_a_candidate_begins(gap, kinds):
    assert [k for _, _, k in secrets.find("bearer" + " " * gap + "q8Zr3TtB1mX0LwVd9Kp and more")] == kinds


def test_random_rest_after_predictable_head():
    word = "xyz1" * 2_000 + key(4, 6_000)
    assert secrets.find(f"the session key {word} ends") == [(16, 16 + len(word), "novel")]
    assert secrets.find(f"the session key {'xyz1' * 4_000}x ends") == []
