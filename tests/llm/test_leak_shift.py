import pytest

from loomspark.llm.leak import longest_passage

ITEM = [f"w{i}" for i in range(13)]


def seeds(item, doc, k=4):
    return [(i, d) for i in range(len(item) - k + 1) for d in range(len(doc) - k + 1) if item[i : i + k] == doc[d : d + k]]


@pytest.mark.parametrize("at", [1, 2, 3, 9, 10, 11])
def test_words_past_an_omission_or_insertion_count(at):
    # the whole passage counts, wherever the one altered word stands
    for doc in (ITEM[:at] + ITEM[at + 1 :], ITEM[:at] + ["new"] + ITEM[at:]):
        doc = ["before", *doc, "after"]
        assert longest_passage(ITEM, doc, seeds(ITEM, doc)) == 13
