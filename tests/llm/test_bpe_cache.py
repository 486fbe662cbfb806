"""The size of the caches is the caller's choice and changes no id."""
from fairline.llm.bpe import Backtracking
from fairline.llm.queries import tokenizer_path


def test_caches_hold_what_they_are_given():
    small, large = Backtracking(tokenizer_path(), 2), Backtracking(tokenizer_path(), 1000)
    text = "one two three four, five two one six"
    assert small.encode(text) == large.encode(text) and large.decode(large.encode(text)) == text
    assert len(small.by_word) <= 2 and len(small.by_piece) <= 2 and len(large.by_word) == 6
