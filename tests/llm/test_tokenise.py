import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm.tokenise import BYTE_LEVEL, WordwiseEncoder, vocabulary_path

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PAIRS = {name: (WordwiseEncoder(vocabulary_path(name)), Tokenizer.from_file(vocabulary_path(name))) for name in NAMES}
for _, whole in PAIRS.values():
    whole.encode_special_tokens = True
HARD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\nb\n", "it's we'll I'D", "x y  z", "1²3 ٣٤", "Σίσυφος ΟΔΟΣ", "İI ıi", "é ́a", "<|endoftext|> b <|startoftext|>", "ß-ẞ!!  ??", "\t\t a\tb", "日本語 テキスト", "👩‍👩‍👧 ok", "a\x1cb \x85c", "_under_score__ 12.5%%% and### moron***", "\x01a b", "a \x01b \x01", "x\n\ny z\n", "one\ntwo, three.\nFour", "\nfirst", "a\xa0 b", "a\u2003b c", "word " * 300 + "end", "don't\nwe'll"]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.sampled_from(HARD), st.text(max_size=40), st.text(alphabet=" \n\tab'sTZé.,!1²", max_size=40)), max_size=6))
def test_ids_are_the_library_s(name, texts):
    ours, whole = PAIRS[name]
    texts = texts + HARD
    assert [np.frombuffer(x, np.uint16).tolist() for x in ours.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
def test_ids_stay_the_library_s_while_tables_turn_over(name, monkeypatch):
    from lexloom.llm import tokenise

    monkeypatch.setattr(tokenise, "KEPT_PARTS", 5)
    monkeypatch.setattr(tokenise, "KEPT_GLUED", 2)
    ours, whole = WordwiseEncoder(vocabulary_path(name)), PAIRS[name][1]
    draw = np.random.default_rng(1)
    texts = [" ".join(draw.choice(["ab", "cd,", "ef.", "Été", "x-y", "12", "z\nq"], 30)) for _ in range(20)] + [None]
    assert [np.frombuffer(x, np.uint16).tolist() for x in ours.encode(texts)] == [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ours.encode([]) == []


def test_byte_level_pattern_is_the_library_s():
    kind = json.loads(PAIRS[NAMES[0]][1].to_str())["pre_tokenizer"]
    assert kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]
    import public_tokenizers

    assert BYTE_LEVEL == public_tokenizers.PATTERN
