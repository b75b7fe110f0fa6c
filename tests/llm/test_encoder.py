"""The encoder's shorter ways give what the longer ones give."""

import json

import numpy as np
import pytest
from tokenizers import Tokenizer

from tilewright.llm import id_store
from tilewright.llm.common import WordTokenizer, default_tokenizer


def test_words_of_letters_skip_the_pattern(monkeypatch):
    words = WordTokenizer(default_tokenizer())
    seen = []
    learn = words._learn_joined
    monkeypatch.setattr(words, "_learn_joined", lambda tokenizer, own, space: (seen.append((tokenizer is words.letters, own)), learn(tokenizer, own, space)))
    texts = ["Plain words of letters, some wiTH CAPITALS xqzvw don't é1 naïve\nNext line", "Words again of LETTERS"]
    got = words.encode(texts)
    whole = Tokenizer.from_file(default_tokenizer())
    assert got == [np.asarray(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    letters = {w for short, own in seen if short for w in own}
    assert {"words", "letters", "CAPITALS", "xqzvw", "LETTERS"} <= letters
    assert not letters & {"don't", "é1", "naïve", "\nNext"}
    assert words.encode(texts) == got


@pytest.mark.parametrize("change", [{"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}])
def test_other_pre_tokenizers_keep_their_way(tmp_path, change):
    kind = json.loads(Tokenizer.from_file(default_tokenizer()).to_str()) | {"pre_tokenizer": change}
    (tmp_path / "t.json").write_text(json.dumps(kind))
    assert WordTokenizer(str(tmp_path / "t.json")).letters is None


def test_a_full_cache_is_begun_anew():
    few, many = WordTokenizer(default_tokenizer(), max_words=5), WordTokenizer(default_tokenizer())
    texts = ["one two three four", "five six seven one", "two eight nine ten eleven twelve"]
    assert [few.encode([t]) for t in texts] == [many.encode([t]) for t in texts]


def test_chunks_end_where_they_do_whatever_is_hashed_at_once(monkeypatch):
    ids = np.random.default_rng(1).integers(0, 50_000, 100_000).astype("<u2")
    found = []
    for n in (7, 1 << 10, 1 << 20):
        monkeypatch.setattr(id_store, "STRETCH", n)
        found.append(id_store.candidates(ids).tolist())
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
    assert id_store.candidates(ids[:0]).tolist() == [] and id_store.candidates(ids[:3]).tolist() == [p for p in found[0] if p <= 3]
