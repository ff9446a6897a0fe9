"""op6: a piece is looked up once for each group of texts, and words of letters go to the library's model only."""

import random

import pytest

from terravane.llm import records


class Counted(dict):
    looked_up = 0

    def __getitem__(self, key):
        Counted.looked_up += 1
        return super().__getitem__(key)


def test_a_piece_is_looked_up_once_for_a_group():
    enc = records.Encoder(records.default_tokenizer())
    texts = ["start " + "some words recur\nhere " * 500 + "end"] * 20
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    enc.known, Counted.looked_up = Counted(), 0
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert Counted.looked_up < 20


def test_words_of_letters_are_those_of_the_whole_text(monkeypatch):
    enc = records.Encoder(records.default_tokenizer())
    r = random.Random(7)
    letters = [c for c in map(chr, range(0x41, 0x180)) if enc.letters(c)]
    assert len(letters) == 52 + 23 + 31 + 8 + 128
    texts = [" ".join(r.choice(["", "\n"]) + "".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(40)) for _ in range(100)]
    texts += ["a " + " ".join(letters), "a " + "\n".join(letters), "a " + "x" * 5000, "s t re ve m ll d"]
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts)] == want


@pytest.mark.parametrize("chars", [1, 40, 1 << 22])
def test_groups_of_texts_give_equal_ids(monkeypatch, chars):
    monkeypatch.setattr(records, "GROUP_CHARS", chars)
    enc = records.Encoder(records.default_tokenizer())
    r = random.Random(8)
    texts = ["".join(r.choice(" \n\t.,'ab1é 中s\x1c\xa0᠎") for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["", " ", "\n", "a", "a ", "\na", ""]
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode([]) == [] and [len(x) for x in enc.encode(["", ""])] == [0, 0]
