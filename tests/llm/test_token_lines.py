"""New words go to the tokenizer many in one text, with the ids of the whole text."""

from __future__ import annotations

import random
from array import array

from codestrata.llm import op8_tokens


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_share_texts():
    rng, known = random.Random(8), op8_tokens._Known(op8_tokens.VOCABULARY)
    plain = known.tokenizer
    known.tokenizer = Counting(plain)
    op8 = op8_tokens.sys.modules.setdefault("_known_token_pieces", op8_tokens.types.ModuleType("_known_token_pieces")).__dict__
    before = op8.get(op8_tokens.VOCABULARY)
    op8[op8_tokens.VOCABULARY] = known
    try:
        word = lambda: "".join(rng.choice("abcdeéßñ012.,;!'") for _ in range(rng.randint(3, 12)))
        texts = [" ".join(word() + rng.choice(["", "", "\n" + word(), "\n"]) for _ in range(400)) for _ in range(20)]
        got = op8_tokens.encoder(op8_tokens.VOCABULARY)(texts)
        assert [array("I", plain.encode(t, add_special_tokens=False).ids + [op8_tokens.END_ID]).tobytes() for t in texts] == got
        assert known.tokenizer.texts < 4000  # of about 8,000 different pieces; those that end in a line end go alone
    finally:
        op8.pop(op8_tokens.VOCABULARY)
        if before is not None:
            op8[op8_tokens.VOCABULARY] = before


def test_added_tokens_and_gaps_inside_lines():
    known = op8_tokens._Known(op8_tokens.VOCABULARY)
    texts = ["<|endoftext|>", " <|endoftext|>", "a<|endoftext|>b", " x", "x", "x\ny", " x\ny\nz", "\n", "x\n", "x\n\ny", " ", "", "中", " a\x00b", "'s", " 's", "é\n's"]
    want = [array("I", known.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert known.learn(texts) == want and known.learn(texts[3:7]) == want[3:7] and known.learn([]) == []
