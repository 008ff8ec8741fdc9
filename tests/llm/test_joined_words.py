"""Words are encoded many at a time, with the ids that the library gives their texts."""

import numpy as np
import public_tokenizers

from reelgrid.llm import packing
from reelgrid.llm.pretokens import load


class Recorder:
    def __init__(self, encoder):
        self.encoder, self.calls = encoder, 0

    def encode(self, text, **options):
        self.calls += 1
        return self.encoder.encode(text, **options)

    def encode_batch(self, texts, **options):
        self.calls += len(texts)
        return self.encoder.encode_batch(texts, **options)


def test_words_are_encoded_together_with_the_ids_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = load(path)
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("abcdeéßøİIſª'’1²!?-_<|>"), rng.integers(1, 12))) for _ in range(3000)]
    texts = [" ".join(made), "", "it's we'll 'S İẋ á e\tb\n\nc\xa0d", "<|endoftext|> x", "日本 кот", "\x00 \x1c \x85 ok", "'", "' s"]
    ids = packing._Ids(path)
    ids.encoder = recorder = Recorder(plain)
    want = [np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert ids.encoded(texts) == want and ids.encoded(texts[::-1]) == want[::-1]
    whole = sum(packing._Ids(path)._joined(p.split()) is None for p in ("ab cd", "x y z"))
    assert whole == 0 and ids._joined(["it", "a b", "c"]) is None and ids._joined(["a1", ""]) is None
    ids = packing._Ids(path)
    ids.encoder = recorder = Recorder(plain)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnprst"]
    assert ids.encoded([" ".join(words)]) == [np.array(plain.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()]
    assert recorder.calls <= 2
