"""What a Python worker holds on to."""

import json

import public_tokenizers
from tokenizers import Tokenizer

from corpusmill.llm import common, packing


def test_freed_memory_is_given_back_around_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    assert list(common.releasing(lambda batches: iter(batches))([1, 2])) == [1, 2] and len(calls) == 2


def test_the_tokenizer_gets_few_words_a_call_and_its_vocabulary_is_not_spelled_out(monkeypatch):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        whole, told = json.loads(tokenizer.to_str()), packing._told(tokenizer)
        assert "vocab" not in told["model"] and packing._keeps_words_apart(whole) == packing._keeps_words_apart(told)
    encoder, sizes = packing._Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    real = encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            sizes.append(len(texts))
            return real.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    ids, counts = encoder._ids([f"w{n}" for n in range(10_000)])
    assert max(sizes) <= packing.CALL and len(counts) == 10_000 and counts.sum() == len(ids)
