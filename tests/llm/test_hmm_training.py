import numpy as np

from tessera.llm import hmm


def test_every_pass_is_over_all_texts(spark):
    """The model is that of plain Baum-Welch over all texts in every pass, the first included: no text counts for more than others."""
    rng = np.random.default_rng(6)
    texts = [np.append(rng.zipf(1.5, rng.integers(0, 12)) % 5, 5).astype(np.uint16) for _ in range(900)]
    words = np.bincount(np.concatenate(texts), minlength=6)
    vocab = hmm.Vocabulary(np.arange(5, dtype=np.uint64), words[:5], np.zeros(hmm.BUCKETS, np.int64), np.zeros(hmm.BUCKETS, np.int64), int(words.sum()), 6, len(texts))
    got = hmm.train(spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "symbols binary").repartition(5), vocab)
    want = hmm.first_guess(vocab.unigram())
    for _ in range(hmm.PASSES):
        want = hmm.maximise(*hmm.expected(want, sorted(texts, key=lambda t: -len(t)), vocab.symbols)[:3], vocab.unigram())
    assert all(np.allclose(a, b, rtol=1e-6) for a, b in zip(got, want, strict=True))
