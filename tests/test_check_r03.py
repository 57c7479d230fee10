"""What the check tool found in round 3: memory of the driver in the pipeline."""

import tracemalloc

import numpy as np


def test_rounds_over_few_edges_make_few_files(spark):
    """A long path over many shuffle partitions: the labels' tables have few files, and the right roots."""
    from vacantia.llm.components import FILES, components

    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = [(i, i + 1) for i in range(400) if i != 250] + [(1000, 1000), (None, 3)]
        labels = components(spark.createDataFrame(rows, "a long, b long"))
        assert len(labels.inputFiles()) <= FILES
        assert {r.node: r.root for r in labels.collect()} == {i: 0 if i <= 250 else 251 for i in range(401)} | {1000: 1000}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_training_holds_no_table_of_all_windows():
    """The network is trained on the driver: its peak stays near the sample's own tables."""
    from vacantia.llm import toxicity

    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(60_000)]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), 1500)).encode() for _ in range(400)]
    tracemalloc.start()
    toxicity.train(texts, [i % 2 for i in range(400)], epochs=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 54 << 20


def test_grams_are_sent_without_probabilities(spark):
    """Messages and answers of the language model are a few bytes a token, with all three levels in them."""
    from types import SimpleNamespace

    import pyarrow as pa

    from vacantia.llm import ngrams
    from vacantia.llm.exchange import packed

    rng = np.random.default_rng(6)
    words = np.array([f"w{i}".encode() for i in range(20_000)])
    pieces = [[*words[np.minimum(rng.zipf(1.3, 2000), 20_000) - 1].tolist(), b""] for _ in range(50)]
    block = ngrams._block(0, list(range(50)), [False] * 50, list(range(50)), [0] * 50, pieces)
    assert sum(len(block[n]) for n in ("counts", "tokens", "trained")) < 1.6 * block["n_tokens"]

    def batch(rows):
        return SimpleNamespace(num_rows=len(rows), slice=lambda i, n: SimpleNamespace(to_pylist=lambda: rows[i : i + n]))

    def answered(made):
        rows = [r for b in made for r in b.to_pylist() if r["block"] is not None]
        return rows, sum(len(r["answer"]) for r in rows)

    (words_sent,) = ngrams._send_words([batch([block])], 1)
    block["answers_1"], _ = answered(ngrams._judge_words([words_sent]))
    for n in (2, 3):
        (sent,) = ngrams._send_grams([batch([block])], n, (256.0, 4.0), 1, (20_000, 100_050))
        size = sum(len(v) for r in sent.to_pylist() for v in r.values() if isinstance(v, bytes))
        block[f"answers_{n}"], got = answered(ngrams._judge_grams([sent], n == 3))
        assert size + got < 3.3 * block["n_tokens"]
    assert isinstance(sent, pa.RecordBatch) and len(packed(np.zeros(9, np.int64))) < 20
