"""Mixing, token counts, classifiers and the pipeline against brute force; odd inputs."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpanel.llm import chat, decontaminate, mixing, quality, sharding, simhash, sketches, suffixes, token_counts, toxicity
from gridpanel.llm.common import read
from tests.llm.test_operators import fingerprint

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def test_pfair_windows():
    parts = {"a": 7, "b": 2, "c": 1}
    period, got, served = sum(parts.values()), mixing.serve(parts), Counter()
    for slot, (source, k, at, release, deadline) in enumerate(got):
        assert at == slot and release <= slot < deadline and k == served[source]
        served[source] += 1
        for s, a in parts.items():  # never a whole block off the weight
            assert abs(served[s] - Fraction((slot + 1) * a, period)) < 1
    assert served == parts


def test_mix(spark):
    sizes = {"big": 400, "mid": 90, None: 33}
    rows = [(i, "t", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    weights = {"big": 2.0, "mid": 1.0, None: 1.0}
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights, block_rows=8, period=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    blocks = {(r.source, r.block): (r.slot, r.release_slot, r.deadline_slot) for r in got}
    assert sorted(s for s, _, _ in blocks.values()) == list(range(len(blocks)))
    assert all(release <= slot < deadline for slot, release, deadline in blocks.values())
    assert max(Counter((r.source, r.block) for r in got).values()) == 8
    order = [s for (s, _), _ in sorted(blocks.items(), key=lambda x: x[1][0])]
    lasting = max(i for i, s in enumerate(order) if s is None) // 4 * 4  # while all sources last
    for n in range(1, lasting):
        for s, w in weights.items():
            assert abs(order[:n].count(s) - n * w / 4) < 1


@pytest.mark.parametrize(
    "weights, bound",
    [
        ({"a": 1, "b": 2}, 1),
        ({"a": Fraction(1, 3), "b": Fraction(2, 3)}, 1),
        ({"a": 1e-4, "b": 1.0}, 1),
        ({"a": 1e-6, "b": 0.7, "c": 0.299999}, 2),
        ({"a": 2**0.5, "b": 3**0.5, "c": 0.1, "d": 7.0}, 2),
        ({f"s{i}": 1 / (i + 3) for i in range(40)}, 2),
    ],
)
def test_long_schedules(weights, bound):
    """No source drifts off its weight, however many periods there are."""
    whole, n = mixing.whole_weights(weights), 200_000
    assert all(Fraction(str(w)) * whole["b"] == Fraction(str(weights["b"])) * whole[s] for s, w in weights.items() if "b" in weights)
    total, served, at = sum(whole.values()), Counter(), 0
    for slot, parts, first, lasting in mixing.phases(dict.fromkeys(whole, n), whole, 1000):
        if lasting < total:
            break
        assert slot == at and first == {s: served[s] for s in parts}
        for source, *_ in mixing.serve(parts):
            served[source] += 1
            at += 1
            if at % 7 == 0:
                assert all(abs(served[s] * total - at * w) < bound * total for s, w in whole.items())
    assert max(served.values()) == n


def test_schedules_serve_everything():
    r = np.random.default_rng(3)
    for _ in range(200):
        names = [f"s{i}" for i in range(r.integers(1, 8))]
        blocks = {s: int(r.integers(0, 60)) for s in names}
        weights = mixing.whole_weights({s: float(r.random() ** 4 + 1e-6) for s in names})
        at, served = 0, Counter()
        for slot, parts, first, _ in mixing.phases(blocks, weights, int(r.integers(1, 50))):
            assert slot == at and all(parts.values()) and parts and first == {s: served[s] for s in parts}
            served.update(parts)
            at += sum(parts.values())
        assert served == Counter({s: n for s, n in blocks.items() if n})


def test_to_targets_keeps_all(spark):
    """All rows stay, in the order of the slots of ``mix``; only on request those off target go."""
    rows = [(i, f"t{i}", "ab"[i % 5 == 0]) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    options = {"weights": {"a": 1.0, "b": 3.0}, "block_rows": 4}
    slots = {r.text: (r.slot, r.on_target) for r in mixing.mix(docs, **options).collect()}
    got = [r.text for r in mixing.to_targets(docs, **options).collect()]
    assert sorted(got) == sorted(t for _, t, _ in rows)
    assert [slots[t][0] for t in got] == sorted(s for s, _ in slots.values())
    kept = [r.text for r in mixing.to_targets(docs, only_on_target=True, **options).collect()]
    assert sorted(kept) == sorted(t for t, (_, on) in slots.items() if on) and 0 < len(kept) < len(rows)


def test_token_counts(spark):
    texts = ["", None, "one two three", "one two three", "ünï 12345 ...", "word " * 300, "a\n\n b"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    encoder = token_counts._encoder("test", token_counts.load_vocabulary(), token_counts.PATTERN)
    n = [len(encoder.encode_ordinary(t or "")) for t in texts]
    sums = token_counts.token_counts(docs)
    got = {r.n_tokens: r for r in sums.collect()}
    assert set(got) == set(n)
    for size, r in got.items():
        assert r.docs == n.count(size) and r.docs_total == len(n) and r.tokens_total == sum(n)
        assert r.docs_at_least == sum(x >= size for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= size)
        assert r.truncated_tokens == sum(min(x, size) for x in n)
        assert r.share_within == sum(x <= size for x in n) / len(n)
    cut = {r.context: (r.kept_tokens, r.cut_docs) for r in token_counts.truncated(sums, [0, 2, 50, 10**6]).collect()}
    assert cut == {c: (sum(min(x, c) for x in n), sum(x > c for x in n)) for c in (0, 2, 50, 10**6)}
    half = {r.q: r.n_tokens for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()}
    assert half == {0.5: sorted(n)[3], 1.0: max(n)}


@pytest.mark.parametrize("operator, target", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, operator, target):
    folder = "/root/testdata/sf0.01"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % operator.FOLDS == (0 if operator is quality else 1)
    rows = operator.classify(docs, labels).where(held).join(labels.select("doc_id", target), "doc_id").collect()
    y, s = np.array([r[target] for r in rows]), np.array([r.score for r in rows])
    better = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    assert better > 0.8 and ((s >= 0) & (s <= 1)).all()
    assert (np.array([r.predicted for r in rows]) == (s >= operator.THRESHOLD)).all()


def test_filters_of_the_network():
    """Chunks cover every byte once or twice; a long text scores the same in pieces."""
    r = np.random.default_rng(3)
    for size in (0, 1, 512, 513, 960, 961, 5000):
        text = r.integers(1, 256, size).astype(np.uint8)
        block, first = quality.chunks(text, np.array([0, size]))
        assert first.tolist() == [0, len(block)]
        rebuilt = np.concatenate([block[0], *[b[quality.CHUNK - quality.STRIDE :] for b in block[1:]]])
        assert (rebuilt[:size] == text).all() and not rebuilt[size:].any()
    params = quality.train([b"good text " * 30, b"#### 0000 " * 30] * 8, np.array([1, 0] * 8, np.float32), 0.5, epochs=2)
    text = r.integers(32, 120, 3 << 20).astype(np.uint8)
    whole, _ = quality._logits(params, *quality.chunks(text, np.array([0, len(text)])))
    assert np.allclose(quality._long(params, text), whole, rtol=1e-3, atol=1e-3)


ODD_COLUMNS = ("key", "n", "fp", "row", "block", "slot", "score", "predicted", "size", "root", "n_turns", "segment", "at", "id", "sketch")


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \t\n", "a b", "x" * 200_000, "w1 w2 " * 20_000, "ÄÖ 漢字 \U0001f600", "tie tie", "tie tie", "\x00\x01"]
    rows = [(i, t, None if i % 3 else "s") for i, t in enumerate(texts)]
    rows += [(None, "no id", "s"), (None, None, None), rows[3], rows[3]]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in ODD_COLUMNS])


@pytest.fixture(scope="module")
def odd_labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 1), (6, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")


ODD_ITEMS = [("i", "a b"), ("i", "a b"), (None, "tie tie"), ("e", ""), ("z", None)]


def test_odd_rows(spark, odd, odd_labels):
    """Every row comes back once and columns that keep their meaning keep their values."""
    items = spark.createDataFrame(ODD_ITEMS, "item_id string, text string")
    ids = Counter(r.doc_id for r in odd.collect())

    def same(df, **own):
        rows = df.collect()
        assert Counter(r.doc_id for r in rows) == ids
        assert all(r[c] == v for r in rows for c, v in own.items())
        return rows

    same(simhash.near_duplicates(odd))
    same(sketches.edited_pairs(odd))
    same(suffixes.remove_repeats(odd, texts=False))
    same(quality.classify(odd, odd_labels), key="own key")
    same(toxicity.classify(odd, odd_labels), key="own key")
    same(mixing.mix(odd), key="own key")
    rows = same(sharding.shard(odd, 4), key="own key", row="own row")
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(4))
    hits = {r.doc_id: r for r in same(decontaminate.contamination(odd, items))}
    assert hits[3].n_hit == 2 and list(hits[3].items) == ["i"] and hits[7].n_hit == 2 and not hits[7]["items"]
    kept = quality.accepted(odd, odd_labels, threshold=0.0)
    same(kept, score="own score", predicted="own predicted")
    same(mixing.to_targets(odd, on_target=0.0), slot="own slot", block="own block")
    assert token_counts.token_counts(odd).first().docs_total == sum(ids.values())


def test_empty_tables(spark, odd, odd_labels):
    docs, labels = odd.limit(0), odd_labels.limit(0)
    items = spark.createDataFrame([], "item_id string, text string")
    for found in (
        sketches.edited_pairs(docs), quality.classify(docs, labels), toxicity.classify(docs, labels), mixing.mix(docs),
        mixing.to_targets(docs), decontaminate.contamination(docs, items), token_counts.token_counts(docs), quality.accepted(docs, labels),
    ):
        assert found.count() == 0
    assert decontaminate.contamination(odd, items).where("contaminated or n_hit > 0").count() == 0
    assert quality.classify(odd, labels).where("score between 0 and 1").count() == odd.count()
    assert toxicity.classify(odd, labels).where("score between 0 and 1").count() == odd.count()


def test_odd_turns(spark):
    rows = [(None, 0, "u", "x"), ("a", None, None, None), ("a", 1, "u", "y"), ("a", 1, "u", "y"), ("b", 1, "", "ü" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumn("block", F.lit("own"))
    got = {(r.conv_id, r.part): r.n_turns for r in chat.render(turns).collect()}
    assert got == {(None, 0): 1, ("a", -1): 2, ("a", 0): 2, ("b", 0): 1}
    assert chat.render(turns.limit(0)).count() == 0


def _words(text: str) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _windows(items) -> set[tuple[str, ...]]:
    out = set()
    for r in items:
        w = _words(r.text)
        out |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1))} if w else set()
    return out


def _is_clean(text: str, windows: set[tuple[str, ...]]) -> bool:
    w = _words(text)
    hit = np.zeros(len(w), bool)
    for size in {len(x) for x in windows}:
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit[i : i + size] = True
    return not (hit.any() and 20 * hit.sum() >= len(w))


def test_pipeline(spark):
    """Each stage against brute force on what its predecessor kept."""
    docs = read(spark, SMALL, "documents")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, SMALL).collect(), before.schema)
        assert docs.columns == columns and not docs.exceptAll(before).count()
        tables[name] = (before.collect(), {r.doc_id for r in docs.collect()})

    before, kept = tables["quality"]
    params = quality.fit(read(spark, SMALL, "documents"), read(spark, SMALL, "labels"))
    for r in before:
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        z, _ = quality._logits(params, *quality.chunks(raw, np.array([0, len(raw)])))
        p = float(1 / (1 + np.exp(-(z[0] + params["shift"]))))
        assert abs(p - quality.THRESHOLD) < 1e-4 or (p >= quality.THRESHOLD) == (r.doc_id in kept)

    before, kept = tables["near_duplicates"]
    prints = {r.doc_id: fingerprint(r.text or "") for r in before}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert kept == {i for i in ids if top(i) == i}

    before, kept = tables["decontamination"]
    windows = _windows(read(spark, SMALL, "benchmark").collect())
    assert kept == {r.doc_id for r in before if _is_clean(r.text, windows)}

    before, kept = tables["mix"]
    assert kept == {r.doc_id for r in before}

    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    for s in range(sharding.SHARDS):
        assert [r.slot for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.doc_id)] == list(range(sum(r.shard == s for r in rows)))


def test_shards_serve_in_the_order_of_the_mix(spark):
    """Within every shard of the pipeline's result documents stand in the mix's order."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", "ab"[i % 3 == 0], 6) for i in range(90)], "doc_id long, text string, lang string, source string, n_chars long")
    order = {r.doc_id: n for n, r in enumerate(mixing.to_targets(docs, block_rows=2).collect())}
    placed = docs.join(spark.createDataFrame(list(order.items()), "doc_id long, mix_place long"), "doc_id")
    rows = corpus_pipeline.shard(spark, placed, SMALL).collect()
    assert len(rows) == 90 and [r.doc_id for r in sorted(rows, key=lambda r: r.mix_place)] != list(range(90))
    for s in {r.shard for r in rows}:
        here = sorted((r for r in rows if r.shard == s), key=lambda r: r.mix_place)
        assert [r.served for r in here] == list(range(len(here)))


def test_pipeline_hands_on_the_mix(spark, monkeypatch):
    """Each shard of the result alternates between sources as the mix does: the stage's order is not lost."""
    seen = {}

    def served(spark, docs, sf_dir):
        seen["ids"] = [r.doc_id for r in docs.orderBy(corpus_pipeline.PLACE).collect()]
        return docs

    keep = ("mix", corpus_pipeline.mix)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [keep, ("shard", served)])
    corpus_pipeline.run(spark, SMALL)
    docs = read(spark, SMALL, "documents")
    slots = {r.doc_id: r.slot for r in mixing.mix(docs).select("doc_id", "slot").collect()}
    got = [slots[i] for i in seen["ids"]]
    assert got == sorted(got) and len(got) == docs.count()


def test_shards_serve_in_file_order(spark, tmp_path):
    """Stages that are written and read one by one hand on the order too."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", "ab"[i % 3 == 0], 6) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    mixing.to_targets(docs, block_rows=2).write.parquet(str(tmp_path / "mixed"))
    slots = {r.doc_id: r.slot for r in mixing.mix(docs, block_rows=2).collect()}
    rows = corpus_pipeline.shard(spark, spark.read.parquet(str(tmp_path / "mixed")), SMALL).collect()
    assert len(rows) == 400 and corpus_pipeline.PLACE not in rows[0].asDict()
    for s in {r.shard for r in rows}:
        here = [slots[r.doc_id] for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.served)]
        assert here == sorted(here)
