"""Near-duplicates of texts and vectors, components, mixing and chat, against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest

from indicraft.llm import buckets, chat, embedding_dedup, mixing, ngram_join
from indicraft.llm.common import Scratch
from indicraft.llm.components import components

from .conftest import prose


def roots(ids, pairs):
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_paths_stars_and_rings(spark):
    pairs = [(k, k + 1) for k in range(1, 200)] + [(1000, k) for k in range(1001, 1100)] + [(2000, 2001), (2001, 2002), (2002, 2000)] + [(7, 7)]
    got = components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()
    want = roots({i for p in pairs for i in p}, pairs)
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.root].add(want[r.id])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == 3 and len(got) == len(want)


def test_posterior_table():
    from math import comb

    table = ngram_join.least_matches(200, 20, 0.8, 1e-9)
    for n, m in table:
        tail = lambda k, n=n: sum(comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(k + 1))
        assert tail(m) >= 1e-9 and (m == 0 or tail(m - 1) < 1e-9)


def texts_with_copies():
    rng = random.Random(8)
    out = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(120)]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(120)] = f"new{rng.random()}"
            out.append(" ".join(words))
        out.append(" ".join(base))
    return out + [out[0], out[0].upper(), "", None, "one two", "one  two"]


@pytest.mark.parametrize("block", [2, 1024])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "VERIFY_ROWS", block)
    monkeypatch.setattr(buckets.dealt, "__defaults__", (block,))
    texts = texts_with_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    sets = [set(ngram_join.shingles(t or "").tolist()) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = collections.Counter(i for p in pairs for i in p)
    want = roots(range(len(texts)), pairs)
    assert len(pairs) > 40 and got == {i: (links[i], want[i]) for i in range(len(texts))}


def test_exact_overlaps_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    i, j = map(np.array, zip(*itertools.combinations(range(30), 2)))
    assert ngram_join.overlaps(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_keep_one(awkward, clashing, nothing):
    kept = ngram_join.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in kept.collect())
    assert ids == sorted((i is None, i or 0, n) for i, n in [(1, len(prose(1))), (3, 0), (None, len(prose(2))), (None, 0), (4, 0), (5, 6), (6, len(prose(3, 40_000))), (7, 200_000), (9, 7)])
    assert ngram_join.keep_one(nothing).count() == 0


def brute_vectors(rows):
    links, pairs = collections.Counter(), []
    for (i, x, a), (j, y, b) in itertools.combinations(rows, 2):
        if a is None or a != b or x is None or y is None or len(x) != len(y) or None in x or None in y:
            continue
        x, y = np.array(x, float), np.array(y, float)
        if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
        if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
            continue
        if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
            links.update((i, j))
            pairs.append((i, j))
    want = roots([r[0] for r in rows], pairs)
    return {i: (links[i], want[i], want[i] == i) for i, _, _ in rows}, len(pairs)


@pytest.mark.parametrize("block", [3, 1024])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(buckets.dealt, "__defaults__", (block,))
    rng = np.random.default_rng(7)
    rows = []
    for g in range(30):
        base = rng.normal(size=32)
        rows += [(base + rng.normal(size=32) * rng.uniform(0, 0.22)).tolist() for _ in range(8)] + [base.tolist()] * 2
    table = [(i, v, int(i % 7 == 0)) for i, v in enumerate(rows)]
    n = len(table)
    bad = [None, [], [0.0] * 32, [None, *[1.0] * 31], [float("nan")] * 32, [float("inf")] * 32, rows[0][:16], [1e300] * 32]
    table += [(n + k, v, 0) for k, v in enumerate(bad)] + [(n + 50 + k, rows[1], None) for k in range(2)]
    docs = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    want, pairs = brute_vectors(table)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(docs).collect()}
    assert pairs > 300 and got == want


def test_vectors_of_far_labels_and_extreme_norms(spark):
    v = [0.6, 0.8, 0.1]
    rows = [(1, v, 5), (2, v, 5 + 2**32), (3, [x * 1e-200 for x in v], 5), (4, [x * 1e200 for x in v], 5), (5, [x * 5e-324 * 2**40 for x in v], 5), (6, v, -5)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(docs).collect()}
    assert got == {1: (3, 1), 2: (0, 2), 3: (3, 1), 4: (3, 1), 5: (3, 1), 6: (0, 6)}


def test_vector_frames(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_dedup(empty).count() == 0
    rows = [(1, [1.0, 0.0], 1, "own"), (1, [1.0, 0.0], 1, "own"), (None, [1.0, 0.0], 1, "own")]
    out = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")).collect()
    assert [r.n_links for r in out] == [2, 2, 2] and {r.component_id for r in out} == {1}


def test_collision_chances():
    p = embedding_dedup.collision(0.2, embedding_dedup.WIDTH)
    assert (1 - p**embedding_dedup.ROWS) ** embedding_dedup.TABLES < 1e-6


def water(sizes, weights, share):
    total, full = share * sum(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(2 * s for s, f in zip(sizes, full) if f)
        free = sum(w for w, f in zip(weights, full) if not f)
        out = [2 * s if f else rest * w / free for s, w, f in zip(sizes, weights, full)]
        new = [f or t > 2 * s for t, s, f in zip(out, sizes, full)]
        if new == full:
            return out
        full = new


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    names = ["b", "a", "é", "Z", None, "hot"]
    rows = [(k, " ".join("w" * rng.randint(1, 5) for _ in range(int(rng.paretovariate(1)) % 900)), names[5] if k % 3 == 0 else rng.choice(names)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    assert got.equals(mixing.mix(docs.repartition(7)).toPandas().set_index("doc_id").loc[got.doc_id].reset_index()[got.columns])
    assert (got["size"] == got.text.map(lambda t: len(t.split()))).all() and (got.taken == got.copies * got["size"]).all() and (got.taken <= 2 * got["size"]).all()
    order = sorted({s for s in names if s}, key=lambda s: s.encode()) + [None]
    sizes = [int(got["size"][got.source.isna() if s is None else got.source == s].sum()) for s in order]
    for s, size, want in zip(order, sizes, water(sizes, [(3, 1, 2)[k % 3] for k in range(6)], 1.5)):
        own = got[got.source.isna() if s is None else got.source == s]
        assert (own.source_size == size).all() and np.allclose(own.target, want) and abs(own.taken.sum() - want) <= max(2, own["size"].max() * 0.05)


def test_mixing_frames(awkward, clashing, nothing):
    out = mixing.mix(clashing).toPandas()
    assert len(out) == awkward.count() and (out.taken <= 2 * out["size"]).all() and out.target.notna().all()
    assert mixing.mix(nothing).count() == 0


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\s>[\\TURN]x", "[[INST]]", "\\[END]", "", "<|endoftext|> é漢🙂", "[NULL][TEXT]"])
def test_escaping_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def chat_rows():
    return [
        (1, 0, "system", "be [INST] nice"), (1, 1, "user", "hi"), (1, 2, "assistant", "</s>yo é"), (1, 3, "assistant", "two"), (2, 1, "assistant", None),
        (2, 0, "user", ""), (3, 0, "tool[END]", "x"), (3, 1, None, "y"), (3, 1, None, "y"), (3, None, "", "first"), (None, 0, "user", "no id"), (4, 0, "assistant", "z" * 100_000),
    ]


def test_chat_digests_and_masks(spark):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, token_ids string")
    turns = chat.format_turns(df, TOKENIZER)
    got = {r.conv_id: r for r in chat.digests(turns, TOKENIZER).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        want[c].append((r, x or ""))
    assert got.keys() == want.keys()
    for c, parts in want.items():
        learned = "".join(x for r, x in parts if r == "assistant")
        assert got[c].n_turns == len(parts) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{x}\n" for r, x in parts).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    coder = chat.coder(TOKENIZER)
    for r in chat.assemble(turns, TOKENIZER).collect():
        formatted = coder.decode(r.token_ids)
        assert len(formatted) == got[r.conv_id].formatted_chars and len(r.loss_mask) == len(r.token_ids) == got[r.conv_id].n_tokens
        assert formatted.count("[END]") == got[r.conv_id].n_turns and formatted.startswith("<s>") and formatted.endswith("</s>") and sum(r.loss_mask) == got[r.conv_id].loss_tokens
    ties = [(1, 0, "user", x) for x in ("b" * 50, "a", "", "a", "[END]", "é")]
    tied = chat.digests(chat.format_turns(spark.createDataFrame(ties, "conv_id long, turn long, role string, text string"), TOKENIZER), TOKENIZER).first()
    assert tied.turns_sha256 == hashlib.sha256("".join(f"user\n{x}\n" for x in sorted(t[3] for t in ties)).encode()).hexdigest()
    learned = chat.assemble(chat.format_turns(df.filter("conv_id = 1"), TOKENIZER, loss_on_end=True), TOKENIZER).first()
    assert coder.decode([i for i, m in zip(learned.token_ids, learned.loss_mask) if m]) == "<\\/s>yo é[END]two[END]"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(empty, TOKENIZER), TOKENIZER).count() == 0
