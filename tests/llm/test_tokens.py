"""Token ids against two public libraries; packing against brute force and its own constraints."""

import base64
import itertools
import json
import os
import random
from collections import Counter

import numpy as np
import pytest

from sedimark.llm import bpe, packing, tokens
from sedimark.llm.bpe import PATTERN, TOKENIZER_DIR, Encoder

if not os.path.exists(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json")):
    pytest.skip("no vocabularies here", allow_module_level=True)


def _texts():
    rng = random.Random(4)
    odd = [None, "", " ", "  ", "\n \n", " lead", "trail ", "a\x1c b", "x\x85 y", "a\u00a0 b \u2003 c", "don't we'll  it's", "日本語 テキスト" * 30, "😀" * 90, "e\u0301", "\ufeffx", "<|endoftext|>", "a" * 3000, "ab" * 900]
    noise = ["".join(rng.choices(["a", "B", " ", "  ", "\n", "\t", "é", "1", "'s", ".", "\u2003", "ab", "\r\n", "你"], k=rng.randint(1, 40))) for _ in range(800)]
    return [*odd, *noise, "".join(rng.choices("abcdefghij", k=6000))]


def test_ids_equal_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts, enc = _texts(), Encoder()
    offsets, ids = enc.encode(texts)
    want = [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [list(ids[a:b]) for a, b in itertools.pairwise(offsets)] == want
    assert list(enc.count(texts)) == [len(x) for x in want]


def test_ids_decode_to_the_text():
    import tiktoken

    with open(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts, enc = _texts(), Encoder()
    offsets, ids = enc.encode(texts)
    assert [t.decode(ids[a:b].tolist()) for a, b in itertools.pairwise(offsets)] == [x or "" for x in texts]


def test_encode_corpus_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "the dock"), (2, ""), (3, None), (1, "the dock"), (4, "  ")], "doc_id bigint, text string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in tokens.encode_corpus(rows).collect())
    assert len(got) == 5 and got[0] == got[1] and got[2:4] == [(2, ()), (3, ())] and len(got[4][1]) == 2
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.token_counts(rows).collect()) == sorted((i, len(x)) for i, x in got)


def _optimum(sizes, cap):
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= cap and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_packing_is_valid_and_close_to_the_optimum(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 17, 30])
    sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 11))]
    p = packing.pack_counts(Counter(sizes), cap)
    held = Counter()
    for pattern, many in p.patterns:
        assert many > 0 and sum(s * q for s, q in pattern.items()) <= cap
        for s, q in pattern.items():
            held[s] += q * many
    best = _optimum(sizes, cap)
    assert held == Counter(sizes) and best <= p.containers <= best + 1


@pytest.mark.parametrize("seed", range(40))
def test_reduction_alone_keeps_the_optimum(seed):
    rng = random.Random(1000 + seed)
    cap = rng.choice([10, 20])
    sizes = [rng.randint(1, cap) for _ in range(8)]
    left, fixed = packing._Counts(Counter(sizes)), 0
    for s in sorted(set(sizes), reverse=True):
        while s in left.n and (mates := packing._dominating(left, s, cap)) is not None:
            for x in [s, *mates]:
                left.take(x, 1)
            fixed += 1
    rest = list(Counter(left.n).elements())
    assert fixed + (_optimum(rest, cap) if rest else 0) == _optimum(sizes, cap)


def test_packs_of_a_corpus(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 3, 7, 7, 7, 12, 25, 64, 1000, 333])) for i in range(500)] + [(500, None), (501, 7), (501, 7)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([(1, 64), (2, 100), (2, 100), (None, 5), (3, None)], "pack_id int, capacity_tokens int")
    placed = packing.pack_corpus(sizes, packs)
    got = placed.collect()
    for pack, cap in ((1, 64), (2, 100)):
        mine = [r for r in got if r.pack_id == pack]
        load, docs = Counter(), Counter()
        for r in mine:
            load[r.container_id] += r.n_tokens
            docs[r.doc_id] += r.n_tokens
        want = Counter()
        for i, n in rows:
            want[i] += n or 0
        assert docs == want and max(load.values()) <= cap and set(load) == set(range(len(load)))
        assert all(r.n_tokens == cap for r in mine if r.piece_no < max(x.piece_no for x in mine if x.doc_id == r.doc_id))
        least = -(-sum(want.values()) // cap)
        assert len(load) <= 1.1 * least
    report = {r.pack_id: r for r in packing.pack_report(sizes, packs).collect()}
    assert report[1].fill <= 1 and report[1].n_containers >= report[1].least_containers and 0 < report[1].n_fixed <= report[1].n_containers


def test_hot_sizes_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_A_BUCKET", 20)
    sizes = spark.createDataFrame([(i, 7 if i % 3 else i % 11) for i in range(400)], "doc_id bigint, n_tokens bigint")
    got = packing.pack_corpus(sizes, spark.createDataFrame([(1, 30), (2, 5_000_000)], "pack_id int, capacity_tokens int")).collect()
    load = Counter()
    for r in got:
        load[r.pack_id, r.container_id] += r.n_tokens
    assert len({(r.pack_id, r.doc_id, r.piece_no) for r in got}) == len(got) == 800
    assert all(n <= (30 if k == 1 else 5_000_000) for (k, _), n in load.items()) and len({c for k, c in load if k == 2}) == 1


def test_slots_split_ranks_by_bucket():
    cells = np.array([packing.cell_of(0, 4, b) for b in range(3)], np.int64)
    p = packing.pack_counts({4: 10}, 10)
    slots = packing.Slots([p], cells, np.array([3, 2, 5], np.int64))
    seen = Counter(int(slots.container(np.array([0]), np.array([4]), np.array([b]), np.array([r]))[0]) for b, n in enumerate([3, 2, 5]) for r in range(n))
    assert seen == Counter({i: 2 for i in range(5)})


def test_merges_out_of_order_go_one_by_one(tmp_path):
    alphabet = bpe.byte_alphabet()
    vocab = {ch: b for ch, b in alphabet.items()}
    for t in ("ab", "aba", "cab"):
        vocab[t] = len(vocab)
    merges = [["ab", "a"], ["c", "ab"], ["a", "b"]]  # uses ab before it is made
    at = tmp_path / "v.json"
    at.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    e = bpe.Encoder(str(at))
    assert not e.in_order

    def plain(word):
        ids, rank = [vocab[c] for c in word], {(vocab[x], vocab[y]): i for i, (x, y) in enumerate(merges)}
        while pairs := [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]:
            r, i = min(pairs)
            ids[i : i + 2] = [vocab["".join(merges[r])]]
        return ids

    for word in ("ab" * 70, "cab" * 50, "abacab" * 30):
        assert e.merge([word.encode()])[0].tolist() == plain(word)
