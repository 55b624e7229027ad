import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gymlake.llm import ann, mixing, near_dup, quality, suffix_dedup, token_store, tokens, words
from gymlake.llm.exact_dedup import BinaryFuseFilter
from gymlake.llm.packing import BRANCHES, SEQUENCE, Pool, best_fit_decreasing, bin_completion, dominates, fewest, fillings

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé .!\n1", max_size=60)), max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_word_hashes_tell_words_apart(texts):
    hashes, first = words.word_hashes(*words.text_bytes(pa.array(texts, pa.string())))
    got = [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    want = [plain_words(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    names = {}
    for g, w in zip(itertools.chain(*got), itertools.chain(*want)):
        assert names.setdefault(w, g) == g
    assert len(set(names.values())) == len(names)


def test_shingles_are_sets_of_five_words():
    texts = ["a b c d e f", "A, b; c d e f", "a b c d e a b c d e a b c d e", "a b", "", "..."]
    sets = words.shingles(*words.word_hashes(*words.text_bytes(pa.array(texts))), 5)
    assert [len(s) for s in sets] == [2, 2, 5, 1, 0, 0]
    assert (sets[0] == sets[1]).all()


@given(st.sets(st.integers(0, 2**63 - 1), max_size=400))
@settings(max_examples=60, deadline=None)
def test_fuse_filter_has_no_false_negatives(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert BinaryFuseFilter.build(keys).contains(keys).all()


def test_fuse_filter_false_positives_and_size():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    fuse = BinaryFuseFilter.build(keys)
    assert fuse.contains(keys).all()
    assert fuse.contains(rng.integers(0, 2**63, 200_000).astype(np.uint64)).mean() < 1e-4
    assert len(fuse.cells) < 1.4 * len(keys)


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.data())
@settings(max_examples=100, deadline=None)
def test_blocks_round_trip(ids, data):
    ids = np.array(ids, np.uint32)
    segment = token_store.encode_ids(ids)
    assert (token_store.decode_ids(segment) == ids).all()
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert (token_store.decode_ids(segment, a, b) == ids[a:b]).all()


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library(text):
    enc = tokens.encoder(tokens.default_vocabulary())
    assert enc.encode([text]) == (enc.whole([text]) if text else [b""])


def test_encoder_equals_the_library_on_latin_text():
    enc = tokens.encoder(tokens.default_vocabulary())
    texts = ["".join(chr(c) + x for c in range(1, 0x260)) for x in ("", " ", "a", "'s", "1")] + ["don't DON'T '''s", "a" * 500]
    assert enc.encode(texts) == enc.whole(texts)


def fewest_bins(lengths, capacity):
    best = len(lengths)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for i in {f: i for i, f in enumerate(free) if f >= lengths[k]}.values():
            place(k + 1, free[:i] + [free[i] - lengths[k]] + free[i + 1:])
        place(k + 1, free + [capacity - lengths[k]])
    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_bin_completion_is_optimal_on_small_sets(lengths):
    bins = bin_completion(lengths, 30, branches=100_000)
    assert Counter(x for b in bins for x in b) == Counter(lengths)
    assert all(sum(b) <= 30 for b in bins)
    assert len(bins) == fewest_bins(lengths, 30)


def test_bin_completion_beats_best_fit():
    lengths = [6, 5, 4, 3, 2] * 1 + [44, 30, 26, 24, 22, 20, 18, 16]
    assert len(bin_completion(lengths, 70)) <= len(best_fit_decreasing(lengths, 70))
    assert dominates((5, 5), (5, 4)) and dominates((9,), (5, 4)) and not dominates((5, 4), (6,))


@given(st.lists(st.integers(1, 20), max_size=9), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_fillings_are_all_undominated_ones_in_order(lengths, room):
    feasible = {tuple(sorted(c, reverse=True)) for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if sum(c) <= room}
    want = {f for f in feasible if not any(g != f and dominates(g, f) for g in feasible)}
    got = list(fillings(Pool(lengths), room))
    assert len(got) == len(set(got)) and set(got) == want
    assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_the_lower_bound_holds(lengths):
    assert -(-sum(lengths) // 30) <= fewest(lengths, 30) <= fewest_bins(lengths, 30)


def test_the_search_ends_within_its_nodes():
    lengths = np.random.default_rng(2).integers(1000, 1800, 300)
    few, many = (bin_completion(lengths, SEQUENCE, 10**9, n) for n in (500, 5000))
    assert Counter(x for b in few for x in b) == Counter(int(x) for x in lengths)
    assert len(many) <= len(few) <= len(best_fit_decreasing(lengths, SEQUENCE))
    assert fewest([SEQUENCE - 1] * 5 + [2], SEQUENCE) == 6 == len(bin_completion([SEQUENCE - 1] * 5 + [2], SEQUENCE))


def test_bin_completion_with_production_parameters():
    # 250 full sequences cut in three, each piece between a quarter and a half of one
    rng = np.random.default_rng(1)
    low = SEQUENCE // 4
    cuts = [sorted(rng.integers(0, low + 1, 2)) for _ in range(250)]
    lengths = [int(x) for a, b in cuts for x in (low + a, low + b - a, 2 * low - b)]
    bins = bin_completion(lengths, SEQUENCE, BRANCHES)
    assert Counter(x for b in bins for x in b) == Counter(lengths) and all(sum(b) <= SEQUENCE for b in bins)
    assert len(bins) <= 1.02 * 250  # best fit takes 282


@given(st.dictionaries(st.sampled_from("abcde"), st.integers(1, 40), min_size=1),
       st.dictionaries(st.sampled_from("abcde"), st.integers(1, 9), min_size=5, max_size=5))
@settings(max_examples=200, deadline=None)
def test_phases_place_all_blocks_within_one_block_of_the_shares(blocks, shares):
    shares = {s: shares[s] for s in blocks}
    placed, slot = Counter(), 0
    for phase in mixing.phases(blocks, shares):
        assert phase["slot"] == slot and phase["given"] == {s: placed[s] for s in phase["shares"]}
        total, here = sum(phase["shares"].values()), Counter()
        for _ in range(phase["periods"]):
            for s, *_ in phase["order"] or mixing.pfair_period(phase["shares"]):
                here[s] += 1
                slot += 1
                ran = sum(here.values())
                # while a phase lasts, every source is less than one block from its share
                assert all(abs(here[t] - ran * n / total) < 1 for t, n in phase["shares"].items())
        assert {s: here[s] for s in phase["shares"]} == phase["taken"]
        placed += here
    assert placed == Counter(blocks)


def test_a_source_that_runs_out_is_not_held_back():
    # weights 60 : 60 with 90 and 500 blocks: both keep pace until the 90th block
    at = Counter()
    for phase in mixing.phases({"a": 90, "b": 500}, {"a": 60, "b": 60}):
        for s, *_ in phase["order"] or mixing.pfair_period(phase["shares"]) * phase["periods"]:
            at[s] += 1
            assert at["a"] == 90 or abs(at["a"] - at["b"]) <= 1
    assert at == {"a": 90, "b": 500}


@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 25), min_size=1))
@settings(max_examples=100, deadline=None)
def test_pfair_deviates_by_less_than_a_block(shares):
    total, got = sum(shares.values()), Counter()
    for slot, (source, j, release, deadline) in enumerate(mixing.pfair_period(shares)):
        assert release <= slot < deadline and j == got[source]
        assert release == j * total // shares[source] and deadline == -(-(j + 1) * total // shares[source])
        got[source] += 1
        assert all(abs(got[s] - n * (slot + 1) / total) < 1 for s, n in shares.items())
    assert got == Counter(shares)


@given(st.lists(st.text(alphabet="ab", max_size=40), max_size=6), st.integers(3, 6))
@settings(max_examples=200, deadline=None)
def test_contexts_and_columns_find_every_repeat(texts, length):
    k = 2
    data, offs = words.text_bytes(pa.array(texts, pa.string()))
    text, place, left, right, anchor, digest = suffix_dedup.contexts(data, offs, length, k)
    windows = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    # every window is in one context
    starts = [(t, p - a + o) for t, p, a, b in zip(text, place, left, right) for o in range(a + b - length + 1)]
    assert len(starts) == len(set(starts)) == sum(windows.values())
    # documents of one anchor, aligned on it
    order = np.lexsort((digest, anchor))
    width = 2 * length
    body, begin, end, group = np.zeros((len(order), width), np.uint8), [], [], []
    for row, i in enumerate(order):
        piece = texts[text[i]].encode()[place[i] - left[i]:place[i] + right[i]]
        begin.append(length - left[i])
        end.append(begin[-1] + len(piece))
        body[row, begin[-1]:end[-1]] = np.frombuffer(piece, np.uint8)
        group.append(anchor[i])
    group = np.unique(np.array(group, np.int64), return_inverse=True)[1] if group else np.zeros(0, np.int64)
    low, high = suffix_dedup.repeated_columns(body, np.array(begin, np.int64), np.array(end, np.int64), group, length)
    for row, i in enumerate(order):
        t = texts[text[i]]
        hits = [c for c in range(begin[row], end[row] - length + 1)
                if windows[t[place[i] - left[i] + c - begin[row]:][:length]] > 1]
        assert ([low[row], high[row]] == [hits[0], hits[-1]]) if hits else low[row] > high[row]


def test_bounds_hold_and_estimates_are_close():
    rng = np.random.default_rng(2)
    vectors, queries = rng.normal(size=(3000, 64)), rng.normal(size=(50, 64))
    centre = vectors.mean(axis=0)
    low, high = ann.bounds(*ann.encode(vectors, centre), queries, centre)
    true = queries @ vectors.T
    assert ((low <= true) & (true <= high)).mean() > 0.9995
    assert np.abs((low + high) / 2 - true).mean() < np.abs(true).mean()


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e-4])
def test_few_candidates_are_left_for_double_precision(scale):
    rng = np.random.default_rng(4)
    vectors, queries = scale * rng.normal(size=(2000, 64)), rng.normal(size=(40, 64))
    found = rng.random((40, 2000)) < 0.9
    size = np.sqrt((vectors ** 2).sum(axis=1)).astype(np.float32)
    left = ann.screen(found, vectors.astype(np.float32), size, queries, 20)
    true = np.where(found, queries @ vectors.T, -np.inf)
    best = np.argsort(-true, axis=1)[:, :20]
    assert np.take_along_axis(left, best, axis=1).all() and not (left & ~found).any()
    assert left.sum() < 40 * 60  # of 1,800 each
    # fewer candidates than asked for all stay
    assert (ann.screen(found[:, :15], vectors[:15].astype(np.float32), size[:15], queries, 20) == found[:, :15]).all()


def test_a_cell_gives_the_best_of_each_query():
    rng = np.random.default_rng(6)
    vectors = np.concatenate([rng.normal(size=(900, 16)), np.repeat(rng.normal(size=(2, 16)), 50, axis=0), rng.normal(size=(100, 16)) * 1e4])
    ids = rng.permutation(5000)[:len(vectors)]
    asked, centre = rng.permutation(len(vectors))[:300], vectors.mean(axis=0)
    ids_asked = np.where(np.arange(300) % 3 == 0, ids[asked] + 10_000, ids[asked])  # a third have no row here
    got = ann.search_cell(ids, vectors, ann.encode(vectors, centre), centre, ids_asked, vectors[asked], 7)
    want = []
    for q, v in zip(ids_asked, vectors[asked]):
        score = (vectors * v).sum(axis=1)
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:7]
        want += [(q, ids[i], score[i]) for i in best]
    assert [*zip(*got)] == want


def test_pruning_keeps_what_may_reach_the_threshold():
    least = near_dup.least_matches(0.8, 1e-6)
    assert list(least) == [32, 64, 96, 128] and sorted(least.values()) == list(least.values())
    assert least[128] < 0.8 * 128
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 600).astype(np.uint64)
    near = np.unique(np.concatenate([base[:540], rng.integers(0, 2**63, 60).astype(np.uint64)]))
    far = np.unique(np.concatenate([base[:200], rng.integers(0, 2**63, 400).astype(np.uint64)]))
    sets = [np.unique(base), near, far]
    sig = np.stack([near_dup.signature(s) for s in sets])
    a, b = near_dup.linked_pairs(sig, sets, np.array([0, 0, 1]), np.array([1, 2, 2]), 0.8, least)
    assert list(zip(a, b)) == [(0, 1)]


def test_intersections_by_matrix_and_by_pair_agree():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, rng.integers(0, 200)).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    want = [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(a, b)]
    assert near_dup.common_counts(sets, a, b).tolist() == want
    assert near_dup.common_counts(sets, a[:50], b[:50]).tolist() == want[:50]


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(5)
    y = np.where(np.arange(300) % 3 == 0, 1.0, -1.0)
    rows = [np.unique(np.append(rng.integers(0, 50, 8), 100 if t > 0 else 101)) for t in y]
    values = [np.full(len(r), 1 / np.sqrt(len(r))) for r in rows]
    w = quality.dual_coordinate_descent(rows, values, y)
    margin = np.array([w[r] @ v + w[-1] for r, v in zip(rows, values)])
    assert (np.sign(margin) == y).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys_for_every_vocabulary(name):
    import public_tokenizers
    enc = tokens.encoder(public_tokenizers.path(name))
    assert enc.known == (name == "word_bpe_49k.json")  # others go through the library whole
    texts = [None, "", " ", "Two  words, It's 42!", "naïve CAFÉ\tand\nlines ", "<|endoftext|> x", "中文 \U0001f600", "word " * 5000]
    for _ in range(2):
        assert enc.encode(texts) == [np.array(enc.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
                                     for t in texts]
