from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from tokenizers import Tokenizer

from awardtrace.llm import packing
from tests.llm.cases import documents, empty, texts


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(packing.default_paths()[0])
    made.encode_special_tokens = True
    return made


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]


@pytest.mark.parametrize("window", [1024, 64])
def test_every_id_in_one_piece_and_no_padding(spark, tokenizer, window):
    rows = texts() + [(900, "<|endoftext|> text"), (901, "a" * 5000), (902, " " * 3000 + "b"), (903, "word " * 50_000)]
    got = packing.packed(documents(spark, rows), window).collect()
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_key[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        ids = packing.ids_of(r.ids)
        assert len(ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
    want = defaultdict(Counter)
    for key, text in rows:
        want[key][tuple(_ids(tokenizer, text))] += 1
    for key, own in want.items():
        pieces = sorted(by_key[key], key=lambda r: r.start)
        for ids, copies in own.items():  # rows that repeat have pieces of their own
            starts = Counter()
            for r in pieces:
                if r.doc_tokens == len(ids) and tuple(packing.ids_of(r.ids)) == ids[r.start:r.start + r.length]:
                    starts.update(range(r.start, r.start + r.length))
            assert all(starts[i] >= copies for i in range(len(ids)))
    assert sum(r.length for r in got) == sum(len(i) * n for own in want.values() for i, n in own.items())
    sizes = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        sizes.append(sum(r.length for r in own))
    rest = sorted(s for s in sizes if s != window)
    assert all(s < window and s & (s - 1) == 0 for s in rest) and len(set(rest)) == len(rest)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_no_rows(spark):
    assert packing.packed(empty(spark)).count() == 0


def test_closest_against_all_multisets():
    draw = random.Random(2)
    for _ in range(100):
        capacity = draw.randrange(1, 30)
        counts = np.zeros(31, dtype=np.int64)
        for _ in range(draw.randrange(4)):
            counts[draw.randrange(1, 31)] = draw.randrange(1, 4)
        taken = packing.closest(counts, capacity)
        lengths = np.flatnonzero(counts)
        sums = [sum(n * x for n, x in zip(times, lengths)) for times in product(*(range(counts[x] + 1) for x in lengths))]
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= capacity)
        assert all(n <= counts[x] for x, n in taken.items())


@pytest.mark.parametrize("histogram", [{600: 1000}, {1: 5}, {1023: 7, 1: 3}, {511: 400, 700: 3}, {},
                                       {x: x % 5 + 1 for x in range(1, 1024)}, {3: 10 ** 9, 1000: 10 ** 6, 77: 12345}])
def test_plan_gives_every_rank_one_place(histogram):
    plan = packing.plan(histogram)
    total = sum(x * n for x, n in histogram.items())
    assert plan.sequences == total // 1024 + (total % 1024).bit_count()
    some = [(x, r) for x, n in histogram.items() for r in ({*range(min(n, 2000)), n // 2, n - 1} if n > 2000 else range(n))]
    length, rank = np.array(some, dtype=np.int64).reshape(-1, 2).T
    of, start, size, sequence, offset = packing.places(plan, length, rank)
    covered = np.zeros(len(length), dtype=np.int64)
    np.add.at(covered, of, size)
    assert (covered == length).all() and (offset + size <= 1024).all()
    if len(some) == sum(histogram.values()):
        spots = np.concatenate([s * 1024 + np.arange(a, a + n) for s, a, n in zip(sequence, offset, size)]) if len(of) else of
        assert len(np.unique(spots)) == len(spots) == total


def test_both_libraries_cut_alike(tokenizer):
    paths = packing.default_paths()
    draw = random.Random(3)
    chars = [c for c in map(chr, [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 5)])]
    drawn = ["".join(draw.choices(chars, k=40)) for _ in range(1500)]
    drawn += [f"a{c} {c}b{c}{c}  {c}1{c} ! {c}'s" for c in chars[:0x3100]]
    drawn += ["", " ", "\n\n a", "it's  <|endoftext|>", "é" * 1000, "\t" * 900]
    for text in drawn:
        assert packing.encode(text, *paths).tolist() == _ids(tokenizer, text)


def test_parts_of_a_long_text(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PART_CHARS", 50)
    for seed in range(20):
        draw = random.Random(seed)
        text = "".join(draw.choices("ab  \n.é1'", k=3000)) + " tail " * seed
        assert packing.encode(text, *packing.default_paths()).tolist() == _ids(tokenizer, text)
