import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from vacancylake.llm import packing, pieces
from vacancylake.llm.wordbpe import tokenizer

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n", "  x", "a  b\n c ", "İstanbul don't it's  a\tb\x1cc naïve ΑΣ ΑΣ. ǅ 12a3 'll..., ﬁ éx 日本語。 \U0001f600ab", "▁x ▁ y▁ z", "x \n y ", "\x00z\x1f", "<|endoftext|> </s> <unk>",
       "re's'the o'clock,  don't. a'D aaaaaaa banana anananana", "The Wandering, thing. THE END!", "x" * 3000, "퟿ é K"]


def lib_ids(texts):
    lib = Tokenizer.from_file(WORD)
    return [lib.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeT HE.,'\n!éßÀ1"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_word_ids_are_the_librarys(texts):
    flat, ends = tokenizer(WORD).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == lib_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeT HE.,'\n▁é"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_piece_ids_and_spans_are_right(texts):
    own = pieces.encoder(PIECE)
    flat, ends = own.encode(texts)
    ids = [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert ids == own.lib.encode(texts) if texts else ids == []
    for t, i in zip(texts, ids):
        spans = own.span_ends(t, np.array(i, np.int32))
        assert not i or spans[-1] == len(t.encode())
        norm, align = pieces.normalise(t, own.charmap, own.dummy, own.squeeze, own.escape)
        assert spans.tolist() == [align[k] for k in np.cumsum(own.norm_size[i])]
        if "▁" not in t:
            parts = [t.encode()[a:b] for a, b in zip([0, *spans], spans)]
            assert b"".join(parts) == t.encode()


def test_odd_texts():
    flat, ends = tokenizer(WORD).encode(ODD)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == lib_ids(ODD)
    own = pieces.encoder(PIECE)
    flat, ends = own.encode(ODD)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == own.lib.encode(ODD)


def test_character_map_normalises_as_the_library():
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(rule.serialized_normalizer_spec())
    charmap = pieces.CharMap(spec.precompiled_charsmap)
    for t in ["ﬁ Ⅷ ①", "  ｆｕｌｌ　ｗｉｄｔｈ  x ", "ガギ", "éa", "日本", "", "   ", "a b"]:
        norm, align = pieces.normalise(t, charmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        assert norm.decode() == rule.normalize(t), t
        assert len(align) == len(norm) + 1 and align == sorted(align) and align[-1] <= len(t.encode())


def test_encode_rows(documents):
    rows = [(1, "A text."), (1, "A text."), (None, "no id"), (2, None), (3, ""), (4, "long words " * 20000)]
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = pieces.encode(documents(rows), PIECE, ("n_tokens", "ids", "span_ends", "decoded")).collect()
    expect = sorted((str(i), lib.encode(t or ""), t or "") for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == expect
    assert all(r["n_tokens"] == len(r["ids"]) == len(r["span_ends"]) for r in got)
    assert pieces.encode(documents([]), PIECE).count() == 0


def held(plan):
    return sum((Counter({s: c * n for s, c in Counter(f).items()}) for f, n in plan), Counter())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(30, 40))
def test_bins_are_whole_and_few(sizes, room):
    counts = dict(Counter(sizes))
    plan = packing.complete_bins(counts, room)
    assert held(plan) == Counter(sizes) and all(sum(f) <= room for f, _ in plan)

    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= room:
                place(k + 1, bins[:b] + [bins[b] + sizes[k]] + bins[b + 1:])
        place(k + 1, bins + [sizes[k]])

    place(0, [])
    assert packing.lower_bound(counts, room) <= best <= sum(n for _, n in plan) <= best + 1


def test_counts_may_be_huge():
    counts = {1024: 10**15, 700: 3 * 10**14, 1: 10**13}
    plan = packing.complete_bins(counts, 2048)
    assert held(plan) == Counter(counts)
    assert packing.complete_bins({}, 2048) == []


def check_packed(rows, got, length=2048):
    lib = lib_ids([t or "" for _, t in rows])
    expect = Counter()
    for (i, _), ids in zip(rows, lib):
        ids = ids + [0]
        for p, a in enumerate(range(0, len(ids), length)):
            part = ids[a:a + length]
            expect[i, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expect
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= length
    return len(by)


def test_pack_rows(documents):
    rows = [(i, f"some words number {i} " * (i % 37)) for i in range(120)] + [(5, "same"), (5, "same"), (None, "no id"), (None, None), (900, None), (901, ""), (902, "very long " * 9000)]
    got = packing.pack(documents(rows), WORD).collect()
    used = check_packed(rows, got)
    assert used <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(documents([]), WORD).count() == 0
    ids = packing.pieces(documents(rows[:3]), WORD, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in ids)


def test_one_length_for_all(documents, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_SALTS", 3)
    rows = [(i, "the same words for every document here") for i in range(700)]
    check_packed(rows, packing.pack(documents(rows), WORD).collect())
