import random
import zlib

import numpy as np
import pytest

from tallyloom.llm import encode, packing

from .helpers import documents, empty, odd_texts, prose


def test_encoder_gives_the_library_s_ids():
    from tokenizers import Tokenizer

    path = encode.default_file()
    library, ours = Tokenizer.from_file(path), encode.encoder(path)
    for text in [*(t or "" for t in odd_texts()), "don't <|endoftext|> x", " \n\n y", "é" * 50]:
        assert ours(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_and_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40, 60)
    bins, offsets, room = packing.best_fit(sizes, 40)
    for b in range(len(room)):
        own = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist()))
        assert [o for o, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))]
        assert sum(s for _, s in own) + room[b] == 40
    assert -(-int(sizes.sum()) // 40) <= packing.lower_bound(sizes, 40) <= len(room)


def test_bound_never_passes_the_optimum():
    def optimum(sizes, capacity):
        best = len(sizes)

        def put(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= capacity:
                    bins[b] += sizes[i]
                    put(i + 1, bins)
                    bins[b] -= sizes[i]
            put(i + 1, [*bins, sizes[i]])

        put(0, [])
        return best

    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 12) for _ in range(8)]
        assert packing.lower_bound(np.array(sizes), 12) <= optimum(sizes, 12)


def test_pack_is_whole_and_gapless(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 900)) for _ in range(120)] + odd_texts()
    rows = packing.pack(documents(spark, texts), group_rows=32).toPandas()
    ids_of = encode.encoder(encode.default_file())
    want = {}
    for i, t in enumerate(texts):
        want[i if i < len(texts) - 1 else None] = np.append(ids_of(t or ""), np.uint32(2)).astype("<u4")
    got = {}
    for r in rows.itertuples():
        d = None if np.isnan(r.doc_id) else int(r.doc_id)
        got.setdefault(d, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert got.keys() == want.keys()
    for d, pieces in got.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at) and crc == zlib.crc32(want[d][at : at + length].tobytes())
            assert length == 1024 or k == 0
            at += length
        assert at == len(want[d])
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024
    bound = packing.lower_bound(rows["length"].to_numpy(), 1024)
    assert bound <= rows["sequence_id"].nunique() <= 1.02 * bound


def test_pack_empty(spark):
    assert packing.pack(empty(spark)).count() == 0
