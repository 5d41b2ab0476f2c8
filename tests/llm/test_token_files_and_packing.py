import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from gristmill.llm import packing, token_files
from gristmill.llm.encoder import Encoder
from gristmill.llm.queries import tokenizer_path

ROWS = [(5, "The cat sat.\nOn  a mat"), (2, None), (9, ""), (None, "no id"), (3, "x <|endoftext|> y"), (4, "a\n b"), (7, "naïve café　 z\t1\r\n2"), (8, "word " * 9000), (8, "again"), (6, "😀" * 30)]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


def ids_of(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(encoder):
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\t　 é.,!\r\x85'12sß<|") for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [t or "" for _, t in ROWS]
    got = [x for _, ids, n in encoder.column(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert all(list(x) == ids_of(encoder, t) for x, t in zip(got, texts, strict=True))


def test_round_trip(spark, docs, encoder):
    got = sorted((tuple(r) for r in token_files.token_file_round_trip(docs(ROWS, extra=True), tokenizer_path()).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*ids_of(encoder, t), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_file_round_trip(docs([]), tokenizer_path()).count() == 0


@pytest.mark.parametrize("kind", ["one", "two", "skewed", "even"])
def test_codes(kind):
    rng = np.random.default_rng(3)
    counts = {"one": np.eye(1, 9, 4)[0] * 5, "two": np.eye(2, 9).sum(0), "skewed": 2.0 ** np.arange(40), "even": np.ones(50257)}[kind].astype(np.int64)
    lengths = token_files.code_lengths(counts)
    used = lengths > 0
    assert (used == (counts > 0)).all() and lengths.max() <= 16 and (2.0 ** -lengths[used].astype(float)).sum() <= 1
    ids = rng.choice(np.flatnonzero(used), 70_000).astype("<u2")
    out = io.BytesIO()
    for k in range(0, len(ids), token_files.BLOCK):
        token_files.write_block(out, ids[k : k + token_files.BLOCK], token_files.canonical_codes(lengths), lengths)
    blocks = list(token_files.read_blocks(io.BytesIO(out.getvalue())))
    assert (np.concatenate(token_files.unpack(blocks, token_files.decode_table(lengths), np.dtype("<u2"))) == ids).all()
    alone = token_files.unpack(blocks[1:], token_files.decode_table(lengths), np.dtype("<u2"))[0]
    assert (alone == ids[token_files.BLOCK :]).all()
    broken = bytearray(out.getvalue())
    broken[100] ^= 1
    with pytest.raises(ValueError):
        list(token_files.read_blocks(io.BytesIO(bytes(broken))))


def test_length_limit_is_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    best = {n: int((counts * token_files.code_lengths(counts, n)).sum()) for n in (4, 5, 9, 12)}
    assert best[9] == best[12] <= best[5] <= best[4]
    assert token_files.code_lengths(counts, 4).max() == 4


def best_fit(lengths, capacities, overhead, attention):
    """One piece after the other into the tightest bin."""
    counts, bins, supply = Counter(lengths), [], sum(lengths)
    for length in sorted(counts, reverse=True):
        supply -= length * counts[length]
        left, size = counts[length], None
        for _ in range(counts[length]):
            fits = [(c - u, k) for k, (c, u) in enumerate(bins) if c - u >= length]
            if fits:
                bins[min(fits)[1]][1] += length
            else:
                if size is None:
                    held = lambda c: min(c // length, left) * length
                    size = min((c for c in capacities if c >= length), key=lambda c: ((overhead + c + attention * c * c) / (held(c) + min(c - held(c), supply)), c))
                bins.append([size, length])
            left -= 1
    return sorted(u for _, u in bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacities = tuple(sorted(rng.sample(range(10, 60), 3)))
    lengths = [rng.randint(1, capacities[-1]) if rng.random() < 0.7 else rng.choice([5, 7]) for _ in range(rng.randint(1, 120))]
    plan = packing.Plan(dict(Counter(lengths)), capacities, 3, 0.01)
    assert sorted(u for _, n, _, u in plan.groups for _ in range(n)) == best_fit(lengths, capacities, 3, 0.01)
    assert all(c >= u and not any(u <= x < c for x in capacities) for _, _, c, u in plan.groups)


def test_every_piece_has_its_place(docs, encoder):
    rows = ROWS + [(100 + k, "same words here") for k in range(60)]
    got = packing.pack(docs(rows, extra=True), tokenizer_path(), capacities=(16, 32, 64)).toPandas()
    want = Counter()
    for i, t in rows:
        want[i] += len(ids_of(encoder, t))
    sums = got.groupby("doc_id", dropna=False).n_tokens.sum()
    assert {(None if i != i else int(i)): int(n) for i, n in sums.items()} == dict(want)
    assert got[got.n_tokens == 0].bin_id.isna().all() and got[got.n_tokens > 0].bin_id.notna().all()
    for _, b in got[got.n_tokens > 0].sort_values("slot_start").groupby("bin_id"):
        assert b.capacity.nunique() == 1 and b.n_tokens.sum() <= b.capacity.iloc[0]
        assert list(b.slot_start) == [0, *b.n_tokens.cumsum()[:-1]]
    assert packing.pack(docs([]), tokenizer_path()).count() == 0
