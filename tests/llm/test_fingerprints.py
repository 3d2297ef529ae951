import hashlib
import random

import numpy as np
import pytest
import xxhash

from textloom.llm import fingerprints as fp


def plain_chunks(data):
    """Chunks byte by byte from the definition: digest and length of each distinct one."""
    gear = [int(x) for x in np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)]
    out, start = {}, 0
    for end in range(1, len(data) + 1):
        size = end - start
        h = sum(gear[b] << age for age, b in enumerate(reversed(data[max(0, end - 32) : end]))) % 2**32
        zeros = 6 if size < 48 else 4
        if end == len(data) or size >= 16 and (h < 2 ** (32 - zeros) or size == 192):
            out[xxhash.xxh3_64_intdigest(data[start:end])] = size
            start = end
    return out


def plain_print(chunks):
    return "".join(f"{d:016x}{chunks[d]:04x}" for d in sorted(chunks))


def plain_containment(a, b):
    return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a and b else float(not a and not b)


@pytest.mark.parametrize("block_bytes", [1 << 22, 1500])
def test_rows_equal_brute_force(spark, block_bytes):
    rng = random.Random(2)
    words = [f"mot{i}é" for i in range(500)]
    rows = [(i * 700 - 3000, " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))) for i in range(40)]
    rows += [(5, None), (6, ""), (7, "z" * 30000), (8, "z" * 30000), (None, "no id"), (9, rows[3][1]), (9, rows[3][1]), (2**63 - 1, "last id"), (-(2**63), "first id"), (2**62, rows[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'x' as head", "2 as digest", "3 as id")
    got = fp.fingerprint_with_next(docs, block_bytes).collect()
    assert len(got) == len(rows)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (d, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        third = len(t) // 3
        e = t[: len(t) - third] + following[:third]
        a, b, c = (plain_chunks(x.encode()) for x in (t, e, following))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_print(a), plain_print(b), plain_containment(a, b), plain_containment(a, c)))
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(20000))
    ends = fp.cuts(data)
    assert ends[-1] == len(data) and all(1 <= b - a <= fp.MOST for a, b in zip([0, *ends], ends))
    moved = fp.chunk_set(b"some bytes more" + data)
    assert fp.containment(fp.chunk_set(data), moved) > 0.97
    assert fp.containment(fp.chunk_set(data), fp.chunk_set(bytes(rng.randrange(256) for _ in range(20000)))) < 0.01
    assert fp.containment(fp.chunk_set(b""), fp.chunk_set(b"")) == 1 and fp.containment(fp.chunk_set(b"a"), fp.chunk_set(b"")) == 0


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    docs = spark.createDataFrame([(4, "only one text")][:n], "doc_id long, text string")
    got = fp.fingerprint_with_next(docs).collect()
    assert len(got) == n and all(r.near_next == 1 for r in got)
