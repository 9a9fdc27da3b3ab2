import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import jpeg
from tests.llm.helpers import documents, empty_frame, odd_frame
from tests.llm.test_tokens import key


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_round_trip(data):
    payload = np.full(max(576, -(-len(data) // 576) * 576), 255, np.uint8)
    payload[: len(data)] = np.frombuffer(data, np.uint8)
    got, n, _ = jpeg.restore(jpeg.store(payload, len(data)))
    assert n == len(data) and got.tobytes() == payload.tobytes()


def test_pictures_side_by_side_are_read_as_one_by_one():
    texts = [t for _, t in documents(5)] + ["", "   ", " " * 700, "\u00ff" * 300, "abc " * 400]
    stored = jpeg.store_many([jpeg.padded(t) for t in texts])
    assert stored == [jpeg.store(*jpeg.padded(t)) for t in texts]
    for s, t, many in zip(stored, texts, jpeg.decode_many([*stored, *stored])):
        one = jpeg.decode_coefficients(s)
        for a, b in zip(one.components, many.components):
            assert (a.coefficients == b.coefficients).all()
        assert jpeg.payload_of(one)[0].tobytes() == jpeg.padded(t)[0].tobytes()
    # codes of several lengths, runs of zeros, ends of bands and restart markers are all there
    image = jpeg.read_markers(stored[0])
    assert len(set(jpeg.first_table().length.tolist())) > 6 and b"\xff\xd0" in stored[0]
    assert [s[0][1:5] for s in image.scans] == [(0, 0, 0, 0), (1, 5, 0, 1), (1, 48, 0, 1), (1, 48, 0, 1), (6, 48, 0, 1), (1, 48, 1, 0), (1, 48, 1, 0), (1, 48, 1, 0)]


def test_every_byte_in_every_place():
    payload = np.tile(np.arange(256, dtype=np.uint8), 9 * 48)[: 576 * 192]
    blanks = payload.copy()
    blanks[np.random.default_rng(1).random(len(blanks)) < 0.7] = 32
    for p in (payload, blanks, np.full(576, 32, np.uint8)):
        assert (jpeg.restore(jpeg.store(p, len(p)))[0] == p).all()


def code_bits(value, size):
    value = value if value > 0 else value + (1 << size) - 1
    return [value >> k & 1 for k in range(size - 1, -1, -1)]


def test_general_scans_with_runs_new_coefficients_and_corrections():
    """A grey 8 x 16 picture of two blocks, coded by hand: runs, an end-of-band run, a new coefficient in refinement."""
    def huff(kind, pairs):  # codes of eight bits each, in order
        return jpeg.part(0xC4, bytes([kind << 4, *[0] * 7, len(pairs), *[0] * 8, *pairs]))

    def bits(*parts):
        flat = np.array([b for p in parts for b in p], np.uint8)
        return jpeg.packed(flat)

    def sym(k):
        return [k >> s & 1 for s in range(7, -1, -1)]

    frame = b"\xff\xd8" + jpeg.part(0xDB, bytes([0]) + bytes([1] * 64)) + jpeg.part(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    dc = huff(0, [0, 3]) + jpeg.scan([(1, 0)], 0, 0, 0, 0, bits(sym(1), code_bits(5, 3), sym(1), code_bits(-4, 3)))
    # block 0: two zeros then 3 << 1 at place 3, then end of band; block 1: end of band (run of one)
    ac = huff(1, [0x22, 0x00]) + jpeg.scan([(1, 0)], 1, 10, 0, 1, bits(sym(0), code_bits(3, 2), sym(1), sym(1)))
    # refinement: block 0: one zero skipped, new -1 at place 2, then end of band with place 3's correction bit;
    # block 1: end of band
    fine = huff(1, [0x11, 0x00]) + jpeg.scan([(1, 0)], 1, 10, 1, 0, bits(sym(0), [0], sym(1), [1], sym(1)))
    image = jpeg.decode_coefficients(frame + dc + ac + fine + b"\xff\xd9")
    got = image.components[0].coefficients[0]
    assert got[0, :5].tolist() == [5, 0, -1, 7, 0] and got[1, :5].tolist() == [1, 0, 0, 0, 0]
    assert jpeg.rgb(image).shape == (8, 16, 3)


def test_inverse_transform_and_chroma():
    image = jpeg.restore(jpeg.store(*jpeg.padded("some text")))[2]
    plane, block = jpeg.planes(image)[0], image.components[0].coefficients[0, 0]
    order, slow = jpeg.zigzag(), np.zeros((8, 8))
    c = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    for k, value in enumerate(block):
        v, u = divmod(int(order[k]), 8)
        for y in range(8):
            for x in range(8):
                slow[y, x] += c(u) * c(v) / 4 * value * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    assert np.allclose(plane[:8, :8], slow + 128, atol=0.05)
    assert order[:6].tolist() == [0, 1, 8, 16, 9, 2]
    pixels = jpeg.rgb(image)
    cb, cr = (p[0, 0].clip(0, 255) - 128 for p in jpeg.planes(image)[1:])
    y = plane[:2, :2].clip(0, 255)
    assert np.abs(np.clip(y + 1.402 * cr, 0, 255) - pixels[:2, :2, 0]).max() <= 1 and np.abs(np.clip(y + 1.772 * cb, 0, 255) - pixels[:2, :2, 2]).max() <= 1


def test_columns(spark):
    for frame, rows in ((spark.createDataFrame(documents(30), "doc_id long, text string"), documents(30)), odd_frame(spark)):
        want = []
        for doc, text in rows:
            raw = (text or "").encode()
            payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            want.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
        got = jpeg.digests(frame).collect()
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
        assert len({r.payload_sha256 for r in got}) == len({(r.payload_sha256, r.n_bytes, r.media_sha256, r.feature) for r in got})
    assert jpeg.digests(empty_frame(spark)).count() == 0
    r = jpeg.media(frame).first()
    assert len(r.pixels) == r.height * r.width * 3


def test_large_pictures_and_bad_input():
    payload = np.random.default_rng(1).integers(0, 256, 576 * 5000).astype(np.uint8)
    got, n, image = jpeg.restore(jpeg.store(payload, len(payload)))
    assert n == len(payload) and (got == payload).all() and image.height <= 65535
    for bad in (b"no", b"\xff\xd8\x00\x00\x00\x00"):
        with pytest.raises(ValueError):
            jpeg.decode_coefficients(bad)
