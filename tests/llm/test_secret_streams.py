"""Layers read as streams: every codec, depth without a cap, bounded memory, flagged ends."""

import base64
import bz2
import gzip
import lzma
import resource
import zlib

import pytest

from quillspark.llm import secrets

SECRET = b" password = abc123xyz "


def b64(x):
    return base64.b64encode(x).decode()


def deflate(data, bits):
    c = zlib.compressobj(9, zlib.DEFLATED, bits)
    return c.compress(data) + c.flush()


def kinds(text, **more):
    return [s[2] for s in secrets.spans(text, **more)[1]]


@pytest.mark.parametrize("bits", [-15, -9, *range(9, 16), 31])
def test_every_window_of_deflate(bits):
    hidden = b64(deflate(b"1 2 3 " * 50 + SECRET, bits))
    assert secrets.spans(f"é {hidden} end") == ([], [(2, 2 + len(hidden), "assign")], False)
    assert secrets.redacted(f"é {hidden} end") == "é [SECRET] end"


@pytest.mark.parametrize("pack", [lzma.compress, lambda x: lzma.compress(x) + lzma.compress(b"more"), lambda x: bz2.compress(lzma.compress(x)), lambda x: gzip.compress(gzip.compress(gzip.compress(x)))])
def test_xz_and_nested_streams(pack):
    assert kinds(f"é {b64(pack(b'7 ' * 100 + SECRET))} end") == ["assign"]
    escaped = "".join(f"%{x:02x}" for x in pack(SECRET))
    assert "assign" in kinds(f"é {escaped} end")


def test_broken_streams_give_what_they_hold():
    data = bytearray(gzip.compress(SECRET + bytes(range(256)) * 8))
    data[-20:] = b"?" * 20
    assert "assign" in kinds(b64(bytes(data)))
    for bad in (b"\x1f\x8b\x08", b"\xfd7zXZ\0" + b"?" * 300, b"BZh91AY&SY" + b"?" * 300, b"x\x9c" + b"?" * 300, b"x\x9c"):
        assert kinds(b64(bad)) == [] and secrets.spans(b64(bad))[2] is False


def test_windows_overlap_whatever_the_secret_meets():
    for ahead in range(900, 1100, 7):  # windows of at least 1,000 bytes: the secret lies across their ends
        data = gzip.compress(b"".join(b"%d;" % (k % 10) for k in range(ahead)) + b"z" * 5000 + SECRET + b"y" * 3000)
        assert kinds(b64(data), max_layer=1000) == ["assign"]


def test_secret_300_mb_deep_in_bounded_memory():
    c = zlib.compressobj(9, wbits=31)
    parts = [c.compress(b"lorem ipsum. " * 80_660) for _ in range(300)]
    hidden = b64(b"".join([*parts, c.compress(SECRET), c.flush()]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    base, found, cut = secrets.spans(f"é {hidden} end")  # the run's other alignments may show runs of hex
    assert (2, 2 + len(hidden), "assign") in found and not base and not cut
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10  # KB


def test_what_is_not_read_is_flagged(monkeypatch):
    noise = b64(bytes(x * 7919 >> 3 & 255 for x in range(60_000))).encode()
    deep = b64(gzip.compress(b"-" * 3_000_000 + gzip.compress(noise + SECRET) + b"-" * 3_000_000))
    assert kinds(deep) == ["assign"]  # in one piece
    base, found, cut = secrets.spans(deep, max_layer=20_000)
    assert found or cut  # a stream that goes on past its window is told
    monkeypatch.setattr(secrets, "MAX_DECODED", 1 << 20)
    bomb = f"é {b64(gzip.compress(b'12345' * 1_000_000 + SECRET))} end"
    assert secrets.spans(bomb)[2] and secrets.redacted(bomb) == "é [SECRET] end"
