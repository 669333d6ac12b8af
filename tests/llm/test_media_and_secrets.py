import hashlib
import random
import re
import zlib

import pytest

from nameweave.llm import ogg, secrets
from tests.llm.conftest import collected, rows


def test_ogg_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 64, 255, 4095, 4096, 4097, 65_025, 300_000):
        payload = rng.randbytes(n)
        for block in (255, 510, 4096, 70_000):
            assert ogg.restore(ogg.mux(payload, block=block))[0] == payload
        assert ogg.mux(payload) == ogg.mux(payload)


def test_page_checksum_bit_by_bit():
    def slow(data):
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    for data in (b"", b"a", bytes(range(256)), b"OggS" * 99):
        assert ogg.page_crc(data) == slow(data)


def test_streams_packets_and_times():
    found = ogg.demux(ogg.mux(bytes(10_000), rate=1000, block=4096))
    one, two = sorted(found.values(), key=lambda s: -len(s["packets"]))
    assert [len(p) for p in one["packets"][1:]] == [4096, 1808] and [len(p) for p in two["packets"][1:]] == [4096]
    assert one["ends"] == [0, 4096, 5904] and two["ends"] == [0, 4096] and one["ended"]


def test_packets_run_over_pages():
    """With the registered block size too: pages that continue a packet, whose granule position is none where no packet ends."""
    data = ogg.mux(random.Random(3).randbytes(1_000_000))
    pages = list(ogg.read_pages(data))
    assert sum(bool(flags & ogg.CONTINUED) for flags, *_ in pages) > 5
    assert ogg.restore(data)[0] == random.Random(3).randbytes(1_000_000)
    long = list(ogg.read_pages(ogg.mux(bytes(300_000), block=200_000)))
    assert any(granule == ogg.NO_GRANULE for _, granule, *_ in long)


def test_foreign_streams_are_no_samples():
    """Sound Ogg files that hold something else."""
    for first in (b"", b"OpusHead\x01", b"\x01vorbis" + bytes(50), ogg.IDENT, ogg.IDENT + bytes(20)):
        data = b"".join(ogg._pages([first, b"abc"], [0, 3], 7))
        with pytest.raises(ogg.OggError):
            ogg.restore(data)
    with pytest.raises(ogg.OggError):
        ogg.restore(b"")


def test_failed_checks_are_nulls_and_not_sound(spark):
    good = ogg.mux(b"a" * 64)
    df = spark.createDataFrame([(1, good), (2, good[:-1]), (3, None), (4, b"".join(ogg._pages([b"OpusHead"], [0], 1)))], "i long, media binary")
    found = {r.i: r.f for r in df.select("i", ogg.features(df.media).alias("f")).collect()}
    assert found[1].payload_bytes == 64 and all(found[i] is None or found[i].media_sha256 is None for i in (2, 3, 4))


def test_times_that_are_no_sample_counts_are_found():
    """Granule positions that are wrong while all checksums are right, each by itself and all by one rule."""
    good = ogg.mux(random.Random(5).randbytes(300_000), block=70_000)
    pages = list(ogg.read_pages(good))
    page = lambda p, granule: ogg._page(p[0], granule, p[2], p[3], p[4], bytes(p[5]))
    assert b"".join(page(p, p[1]) for p in pages) == good and any(p[1] == ogg.NO_GRANULE for p in pages)
    wrong = [[(7 * p[1] + 13) % (1 << 63) for p in pages]]
    for i, p in enumerate(pages):
        for g in (p[1] - 1 if p[1] else 1, 0 if p[1] == ogg.NO_GRANULE else ogg.NO_GRANULE):
            wrong.append([q[1] if j != i else g for j, q in enumerate(pages)])
    for granules in wrong:
        with pytest.raises(ogg.OggError):
            ogg.restore(b"".join(page(p, g) for p, g in zip(pages, granules, strict=True)))


def test_features_of_the_samples():
    feature = ogg.restore(ogg.mux(bytes([128, 130, 126, 126, 138, 128, 118, 128])))[1]
    assert feature.endswith(f"mean=-0.250000;rms={(212 / 8) ** 0.5:.6f};crossings=4")


def test_damage_is_found():
    good = ogg.mux(random.Random(2).randbytes(20_000))
    for at in range(0, len(good), 997):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.restore(bytes(bad))
    starts = [m.start() for m in re.finditer(b"OggS", good)]
    pages = [good[a:b] for a, b in zip(starts, [*starts[1:], len(good)], strict=True)]
    for i in range(len(pages)):
        with pytest.raises(ogg.OggError):
            ogg.restore(b"".join(pages[:i] + pages[i + 1 :]))


def test_media_query(odd, none, clashing):
    want = []
    for i, t, *_ in rows():
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), hashlib.sha256(ogg.mux(padded)).hexdigest()))
    got = ogg.media_features(odd).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256)) for r in got)
    assert collected(ogg.media_features(clashing)) == collected(ogg.media_features(odd))
    assert ogg.media_features(none).count() == 0
    assert "media" in ogg.media_table(odd).columns


BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute_spans(text):
    found = []
    for k, p in BASE.items():
        for m in p.finditer(text or ""):
            if len(m[2] if k == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[k]:
                found.append((m.start(), m.end(), k))
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_spans_against_full_search():
    rng = random.Random(3)
    bits = ["password", "PassWd", "token", "api_key", "APIKEY", "AKIA", "=", ":", " ", '"', "'", "é", "ſecret", "Key", "abcdef0123456789", "deadbeef", "A1B2C3D4E5F6G7H8", "xyzxyzxyzxyz", "\n", "ghp_", "secret", ".", "-"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert [s for s in secrets.spans(text) if s[2] in BASE] == brute_spans(text)


def test_checksums():
    part = "aB3" * 10
    good = part + secrets.checksum62(part.encode()).decode()
    assert secrets.spans(f"é ghp_{good}.") == [(2, 42, "github")]
    assert secrets.spans(f"npm_{good}") == [(0, 40, "npm")]
    assert secrets.spans(f"npm_{good}x") == [] and secrets.spans(f"ghp_{part}000000") == []


def test_secret_query(odd, none, clashing):
    got = secrets.secret_spans(odd).collect()
    text = {i: t for i, t, *_ in rows()}
    for r in got:
        if r.doc_id is not None:
            base = ",".join(f"{k}:{s}:{e}" for s, e, k in brute_spans(text[r.doc_id]))
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == base
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in got}[8] == (1, 1, 1)
    assert len(got) == len(rows()) and secrets.secret_spans(none).count() == 0
    assert collected(secrets.secret_spans(clashing)) == collected(secrets.secret_spans(odd))
    clean = secrets.redacted(odd).where("doc_id = 8").first().text
    assert clean.count("[SECRET]") == 3 and "AKIA" not in clean
    assert secrets.redacted(odd).columns == odd.columns
