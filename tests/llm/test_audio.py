import hashlib
import struct
import zlib

import numpy as np
from helpers import edge_docs, frame, real_docs, rows_of

from weir.llm import audio


def test_digest_is_a_round_trip(spark):
    rows = edge_docs() + real_docs()[:40]
    want = []
    for r in rows:
        raw = (r["text"] or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((r["doc_id"], len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])))
    out = audio.media_digest(frame(spark, rows))
    assert rows_of(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    same = out.groupBy("payload_sha256").agg({"feature": "collect_set", "media_sha256": "collect_set"}).collect()
    assert all(len(r[1]) == len(r[2]) == 1 for r in same)
    assert audio.media_digest(frame(spark, [])).count() == 0


def test_tables():
    mu, a = audio.TABLE[audio.MULAW], audio.TABLE[audio.ALAW]
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(a.tolist())) == 256 and (np.sort(mu[:128]) == mu[:128]).all()


def scalar_adpcm(block):
    level, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [level]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            d = step >> 3
            d += step if n & 4 else 0
            d += step >> 1 if n & 2 else 0
            d += step >> 2 if n & 1 else 0
            level = max(-32768, min(32767, level - d if n & 8 else level + d))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[n & 7]))
            out.append(level)
    return out


def test_adpcm_equals_scalar_decoder():
    data = np.random.default_rng(1).integers(0, 256, 64 * 50, dtype=np.uint8)
    got = audio.decode_adpcm(data, 64, at_once=7)
    assert got.tolist() == [scalar_adpcm(data[i : i + 64].tobytes()) for i in range(0, len(data), 64)]


def scalar_mulaw(u):
    u = ~u & 255
    size = ((u & 15) * 8 + 132 << (u >> 4 & 7)) - 132
    return -size if u & 128 else size


def scalar_alaw(a):
    a ^= 0x55
    exponent, size = a >> 4 & 7, (a & 15) * 16
    size = size + 8 if not exponent else (size + 264) << exponent - 1
    return size if a & 128 else -size


def brute_feature(payload):
    mu, al = [scalar_mulaw(x) for x in payload], [scalar_alaw(x) for x in payload]
    ad = [x for i in range(0, len(payload), 64) for x in scalar_adpcm(payload[i : i + 64])]
    level = lambda name, x: f"{name}:{max(map(abs, x))}:{sum(map(abs, x)) // len(x)}"
    turns = sum((a < 0) != (b < 0) for a, b in zip(mu, mu[1:]))
    pcm = [y for a, b in zip(mu, [*mu[1:], mu[-1]]) for y in (a, a + (b - a) // 2)]
    return ";".join([level("mulaw", mu), level("alaw", al), level("adpcm", ad), f"turns:{turns}", f"pcm16k:{zlib.crc32(struct.pack(f'<{len(pcm)}h', *pcm)):08x}"])


def brute_file(payload):
    form = struct.pack("<HHIIHHH", 7, 1, 8000, 8000, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_features_and_files_equal_brute_force(spark):
    rows = [r for r in edge_docs() if len(r["text"] or "") < 10_000] + real_docs()[:25] + [{"doc_id": 1, "text": "\u00ff\x00\x7f" * 40, "lang": None, "source": None}]
    want = []
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        file = brute_file(payload)
        want.append((r["doc_id"], len(file), hashlib.sha256(file).hexdigest(), brute_feature(payload)))
    assert rows_of(audio.media_digest(frame(spark, rows)), "doc_id", "media_bytes", "media_sha256", "feature") == sorted(want, key=repr)


def test_resampling_by_whole_and_broken_ratios():
    x = np.random.default_rng(3).integers(-32768, 32768, 500).astype(np.int16)
    for rate, to in ((8000, 16000), (8000, 24000), (8000, 11025), (16000, 8000)):
        for pcm in (x, np.stack([x, x[::-1]], 1), x[:1]):
            got = audio.resample(pcm, rate, to)
            want = [pcm[i * rate // to].astype(int) + (pcm[min(i * rate // to + 1, len(pcm) - 1)].astype(int) - pcm[i * rate // to].astype(int)) * (i * rate % to) // to for i in range(len(pcm) * to // rate)]
            assert (got == np.array(want).reshape(got.shape)).all()


def test_expand_stores_pcm_and_survives_damage(spark):
    pcm = np.arange(-50, 50, dtype="<i2")
    files = [
        audio.wave(bytes(range(200)), audio.MULAW), audio.wave(bytes(range(200)), audio.ALAW), audio.wave(bytes(128), audio.IMA, 8000, 64, 4),
        audio.wave(pcm.tobytes(), audio.PCM, 16000, 2, 16), b"RIFF", b"", None, audio.wave(b"abc", 99), audio.wave(b"", audio.MULAW),
    ]
    df = spark.createDataFrame([(i, f, "old") for i, f in enumerate(files)], "id int, media binary, pcm string")
    got = {r["id"]: r["pcm"] for r in audio.expand(df).collect()}
    sizes = {i: len(audio.read_wave(bytes(f))[3]) if f is not None else None for i, f in got.items()}
    assert sizes == {0: 800, 1: 800, 2: 2 * 2 * 121 * 2, 3: 200, 4: None, 5: None, 6: None, 7: None, 8: 0}
    stored = audio.store(frame(spark, edge_docs()).select("doc_id", "text"))
    assert audio.expand(stored).where("pcm is null").count() == 0


def test_expand_keeps_channels(spark):
    one, two = (np.random.default_rng(i).integers(0, 256, 64 * 9, dtype=np.uint8) for i in (1, 2))
    both = np.stack([one, two], 1).tobytes()
    adpcm = np.stack([one.reshape(-1, 16, 4), two.reshape(-1, 16, 4)], 2).tobytes()
    kinds = [(audio.MULAW, 1, 8), (audio.ALAW, 1, 8), (audio.IMA, 64, 4), (audio.PCM, 2, 16)]
    files = [audio.wave(np.stack([one.view("<i2"), two.view("<i2")], 1).tobytes() if t == audio.PCM else adpcm if t == audio.IMA else both, t, 8000, 2 * b, bits, 2) for t, b, bits in kinds]
    files += [audio.wave(x.tobytes(), t, 8000, b, bits) for t, b, bits in kinds for x in (one, two)]
    df = spark.createDataFrame(list(enumerate(files)), "id int, media binary")
    got = {r["id"]: bytes(r["pcm"]) for r in audio.expand(df).collect()}
    for i in range(4):
        *_, data, channels = audio.read_wave(got[i])
        assert channels == 2
        want = [np.frombuffer(audio.read_wave(got[4 + 2 * i + c])[3], "<i2") for c in (0, 1)]
        assert np.frombuffer(data, "<i2").reshape(-1, 2).T.tolist() == [w.tolist() for w in want]
