import numpy as np
import pytest

from strandlog import cli, engine
from strandlog.errors import EngineError
from strandlog.operators import identity, watermark
from strandlog.operators.watermark import Audio, Policy, detect, embed, read_wav, write_wav


def tone(rate, seconds, amplitude=1200):
    return Audio(rate, 1, np.trunc(amplitude * np.sin(2 * np.pi * 440 * np.arange(int(rate * seconds)) / rate)).astype(np.int16))


LOUD = Policy(amplitude_dbfs=-32.0)


def test_wav_round_trip():
    a = tone(48000, 0.25)
    a = Audio(48000, 2, np.concatenate([a.samples[:-100], np.full(100, -321, np.int16)]))
    b = read_wav(write_wav(a))
    assert (b.samples == a.samples).all() and b.channels == 2 and b.seconds() == 0.125


@pytest.mark.parametrize("cut", [lambda w: b"", lambda w: w[:40], lambda w: b"JUNK" + w[4:], lambda w: w[:20] + b"\3" + w[21:], lambda w: w[:-3]])
def test_bad_wav(cut):
    with pytest.raises(EngineError) as e:
        read_wav(cut(write_wav(tone(8000, 0.1))))
    assert e.value.code == "decode"


def test_low_band():
    marked, n = embed(tone(48000, 2.2), 0x4A31, "W1", LOUD)
    found = detect(marked)
    assert n >= 2 and [(o["code"], o["start_frame"]) for o in found] == [(0x4A31, 0), (0x4A31, 38400)]


def test_high_band():
    marked, _ = embed(tone(96000, 2.2), 0x92B4, "W2", LOUD)
    assert [(o["band"], o["code"], o["start_frame"]) for o in detect(marked)] == [("W2", 0x92B4, 0), ("W2", 0x92B4, 76800)]
    with pytest.raises(EngineError) as e:
        embed(tone(48000, 1.0), 0x1007, "W2")
    assert e.value.code == "watermark_path_unqualified"


def test_misaligned_start():
    marked, _ = embed(tone(48000, 2.4), 0x22D9, "W1", LOUD)
    found = detect(Audio(48000, 1, marked.samples[624:]))
    assert [(o["code"], o["start_frame"], round(o["confidence"], 4)) for o in found] == [(0x22D9, 37344, 0.5188), (0x22D9, 75744, 0.5188)]


def test_strongest_of_overlapping_reads():
    samples = np.trunc(1200 * np.sin(2 * np.pi * 498 * np.arange(48000) / 48000)).astype(np.int16)
    found = detect(embed(Audio(48000, 1, samples), 19986, "W1", LOUD)[0], LOUD)
    assert [(o["code"], o["start_frame"]) for o in found] == [(19986, 0), (2425, 6432)]
    assert watermark.strongest(found) == found[:1]

    def read(band, start, wrong, confidence):
        return {"band": band, "start_frame": start, "end_frame": start + 100, "corrected_preamble_bits": wrong, "confidence": confidence}

    reads = [read("W1", 50, 0, 0.4), read("W1", 100, 0, 0.9), read("W1", 200, 0, 0.9), read("W1", 299, 2, 1.0), read("W1", 300, 0, 0.5), read("W2", 150, 1, 0.3), read("W1", 300, 0, 0.5)]
    assert [id(o) for o in watermark.strongest(reads)] == [id(reads[k]) for k in (1, 2, 4, 5)]
    assert watermark.strongest([]) == []


def test_rate_without_reuse_and_stereo():
    mono = tone(44100, 1.8)
    both = Audio(44100, 2, np.repeat(mono.samples, 2))
    policy = Policy(amplitude_dbfs=-32.0, w1_zero_hz=16500.0, w1_one_hz=17500.0)
    marked, n = embed(both, 0x1234, "W1", policy)
    assert n == 2 and {o["code"] for o in detect(marked, policy)} == {0x1234}


def test_policies():
    with pytest.raises(EngineError) as e:
        embed(tone(48000, 1.0), 1, "W2", Policy(w2_zero_hz=1000, w2_one_hz=2000, w2_minimum_sample_rate=48000))
    assert e.value.code == "watermark_path_unqualified"
    for bad in (Policy(bit_duration_ms=0), Policy(amplitude_dbfs=-5), Policy(amplitude_dbfs=float("nan"))):
        with pytest.raises(EngineError) as e:
            embed(tone(48000, 1.0), 1, "W1", bad)
        assert e.value.code == "invalid_argument"
    assert detect(tone(48000, 0.1)) == []
    with pytest.raises(EngineError):
        watermark.separate()


BASE = ("7c2b2f74-7e31-4a1d-b469-d88d63fc8fcb", 0x4A31, 1000, 1000, 2000, "authorized-test-issuer", "test-key-7")


@pytest.fixture
def keys(tmp_path):
    identity.generate_key_pair(str(tmp_path / "private"), str(tmp_path / "public"))
    return str(tmp_path / "private"), str(tmp_path / "public")


def test_statement_states(keys, tmp_path):
    cose = identity.issue(identity.Statement(*BASE), keys[0])
    state = lambda c, at, k=keys[1]: identity.verify(c, k, at)[0]
    assert [state(cose, t) for t in (999, 1000, 1500, 2000, 2001)] == ["not_yet_valid", "valid", "valid", "valid", "expired"]
    assert state(cose[:-1] + bytes([cose[-1] ^ 1]), 1500) == "invalid_signature"
    identity.generate_key_pair(str(tmp_path / "p2"), str(tmp_path / "q2"))
    assert state(cose, 1500, str(tmp_path / "q2")) == "invalid_signature"
    with pytest.raises(EngineError) as e:
        identity.verify(b"\x98\x04" + cose[1:], keys[1], 1500)
    assert e.value.code == "watermark_signature_invalid"
    for n in range(len(cose)):
        with pytest.raises(EngineError):
            identity.verify(cose[:n], keys[1], 1500)


def test_jvm_signature_is_the_same(spark, keys):
    s = identity.Statement(*BASE)
    assert identity.issue(s, keys[0]) == identity.issue_on_jvm(spark, s, keys[0])


def test_statement_fields():
    for k, bad in ((0, ""), (5, "x" * 257), (6, "x" * 129), (5, "\udcc0"), (3, 2001), (2, 2001)):
        with pytest.raises(EngineError) as e:
            identity.issue(identity.Statement(*BASE[:k], bad, *BASE[k + 1 :]), "/none")
        assert e.value.code == "invalid_argument"
    with pytest.raises(EngineError) as e:
        identity.issue(identity.Statement(*BASE), "/none")
    assert e.value.code == "archive_io"


def test_keys_are_never_replaced(tmp_path):
    (tmp_path / "private").write_bytes(b"sentinel")
    with pytest.raises(EngineError):
        identity.generate_key_pair(str(tmp_path / "private"), str(tmp_path / "public"))
    assert (tmp_path / "private").read_bytes() == b"sentinel" and not (tmp_path / "public").exists()


def test_rfc_8032_vector():
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert identity.public_of(seed).hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    assert identity.sign(seed, b"\x72").hex().startswith("92a009a9f0d4cab8720e820b5f642540")


def test_issue_and_detect(spark, tmp_path, keys, capsys):
    (tmp_path / "in.wav").write_bytes(write_wav(tone(48000, 3, 1000)))
    args = ["--input", "in.wav", "--output", "out.wav", "--statement", "s.cose"]
    args = [str(tmp_path / a) if "." in a else a for a in args]
    fields = ["--private-key", keys[0], "--feed-uuid", BASE[0], "--issuer", BASE[5], "--key-id", BASE[6], "--code", "0x4a31", "--issued-at", "1000", "--not-before", "1000", "--expires-at", "2000"]
    assert cli.main(["watermark", "issue", *args, *fields]) == 0
    assert cli.main(["watermark", "detect", str(tmp_path / "out.wav"), "--statement", str(tmp_path / "s.cose"), "--public-key", keys[1], "--at", "1500"]) == 0
    out = capsys.readouterr().out
    assert out.count("signature_bound_candidate") == 3 and '"authoritative":false' in out
    assert cli.main(["watermark", "detect", str(tmp_path / "in.wav")]) == 4
    clips = spark.createDataFrame([("c", bytearray((tmp_path / "out.wav").read_bytes())), ("bad", bytearray(b"x"))], "audio_id string, wav binary")
    cose = spark.createDataFrame([("c", bytearray((tmp_path / "s.cose").read_bytes()))], "audio_id string, cose binary")
    public = identity._from_pem(keys[1], "PUBLIC", identity._PUBLIC_DER)
    rows = engine.watermark_detect(spark, clips, cose, public, 1500).collect()
    assert [r["state"] for r in rows] == ["signature_bound_candidate"] * 3 and {r["issuer"] for r in rows} == {BASE[5]}
    assert {r["state"] for r in engine.watermark_detect(spark, clips).collect()} == {"candidate"}
