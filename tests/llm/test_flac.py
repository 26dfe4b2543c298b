import hashlib
import random
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.llm import flac, queries


def test_round_trip_both_paths():
    rng = random.Random(1)
    payloads = [flac.padded(t) for t in ("", "a", None, "hello " * 300, "é" * 577, "x" * 576)]
    payloads += [bytes(rng.randrange(256) for _ in range(1728)), bytes([0, 255] * 288)]
    streams = flac.encode_bytes(payloads)
    for p, s, d in zip(payloads, streams, flac.decode_streams(streams), strict=True):
        assert (d["pcm"][:, 0] + 128).astype(np.uint8).tobytes() == p
        info = flac._parse(s)
        one = np.concatenate([flac._frame(s[a:b], flac._header(s[a:b], 0), 8) for a, b in zip(info["starts"].tolist(), info["ends"].tolist(), strict=True)])
        assert (one[:, 0] + 128).astype(np.uint8).tobytes() == p


def test_linear_prediction_is_chosen_and_exact():
    rng = np.random.default_rng(3)
    t = np.arange(576 * 40)
    wave = (60 * np.sin(t / 9) + 40 * np.sin(t / 2.7) + rng.normal(0, 2, len(t))).astype(np.int8)
    text = flac.padded("Prose of several words, in sentences of some length. " * 200)
    payloads = [(wave.view(np.uint8) ^ 0x80).tobytes(), text, bytes(576), b"\x80" * 576, bytes(rng.integers(0, 256, 5760, dtype=np.uint8))]
    streams = flac.encode_bytes(payloads)
    kinds = []
    for p, s, d in zip(payloads, streams, flac.decode_streams(streams), strict=True):
        assert (d["pcm"][:, 0] + 128).astype(np.uint8).tobytes() == p
        info = flac._parse(s)
        for n, (a, b) in enumerate(zip(info["starts"].tolist(), info["ends"].tolist(), strict=True)):
            head = flac._header(s[a:b], 0)
            kinds.append(s[a + head[0]] >> 1)
            # the plain path, one sample after the other
            assert (flac._frame(s[a:b], head, 8)[:, 0] + 128).astype(np.uint8).tobytes() == p[576 * n : 576 * n + 576]
    assert kinds[:40].count(31 + flac.ORDER) > 30 and {0, 8} < set(kinds)
    assert len(streams[0]) < 0.7 * len(payloads[0])


def test_groups_of_frames(monkeypatch):
    payloads = [flac.padded("one text after the other " * n) for n in (1, 70, 400, 3)]
    whole = flac.encode_bytes(payloads)
    monkeypatch.setattr(flac, "GROUP", 5)
    assert flac.encode_bytes(payloads) == whole
    assert [(d["pcm"][:, 0] + 128).astype(np.uint8).tobytes() for d in flac.decode_streams(whole)] == payloads


def test_long_texts_need_bounded_memory():
    """30 MB in a process of its own, as the executors allow some 600 MB a worker."""
    code = """
import resource, sys
from loamwork.llm import flac
text = "Words of a long text, one after the other, 0123456789.\\n" * 545_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
data = flac.encode_bytes([flac.padded(text)])[0]
got = flac._row(flac.decode_streams([data])[0])
assert got["pcm"] == flac.padded(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    assert float(out.stdout) < 700, out.stdout


def test_streams_without_seek_table():
    s = flac.encode_bytes([flac.padded("frames are found by their headers " * 100)])[0]
    bare = s[:4] + b"\x80" + s[5:42] + s[46 + int.from_bytes(s[43:46], "big") :]
    assert isinstance(flac.decode_streams([bare])[0], dict)


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & (1 << n) - 1, f"0{n}b") if n else ""

    def rice(self, x, k):
        folded = 2 * x if x >= 0 else -2 * x - 1
        self.bits += "0" * (folded >> k) + "1"
        self.put(folded, k)

    def data(self):
        padded = self.bits + "0" * (-len(self.bits) % 8)
        return int(padded, 2).to_bytes(len(padded) // 8, "big")


def lpc_stereo_stream(left, right):
    """Left as LPC of order 2 with two partitions, side verbatim: a 16-bit stereo frame of 16 samples."""
    head = bytes([0xFF, 0xF8, 0x60, 0x88, 0x00, len(left) - 1])
    head += bytes([flac.crc8(head)])
    w = Writer()
    w.put(0b01000010, 8)  # LPC, order 2
    for x in left[:2]:
        w.put(x, 16)
    w.put(4, 4)
    w.put(1, 5)
    w.put(3, 5)
    w.put(-1, 5)
    w.put(0, 2)
    w.put(1, 4)
    residual = [left[i] - ((3 * left[i - 1] - left[i - 2]) >> 1) for i in range(2, len(left))]
    w.put(4, 4)
    for r in residual[: len(left) // 2 - 2]:
        w.rice(r, 4)
    w.put(15, 4)  # escape: raw values
    w.put(16, 5)
    for r in residual[len(left) // 2 - 2 :]:
        w.put(r, 16)
    w.put(0b00000010, 8)  # verbatim
    for a, b in zip(left, right, strict=True):
        w.put(a - b, 17)
    body = head + w.data()
    crc = int(flac.crc16_of(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
    frame = body + struct.pack(">H", crc)
    pcm = np.array(list(zip(left, right, strict=True)), "<i2").tobytes()
    info = struct.pack(">HH", 16, 16) + bytes(6) + (8000 << 44 | 1 << 41 | 15 << 36 | len(left)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame, pcm


def test_lpc_stereo_and_escapes():
    rng = random.Random(4)
    left = [rng.randint(-300, 300) for _ in range(16)]
    right = [rng.randint(-300, 300) for _ in range(16)]
    stream, pcm = lpc_stereo_stream(left, right)
    got = flac.decode_streams([stream])[0]
    assert isinstance(got, dict), got
    assert got["pcm"].astype("<i2").tobytes() == pcm and got["rate"] == 8000


@pytest.mark.parametrize("at", [60, -1, -40])
def test_damage_is_found(at):
    data = bytearray(flac.encode_bytes([flac.padded("some text " * 200)])[0])
    data[at] ^= 4
    assert isinstance(flac.decode_streams([bytes(data)])[0], str)


def test_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc", "x"), (None, None, "y"), (3, "long " * 20000, "z")], "doc_id long, text string, media string")
    out = flac.decode_column(flac.encode_column(docs), keep=("doc_id", "n_bytes"))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert bytes(rows[1]["pcm"]) == flac.padded("abc") and bytes(rows[None]["pcm"]) == b"\xff" * 576
    blocks = flac.pcm_blocks(out.where("doc_id = 3")).orderBy("sample_offset").collect()
    assert len(blocks) > 1 and b"".join(bytes(b["pcm"]) for b in blocks) == flac.padded("long " * 20000)
    assert [b["sample_offset"] for b in blocks] == [sum(x["samples"] for x in blocks[:i]) for i in range(len(blocks))]
    flac.write_pcm(out, f"{tmp_path}/pcm")
    got = flac.read_samples(spark, f"{tmp_path}/pcm", 3, 50_000, 50_100).collect()
    assert len(got) == 1 and bytes(got[0]["pcm"])[50_000 - got[0]["sample_offset"] :][:100] == flac.padded("long " * 20000)[50_000:50_100]
    clash = flac.decode_column(flac.encode_column(docs).withColumn("pcm", F.lit("x")).withColumn("error", F.lit(1)), keep=("doc_id", "pcm", "error", "media"))
    assert clash.columns.count("pcm") == 1 and sorted(bytes(r["pcm"])[:3] for r in clash.collect()) == [b"abc", b"lon", b"\xff\xff\xff"]
    assert flac.decode_column(flac.encode_column(docs.limit(0))).count() == 0
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    got = {r["doc_id"]: (r["error"], r["pcm"]) for r in flac.decode_column(broken, ("doc_id",)).collect()}
    assert got[1][0] and got[1][1] is None and got[2] == (None, None)


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op8_flac_media(spark, small).collect():
        payload = flac.padded(texts[r["doc_id"]])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stream = flac.encode_bytes([payload])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
        samples = [x - 128 for x in payload]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
        assert r["feature"] == f"samples={len(samples)};crossings={crossings};energy={sum(x * x for x in samples)}"
